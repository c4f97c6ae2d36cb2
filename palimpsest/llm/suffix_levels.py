"""Removal of byte strings repeated from earlier documents, by a logarithmic family of suffix arrays.

A document's suffixes are indexed to a depth of LENGTH bytes. Every LENGTH-byte string has one anchor (its
leftmost k-byte string of least hash, k = LENGTH / 2), which depends on its bytes alone, so equal strings have
equal anchors and meet in one task when dealt out by anchor hash. Three exchanges of packed arrays suffice:

1. anchor hashes tell which anchors stand in two documents at least; all other strings are unique;
2. the strings around shared anchors (runs of suffixes with one anchor) go to that anchor's task. There each
   batch of runs gets a suffix array, batches join a family of sorted levels in which equal-sized levels merge
   geometrically, and each batch is scanned against the levels for the least document of each suffix;
3. the spans that are covered go back to their documents.

Blocks of documents are dealt out once; Spark reuses that exchange in all three steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

LENGTH = 50
#: Text of a block, and text whose anchors share a task's group, in bytes. A longer document is a block of its own size.
BLOCK_BYTES, GROUP_BYTES = 4 << 20, 4 << 20
#: Text of a batch that enters the index at once.
BATCH_BYTES = 2 << 20
_LAST = (1 << 63) - 1
_STEP = 1 << 19


class LogIndex:
    """Levels of sorted suffixes with the least document of each; a new batch enters below, equal sizes merge."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def array(suffixes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A batch's suffix array: distinct suffixes in order, each with its least document.

        Suffixes are sorted by their first eight bytes as numbers; only those that agree in them are compared as strings.
        """
        lead = np.ascontiguousarray(suffixes.view(np.uint8).reshape(len(suffixes), -1)[:, :8]).view(">u8").ravel().astype(np.uint64)
        order = np.argsort(lead, kind="stable")
        lead = lead[order]
        tied = np.zeros(len(order) + 1, dtype=bool)
        tied[1:-1] = lead[1:] == lead[:-1]
        tied = np.flatnonzero(tied[1:] | tied[:-1])
        order[tied] = order[tied][np.argsort(suffixes[order[tied]], kind="stable")]
        suffixes, docs = suffixes[order], docs[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = suffixes[1:] != suffixes[:-1]
        return suffixes[new], np.minimum.reduceat(docs, np.flatnonzero(new))

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> None:
        if not len(suffixes):
            return
        level = self.array(suffixes, docs)
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            older = self.levels.pop()
            level = self.array(np.concatenate([older[0], level[0]]), np.concatenate([older[1], level[1]]))
        self.levels.append(level)

    def scan(self, suffixes: np.ndarray) -> np.ndarray:
        """The least document of each suffix over all levels; suffixes are merge-scanned in sorted order."""
        order = np.argsort(suffixes, kind="stable")
        ordered, least = suffixes[order], np.full(len(suffixes), _LAST)
        for keys, docs in self.levels:
            at = np.minimum(np.searchsorted(keys, ordered), len(keys) - 1)
            hit = keys[at] == ordered
            least[hit] = np.minimum(least[hit], docs[at[hit]])
        out = np.empty_like(least)
        out[order] = least
        return out


class Block:
    """Documents of a block in a fixed order, with the runs of suffixes that have one anchor."""

    def __init__(self, table: pa.Table, length: int):
        ids = [_LAST if x is None else x for x in table.column("doc_id").to_pylist()]
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.names = [table.column("doc_id")[i].as_py() for i in order]
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.texts = [texts[i] for i in order]
        self.raw = b"".join(self.texts)
        self.ends = np.cumsum([len(t) for t in self.texts])
        self.starts = self.ends - [len(t) for t in self.texts]
        self.length = length

    def runs(self) -> None:
        """lo, n (suffixes lo .. lo + n - 1 share an anchor), hash of the anchor, doc (its number in the block)."""
        length, k = self.length, self.length // 2
        w = length - k + 1
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        found = []
        for at in range(0, max(0, len(buf) - length + 1), _STEP):
            piece = buf[at : at + _STEP + length - 1]
            sums = K.prefix_sums(piece)
            i = np.arange(len(piece) - k + 1)
            h = K.mix(K.span_hashes(sums, i, i + k))
            packed = (h & ~np.uint64((1 << 20) - 1)) | i.astype(np.uint64)
            span, m = 1, packed
            while span * 2 <= w:
                m = np.minimum(m[:-span], m[span:])
                span *= 2
            if span < w:
                m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
            anchor = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
            p = np.arange(len(anchor)) + at
            doc = np.searchsorted(self.ends, p, side="right")
            ok = p + length <= self.ends[np.minimum(doc, len(self.ends) - 1)]
            p, a, doc = p[ok], anchor[ok], doc[ok]
            if not len(p):
                continue
            new = np.ones(len(p), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            found.append((p[first], np.diff(np.append(first, len(p))), h[a[first]], doc[first]))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.lo, self.n, self.hash, self.doc = (np.concatenate(x) for x in zip(*found)) if found else none

    def anchors(self, groups: int):
        """(group, sorted distinct hashes, whether two documents of this block have them) for each group."""
        self.runs()
        order = np.lexsort((self.doc, self.hash))
        h, d = self.hash[order], self.doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        several = np.maximum.reduceat(self.ids[d], first) != np.minimum.reduceat(self.ids[d], first) if len(first) else np.zeros(0, bool)
        h = h[first]
        group = (h % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(groups + 1))
        for g in np.unique(group).tolist():
            some = order[cuts[g] : cuts[g + 1]]
            yield g, h[some], several[some]


_ANCHORS = "grp bigint, block bigint, hashes binary, several binary"
_SHARED = "block bigint, grp bigint, shared binary"
_RUNS = "grp bigint, block bigint, strings binary, sizes binary, entry binary, id binary, doc binary, at binary, spans binary"
_SPANS = "block bigint, spans binary"
_B = pa.binary()


def _table(names: list[str], rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64() if n in ("grp", "block") else _B for n in names]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _number(table: pa.Table, column: str) -> int:
    return table.column(column)[0].as_py()


def _anchors(length: int, groups: int):
    def work(table: pa.Table) -> pa.Table:
        block = Block(table, length)
        return _table(_names(_ANCHORS), [(g, _number(table, "block"), h.tobytes(), s.tobytes()) for g, h, s in block.anchors(groups)])

    return work


def _shared(table: pa.Table) -> pa.Table:
    hashes = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    several = np.concatenate([np.frombuffer(x, dtype=bool) for x in table.column("several").to_pylist()])
    _, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    shared |= several | (np.bincount(inverse, weights=several) > 0)[inverse]
    cuts = np.cumsum([0, *map(len, hashes)])
    return _table(_names(_SHARED), [(b, g, np.packbits(shared[i:j]).tobytes()) for b, g, i, j in zip(table.column("block").to_pylist(), table.column("grp").to_pylist(), cuts[:-1], cuts[1:])])


def _runs(length: int, groups: int):
    def work(docs: pa.Table, marks: pa.Table) -> pa.Table:
        names = _names(_RUNS)
        if not docs.num_rows or not marks.num_rows:
            return _table(names, [])
        block, number = Block(docs, length), _number(docs, "block")
        known = dict(zip(marks.column("grp").to_pylist(), marks.column("shared").to_pylist()))
        keep = [h[np.unpackbits(np.frombuffer(known[g], dtype=np.uint8), count=len(h)).astype(bool)] for g, h, _ in block.anchors(groups)]
        shared = np.sort(np.concatenate(keep)) if keep else np.zeros(0, np.uint64)
        if not len(shared):
            return _table(names, [])
        place = np.minimum(np.searchsorted(shared, block.hash), len(shared) - 1)
        some = np.flatnonzero(shared[place] == block.hash)
        rows, whole = [], []
        group = (block.hash[some] % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(groups + 1))
        lo, hi, ids, docs_of = block.lo, block.lo + block.n - 1 + length, block.ids, block.doc
        for g in np.unique(group).tolist():
            distinct: dict[bytes, int] = {}
            least: list[int] = []
            kept: list[list[int]] = []
            for r in some[order[cuts[g] : cuts[g + 1]]].tolist():  # in order of (doc_id, position)
                s = block.raw[lo[r] : hi[r]]
                i = distinct.setdefault(s, len(least))
                if i == len(least):
                    least.append(ids[docs_of[r]])
                    kept.append([])
                if ids[docs_of[r]] == least[i]:
                    kept[i].append(r)
                else:  # the whole run stands in an earlier document of this block
                    whole.append(r)
            entry = np.repeat(np.arange(len(kept)), [len(x) for x in kept]).astype(np.int32)
            runs = np.array([r for x in kept for r in x], dtype=np.int64)
            d = docs_of[runs]
            rows.append((g, number, b"".join(distinct), _pack(np.array([len(s) for s in distinct])), _pack(entry), _pack(ids[d]), _pack(d), _pack(lo[runs] - block.starts[d]), None))
        if whole:
            r = np.array(whole)
            d = docs_of[r]
            rows.append((number % groups, number, None, None, None, None, None, None, np.stack([d, lo[r] - block.starts[d], hi[r] - block.starts[d]]).tobytes()))
        return _table(names, rows)

    return work


def _pack(x: np.ndarray) -> bytes:
    """Differences of neighbours in as few bytes each as hold them all, after a byte that says how many."""
    steps = np.diff(x.astype(np.int64), prepend=0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if not len(steps) or np.iinfo(k).min <= steps.min() and steps.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, f"i{raw[0]}", offset=1), dtype=np.int64)


def _windows(strings: bytes, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the strings that are ``length`` deep, and the string that each stems from."""
    buf = np.frombuffer(strings, dtype=np.uint8)
    n = sizes.astype(np.int64) - length + 1
    owner = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(sizes.astype(np.int64)) - sizes
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    view = np.lib.stride_tricks.sliding_window_view(buf, length)
    return np.ascontiguousarray(view[at]).view(f"S{length}").ravel(), owner


def _repeated(strings: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to), sorted: stretches of distinct strings whose suffixes stand in an earlier document."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    step = np.cumsum(sizes) // BATCH_BYTES
    batches = [(int(x[0]), int(x[-1]) + 1) for x in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(step)) + 1) if len(x)]
    index = LogIndex(length)
    for i, j in batches:
        suffixes, owner = _windows(b"".join(strings[i:j]), sizes[i:j], length)
        index.add(suffixes, least[i:j][owner])
    found = [np.zeros((3, 0), dtype=np.int64)]
    for i, j in batches:
        suffixes, own = _windows(b"".join(strings[i:j]), sizes[i:j], length)
        at = np.flatnonzero(index.scan(suffixes) < least[i:j][own])
        if not len(at):
            continue
        own = own[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        n = sizes[i:j] - length + 1
        base = np.cumsum(n) - n
        found.append(np.stack([own[head] + i, at[head] - base[own[head]], at[tail] - base[own[head]] + length]))
    return tuple(np.concatenate(found, axis=1))


def _covered(length: int):
    """Covered spans of a group's runs. Strings that several blocks have are indexed once, under their least document."""

    def work(table: pa.Table) -> pa.Table:
        out = [(b, s) for b, s in zip(table.column("block").to_pylist(), table.column("spans").to_pylist()) if s]
        rows = sorted((r for r in table.drop_columns(["spans"]).to_pylist() if r["strings"]), key=lambda r: r["block"])
        number: dict[bytes, int] = {}
        for r in rows:
            raw, r["sizes"], r["entry"], r["id"] = r.pop("strings"), _unpack(r["sizes"]), _unpack(r["entry"]), _unpack(r["id"])
            ends = np.cumsum(r["sizes"], dtype=np.int64).tolist()
            r["string"] = np.array([number.setdefault(raw[i:j], len(number)) for i, j in zip([0, *ends[:-1]], ends)], dtype=np.int64)
            r["least"] = r["id"][np.searchsorted(r["entry"], np.arange(len(ends)))]  # of this block's documents with the string
        least = np.full(len(number), _LAST)
        for r in rows:
            np.minimum.at(least, r["string"], r["least"])
        string, begin, end = _repeated(list(number), least, length)
        del number
        lo, hi = (np.searchsorted(string, np.arange(len(least)), side=s) for s in ("left", "right"))
        for r in rows:
            e = r["entry"]
            own, doc, pos = r["string"][e], _unpack(r["doc"]), _unpack(r["at"])
            whole = r["least"][e] > least[own]
            spans = [np.stack([doc[whole], pos[whole], pos[whole] + r["sizes"][e][whole]])]
            part = np.flatnonzero(~whole & (hi[own] > lo[own]))
            times = hi[own[part]] - lo[own[part]]
            each = np.repeat(part, times)
            which = np.repeat(lo[own[part]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            spans.append(np.stack([doc[each], pos[each] + begin[which], pos[each] + end[which]]))
            both = np.concatenate(spans, axis=1)
            if both.shape[1]:
                out.append((r["block"], both.tobytes()))
        return _table(_names(_SPANS), out)

    return work


def _results(length: int, with_text: bool):
    def work(docs: pa.Table, marks: pa.Table) -> pa.Table:
        block = Block(docs, length)
        found = [np.frombuffer(s, np.int64).reshape(3, -1) for s in marks.column("spans").to_pylist()] if marks.num_rows else []
        spans = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        spans = spans[:, np.lexsort((spans[1], spans[0]))]
        cuts = np.searchsorted(spans[0], np.arange(len(block.texts) + 1))
        rows = []
        for i, text in enumerate(block.texts):
            kept, at, removed, number, end = [], 0, 0, 0, -1
            for s, e in zip(spans[1, cuts[i] : cuts[i + 1]].tolist(), spans[2, cuts[i] : cuts[i + 1]].tolist()):
                if s > end:
                    number += 1
                    kept.append(text[at:s])
                    removed += e - s
                    end = at = e
                elif e > end:
                    removed += e - end
                    end = at = e
            kept.append(text[at:])
            rest = b"".join(kept)
            rows.append((block.names[i], len(text), removed, number, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _B]
        return pa.table({n: pa.array([r[j] for r in rows], k) for j, (n, k) in enumerate(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), kinds))})

    return work


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` bytes) for each row of ``docs``.

    A byte is removed where a ``length``-byte string that covers it also starts in a document with a smaller
    doc_id, judged on the input. Null texts are empty; texts under ``length`` bytes keep everything. A null doc_id
    ranks after all others and removes nothing elsewhere; rows of one doc_id never remove from each other, whether
    equal or not. Only doc_id and text are read; an empty table stays empty.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = own.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks, groups = max(1, -(-total // block_bytes)), max(1, -(-total // group_bytes))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    anchors = dealt.groupBy("block").applyInArrow(_anchors(length, groups), _ANCHORS)
    shared = anchors.groupBy("grp").applyInArrow(_shared, _SHARED)
    runs = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_runs(length, groups), _RUNS)
    spans = runs.groupBy("grp").applyInArrow(_covered(length), _SPANS)
    out = dealt.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_results(length, with_text), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
