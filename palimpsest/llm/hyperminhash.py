"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

Each distinct shingle hash falls into one of 128 buckets; a bucket keeps of its least hash the leading-zero
count (6 bits) and the next 10 bits (Yu & Weber 2017). Empty buckets borrow from a bucket found by a fixed
random probe sequence (Shrivastava 2017), so that small sets band as well as large ones. Bands of registers
propose pairs; inside a candidate component the collision-corrected estimate decides which pairs are worth
comparing, and links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components, first_id, named_by
from .session import cut
from .streams import by_group, slices

BUCKETS, MANTISSA = 128, 10
#: Candidate components with more documents or shingles are compared chunk by chunk in tasks of their own.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 19
#: Pairs whose estimate is this many standard deviations below the threshold are not compared in full.
SIGMAS = 6.0
_PROBE = np.argsort(np.random.default_rng(11).random((BUCKETS, BUCKETS)), axis=1)


def lower(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() changes A-Z only


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles (fewer words: the sequence; none: empty)."""
    cuts, words = K.only_hashes(texts, K.WHITE)
    return [np.unique(K.shingle_hashes(words[i:j], k)) for i, j in zip(cuts[:-1], cuts[1:])]


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 registers of a non-empty sorted set: leading-zero count and mantissa of each bucket's least hash."""
    bucket = (hashes >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = bucket[1:] != bucket[:-1]
    rest = hashes[first] & np.uint64((1 << 57) - 1)
    full = np.zeros(BUCKETS, dtype=bool)
    full[bucket[first]] = True
    bits = np.frexp(rest.astype(np.float64))[1]  # bit length, up to rounding at powers of two; equal for equal hashes
    zeros = np.minimum(57 - bits, 63).astype(np.uint64)
    shift = np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64)
    out = np.zeros(BUCKETS, dtype=np.uint16)
    out[bucket[first]] = ((zeros << np.uint64(MANTISSA)) | ((rest >> shift) & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)
    if not full.all():
        source = _PROBE[np.arange(BUCKETS), full[_PROBE].argmax(axis=1)]
        out = np.where(full, out, out[source])
    return out


def estimate(matches: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what chance collisions add.

    Two different least hashes agree in leading zeros with probability about 1/3 and in the mantissa with 2**-10.
    """
    chance = 2.0**-MANTISSA / 3
    return np.clip((matches / BUCKETS - chance) / (1 - chance), 0, 1)


def layout(similarity: float) -> tuple[int, int]:
    """(bands, registers in a band) that miss a pair at the threshold with probability below 1e-6."""
    for rows in (5, 4, 3, 2):
        bands = BUCKETS // rows
        if (1 - similarity**rows) ** bands < 1e-6:
            return bands, rows
    return BUCKETS, 1


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = regs[: bands * rows].reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        out = K.mix(out * np.uint64(0x2545F4914F6CDD1D) + x[:, i])
    return out.view(np.int64)


def sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set (null for an empty one), bands: one row for each row of ``docs``."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            n, digests, keys = [], [], []
            for s in shingle_sets([lower(t) for t in b.column("text").to_pylist()], k):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(registers(s), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "n_shingles", "digest", "bands"])

    return _keyed(docs).mapInArrow(run, "doc_id bigint, row bigint, n_shingles bigint, digest binary, bands array<bigint>")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text, by which a text is found again), text."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.select("doc_id", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text").alias("row"), "text")


class _Group:
    """Documents of one candidate component (or two chunks of it) with the links found so far."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.n = np.array([len(s) for s in sets])
        self.root = np.arange(len(sets))
        self.regs = np.stack([registers(s) for s in sets])
        flat = np.concatenate(sets)
        _, self.flat = np.unique(flat, return_inverse=True)
        self.cuts = np.zeros(len(sets) + 1, dtype=np.int64)
        np.cumsum(self.n, out=self.cuts[1:])
        self.mark = np.zeros(int(self.flat.max()) + 1, dtype=np.int32)
        t = num / den
        self.floor = t - SIGMAS * (t * (1 - t) / BUCKETS) ** 0.5

    def linked(self, u: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` share enough: den * intersection >= num * union, on the full sets."""
        mine = self.flat[self.cuts[u] : self.cuts[u + 1]]
        self.mark[mine] = 1
        at = np.repeat(self.cuts[others] - np.append(0, np.cumsum(self.n[others])[:-1]), self.n[others]) + np.arange(self.n[others].sum())
        same = np.add.reduceat(self.mark[self.flat[at]], np.append(0, np.cumsum(self.n[others])[:-1]))
        self.mark[mine] = 0
        return self.den * same.astype(np.int64) >= self.num * (self.n[u] + self.n[others] - same)

    def forest(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect what all links between ``left`` and ``right`` connect; pairs already connected are skipped."""
        out = []
        order = right[np.argsort(self.n[right], kind="stable")]
        sizes = self.n[order]
        for u in left:
            lo = np.searchsorted(sizes, self.n[u] * self.num // self.den)
            hi = np.searchsorted(sizes, -(-self.n[u] * self.den // self.num), side="right")
            some = order[lo:hi]
            some = some[self.root[some] != self.root[u]]
            if not len(some):
                continue
            est = estimate((self.regs[some] == self.regs[u]).sum(axis=1))
            keep = est >= self.floor
            some = some[keep][np.argsort(-est[keep], kind="stable")]
            step = 16
            while len(some):
                now, some = some[:step], some[step:]
                for v in now[self.linked(u, now)]:
                    if self.root[v] != self.root[u]:
                        out.append((int(u), int(v)))
                        self.root[self.root == self.root[v]] = self.root[u]
                some = some[self.root[some] != self.root[u]]
                step = 256
        return out


def links(members: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): a spanning forest of the confirmed links within each candidate component.

    ``members``: (node, component, n_shingles); ``texts``: (node, text). A component over CHUNK nodes or CHUNK_SHINGLES
    shingles is dealt into chunks, each pair of chunks to its own task; every pair is still decided.
    """
    size = F.greatest(F.count("*") / CHUNK, F.sum("n_shingles") / CHUNK_SHINGLES)
    sizes = cut(members.groupBy("component").agg(F.ceil(size).cast("int").alias("k")))
    dealt = members.join(sizes, "component").withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.select("node", "c", "component", F.explode(F.expr("sequence(0, k - 1)")).alias("o"))
    key = F.concat("component", F.least("c", "o").cast("string").cast("binary"), F.lit("-").cast("binary"), F.greatest("c", "o").cast("string").cast("binary"))
    dealt = dealt.select("node", "c", key.alias("key"), F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi")).join(texts, "node")

    def work(table):
        node = table.column("node").to_pylist()
        once = list({x: i for i, x in enumerate(node)}.values())  # repeated rows
        table = table.take(once) if len(once) < len(node) else table
        node, c = table.column("node").to_pylist(), table.column("c").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        group = _Group(shingle_sets([lower(t) for t in table.column("text").to_pylist()], k), num, den)
        left, right = np.flatnonzero(c == lo), np.flatnonzero(c == hi)
        found = group.forest(left, right)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.binary()), pa.array([node[j] for _, j in found], pa.binary())], names=["a", "b"])

    return by_group(dealt, "key", work, "a binary, b binary")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Two rows are linked where den * |intersection| >= num * |union| of their shingle sets. component_id is the
    least doc_id reachable over links. Null, empty and word-less texts have empty sets and link with nothing.
    Equal sets (repeated rows, copies) are one node throughout and are never expanded into pairs. A row without
    doc_id takes part in links but names no component; a component without any id has a null component_id, and its
    rows are kept. Only doc_id and text are read; an empty table gives an empty result.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _resolved(docs, k, num, den).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component does: the least doc_id's (ids first, nulls last).

    Rows whose texts have no words stay. Of repeated rows one stays; where an id repeats with other texts, the row
    with the least hash. All columns are returned.
    """
    rows = cut(_resolved(docs, k, num, den).where("component is not null"))
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ties = rows.where(least).groupBy("component").agg(F.min("row").alias("w"), F.max("row").alias("x")).where("w < x")
    loses = rows.where(~least).select("doc_id", "row").union(rows.where(least).join(ties, "component").where("row <> w").select("doc_id", "row"))
    loses = loses.select(F.col("doc_id").alias("__d"), F.col("row").alias("__r")).distinct()
    again = rows.groupBy("doc_id", "row").count().where("count > 1").select(F.col("doc_id").alias("__d"), F.col("row").alias("__r"))
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), F.col("text").cast("string"))
    keyed = docs.withColumn("__row", row)
    same = lambda other: F.col("doc_id").cast("bigint").eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__r"))
    left = keyed.join(loses, same(loses), "left_anti")
    # repeated winners (a row given twice) are cut down to one; few rows, most often none
    twice = left.join(again, same(again), "left_semi")
    once = twice.dropDuplicates(["doc_id", "__row"])
    return left.join(again, same(again), "left_anti").unionByName(once).drop("__row")


def _resolved(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, row, n_shingles, component (null for empty sets), component_id."""
    bands, rows = layout(num / den)
    rows_ = cut(sketch(docs, k, bands, rows))
    classes = rows_.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("node", named_by("least", "digest")))
    banded = classes.select("node", F.explode("bands").alias("band"))
    # written first, so that the join with it is free to split a hot band
    first = cut(banded.groupBy("band").agg(F.min("node").alias("rep"), F.count("*").alias("m")).where("m > 1").select("band", "rep"))
    star = banded.join(first, "band").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    # one text for each node that has company; equal sets give equal results whichever text stands for them
    candidates = components(star).join(classes.select("node", "row", "n_shingles"), "node")
    texts = _keyed(docs).select("row", "text").join(candidates.select("node", "row"), "row").select("node", "text")
    confirmed = components(links(candidates.select("node", "component", "n_shingles"), texts, k, num, den))
    # a component is called by its least node, and that node by the least id: no join by component is needed
    named = classes.select("digest", "node").join(confirmed, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    of_class = named.withColumn("component_id", first_id("component"))
    out = rows_.join(of_class, "digest", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "row", "n_shingles", "component", "component_id")
