"""Toxicity as a sparse linear model with a counterfactual penalty.

Features are the distinct words of a text and the distinct first 4, 5 and 6 bytes of its words. Labelled
sentences that name a group are copied with the group's term swapped for each other one of its line; the squared
difference of the two sentences' scores is added to the log loss, so that naming a group by itself moves no score.
Features are counted and sentences are swapped on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .labels import sample, scored
from .session import cut
from .streams import slices

#: At most so many labelled documents are fitted on (and labels.MAX_BYTES of their text).
MAX_DOCS = 8000
#: A feature gets a weight where so many texts have it and its share of toxic ones is so many deviations from the mean.
SEEN, DEVIATIONS = 3, 4.0
PREFIXES = (4, 5, 6)
#: Terms of one line are swapped for each other.
IDENTITY_TERMS = (
    "women men girls boys woman man mothers fathers",
    "muslim christian jewish hindu buddhist atheist muslims christians jews hindus buddhists atheists",
    "black white asian african european latino arab",
    "gay lesbian straight bisexual transgender",
    "immigrants refugees foreigners natives citizens",
    "frauen männer muslime christen juden ausländer flüchtlinge",
    "femmes hommes musulmans chrétiens juifs étrangers réfugiés",
    "mujeres hombres musulmanes cristianos judíos extranjeros refugiados",
)


def _lower(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode()


def _words(texts: list[bytes]):
    """(owner, starts, ends, {0: (mask, hash of the word), p: (mask, hash of the first p bytes)})"""
    owners, found = [], {p: ([], []) for p in (0, *PREFIXES)}
    for a, b, some in K.batches(texts):
        parts = list(K.cut_at(some[0], K.NOT_ALNUM)) if b - a == 1 and len(some[0]) > K.PIECE else None
        for piece in [[p] for _, p in parts] if parts else [some]:
            batch = K.Batch(piece)
            s, e = K.bounds(batch.buf, K.NOT_ALNUM)
            sums = K.prefix_sums(batch.buf)
            owners.append(np.full(len(s), a) if parts else batch.owner(s) + a)
            found[0][0].append(np.ones(len(s), dtype=bool))
            found[0][1].append(K.mix(K.span_hashes(sums, s, e)))
            for p in PREFIXES:
                long = e - s > p
                found[p][0].append(long)
                found[p][1].append(K.mix(K.span_hashes(sums, s[long], s[long] + p) + np.uint64(p)))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
    return join(owners, np.int64), None, None, {p: (join(m, bool), join(h, np.uint64)) for p, (m, h) in found.items()}


def distinct_features(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct feature hashes of each text (lower-cased)."""
    own, _, _, found = _words([_lower(t) for t in texts])
    allown = np.concatenate([own[m] for m, _ in found.values()])
    allhash = np.concatenate([h for _, h in found.values()])
    order = np.lexsort((allhash, allown))
    allown, allhash = allown[order], allhash[order]
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = (allown[1:] != allown[:-1]) | (allhash[1:] != allhash[:-1])
    allown, allhash = allown[keep], allhash[keep]
    cuts = np.searchsorted(allown, np.arange(len(texts) + 1))
    return [_distinct(allhash[i:j] >> np.uint64(32)) for i, j in zip(cuts[:-1], cuts[1:])]


def _distinct(sorted_keys: np.ndarray) -> np.ndarray:
    """The upper halves of hashes are enough for a few thousand weighted features, and halve what the driver reads."""
    keys = sorted_keys.astype(np.uint32)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


_LINE_OF = {w: line.split() for line in IDENTITY_TERMS for w in line.split()}
_TERM = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(_LINE_OF, key=lambda w: (-len(w), w))) + r")(?![^\W_])")
_SENTENCE_END = re.compile(r"[.!?\n]+")


def swapped(text: str) -> list[tuple[str, str, float]]:
    """(sentence, the same with a term swapped, weight) for each sentence that names a group, term and other term.

    The swaps of one term weigh 1 together, so a line with many terms counts no more than one with few.
    """
    out = []
    text = text.lower()
    if not _TERM.search(text):
        return out
    for sentence in _SENTENCE_END.split(text):
        for term in sorted(set(_TERM.findall(sentence))):
            others = [w for w in _LINE_OF[term] if w != term]
            for other in others:
                out.append((sentence, _TERM.sub(lambda m: other if m.group() == term else m.group(), sentence), 1 / len(others)))  # noqa: B023
    return out


def differences(text: str, chosen: np.ndarray) -> list[tuple[bytes, bytes, float]]:
    """(weighted features that a swap takes away, those that it adds, weight) of each swap that changes any."""
    out = []
    swaps = swapped(text)
    bags = distinct_features([x.encode() for a, b, _ in swaps for x in (a, b)])
    for k, (_, _, weight) in enumerate(swaps):
        gone, come = np.setdiff1d(bags[2 * k], bags[2 * k + 1]), np.setdiff1d(bags[2 * k + 1], bags[2 * k])
        gone, come = (np.flatnonzero(np.isin(chosen, x)).astype(np.int32) for x in (gone, come))
        if len(gone) or len(come):
            out.append((gone.tobytes(), come.tobytes(), weight))
    return out


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> list[float]:
        z = np.full(len(texts), self.bias)
        if len(self.keys) and texts:
            near = np.zeros(1 << 16, dtype=bool)  # most words fail here and are looked up no further
            near[(self.keys >> np.uint32(16)).astype(np.int64)] = True
            own, _, _, found = _words([_lower(t) for t in texts])
            pairs = []
            for mask, h in found.values():
                o = own[mask]
                some = near[(h >> np.uint64(48)).astype(np.int64)]
                o, h = o[some], (h[some] >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                pairs.append(o[hit] * len(self.keys) + at[hit])
            pairs = np.unique(np.concatenate(pairs))
            z += np.bincount(pairs // len(self.keys), weights=self.weights[pairs % len(self.keys)], minlength=len(texts))
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()


def useful(n: int, n1: int, keys: np.ndarray, seen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The sorted features to weigh: their share among toxic texts differs beyond chance."""
    base = n1 / n
    z = (toxic - seen * base) / np.sqrt(seen * base * (1 - base))
    return np.sort(keys[(seen >= SEEN) & (np.abs(z) >= DEVIATIONS) & ((toxic >= SEEN) | (z < 0))])


def constant(n: int, n1: float) -> Model:
    return Model(np.zeros(0, dtype=np.uint32), np.zeros(0), float(np.log((n1 + 0.5) / (n - n1 + 0.5))))


def fit(chosen: np.ndarray, hits: list[np.ndarray], y: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray, float]], penalty: float = 5.0, ridge: float = 0.02, rounds: int = 600) -> Model:
    """Descend on the log loss plus the weighted squared score differences of the swaps.

    ``hits``: the chosen features of each text, as numbers; ``swaps``: features taken away, features added, weight.
    """
    n, size = len(y), len(chosen)
    row, col = np.repeat(np.arange(n), [len(h) for h in hits]), np.concatenate([*hits, np.zeros(0, np.int64)]).astype(np.int64)
    d_row = np.concatenate([np.full(len(g) + len(c), i) for i, (g, c, _) in enumerate(swaps)] or [np.zeros(0, np.int64)])
    d_col = np.concatenate([np.concatenate([g, c]) for g, c, _ in swaps] or [np.zeros(0, np.int64)]).astype(np.int64)
    d_sign = np.concatenate([np.append(np.full(len(g), -1.0), np.ones(len(c))) for g, c, _ in swaps] or [np.zeros(0)])
    times = np.array([t for _, _, t in swaps])
    w, b = np.zeros(size), constant(n, float(y.sum())).bias
    m1, m2 = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        s = b + np.bincount(row, weights=w[col], minlength=n)
        r = (1 / (1 + np.exp(-np.clip(s, -50, 50))) - y) / n
        g = np.bincount(col, weights=r[row], minlength=size) + ridge * w / n * 10
        if len(swaps):
            change = times * np.bincount(d_row, weights=d_sign * w[d_col], minlength=len(swaps))
            g += 2 * penalty * np.bincount(d_col, weights=d_sign * change[d_row], minlength=size) / n
        q = np.append(g, r.sum())
        m1, m2 = 0.9 * m1 + 0.1 * q, 0.999 * m2 + 0.001 * q * q
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(chosen, w, float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_docs: int = MAX_DOCS, penalty: float = 5.0) -> Model:
    """Fit on the labelled rows of ``labels.sample``. Without both labels every score is the base rate (0.5 without any).

    The driver gets the chosen features, the numbers of those that each text has, and the distinct swaps.
    """
    rows = cut(sample(docs, labels, label, max_docs))

    def features(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            bags = distinct_features([t.encode() for t in b.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bags)]), pa.int32()), pa.array(np.concatenate(bags).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("label"), lists], names=["label", "keys"])

    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or n1 in (0, n):
        return constant(n, n1)
    keys = rows.mapInArrow(features, "label int, keys array<bigint>").select("label", F.explode("keys").alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("seen"), F.sum("label").alias("toxic")).where(F.col("seen") >= SEEN)
    base = n1 / n
    counts = counts.where(F.abs((F.col("toxic") - F.col("seen") * base) / F.sqrt(F.col("seen") * base * (1 - base))) >= DEVIATIONS).toPandas()
    chosen = useful(n, n1, counts["key"].to_numpy(dtype=np.uint32), counts["seen"].to_numpy(dtype=np.float64), counts["toxic"].to_numpy(dtype=np.float64))
    if not len(chosen):
        return constant(n, n1)

    def hits(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            bags = distinct_features([t.encode() for t in b.column("text").to_pylist()])
            found = [np.flatnonzero(np.isin(chosen, x)).astype(np.int32).tobytes() for x in bags]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "hits"])

    def changes(batches):
        for b in batches:
            found = [x for t in b.column("text").to_pylist() for x in differences(t, chosen)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.binary(), pa.binary(), pa.float64()))], names=["gone", "come", "weight"])

    own = rows.mapInArrow(hits, "doc_id bigint, label int, hits binary").toPandas().sort_values("doc_id", ignore_index=True)
    swaps = rows.mapInArrow(changes, "gone binary, come binary, weight double").groupBy("gone", "come").agg(F.sum("weight").alias("weight")).toPandas().sort_values(["gone", "come"])
    read = lambda x: np.frombuffer(x, dtype=np.int32)
    return fit(chosen, [read(h) for h in own["hits"]], own["label"].to_numpy(dtype=np.float64), [(read(g), read(c), t) for g, c, t in swaps.itertuples(index=False)], penalty)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", cut: float = 0.5, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    The text alone is scored; other columns, whatever their names, are not read. Null and empty texts get the
    base score; repeated rows get equal scores; an empty table gives none.
    """
    return scored(docs, train(docs, labels, label, max_docs).score, cut)
