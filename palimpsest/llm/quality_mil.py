"""Quality as attention-based multiple-instance learning (Ilse et al. 2018).

A document is a bag of passages of PASSAGE words. Each passage is encoded by shares of byte classes, word
shapes and repetition; gated attention learns from document labels alone which passages decide, and the
attention-weighted mean of the passage representations is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .labels import passing, sample, scored
from .streams import slices

PASSAGE = 64
#: At most so many labelled documents are fitted on (and labels.MAX_BYTES of their text), each with all its passages.
MAX_DOCS = 6000
#: Steps of the descent, whatever the number of documents.
STEPS, SIZE = 2400, 64

_CLASSES = {" \t": 0, "\n\r\x0b\x0c": 1, "abcdefghijklmnopqrstuvwxyz": 2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ": 3, "0123456789": 4, ".,;:": 5, "!?": 6, "%#*&$@": 7, "|<>=_~^+/\\": 8, "'\"()[]{}-`": 9}
_CLASS = np.full(256, 11, dtype=np.uint8)
_CLASS[:128] = 10
for _chars, _k in _CLASSES.items():
    _CLASS[[ord(c) for c in _chars]] = _k
N_CLASSES = 12
N_FEATURES = N_CLASSES + 9


def _encode(texts: list[bytes], at_document_ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    batch = K.Batch(texts)
    buf = batch.buf
    s, e = K.bounds(buf, K.WHITE)
    own = batch.owner(s)
    if not len(s):
        return np.arange(len(texts)), np.zeros((len(texts), N_FEATURES), dtype=np.float32)
    first_word = np.searchsorted(own, np.arange(len(texts)))
    number = (np.arange(len(s)) - first_word[own]) // PASSAGE
    new = np.ones(len(s), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (number[1:] != number[:-1])
    heads = np.flatnonzero(new)
    passage = np.cumsum(new) - 1
    n = len(heads)
    words = np.diff(np.append(heads, len(s))).astype(np.float64)
    # bytes from a passage's first word to the next passage's first word
    at = np.append(s[heads], len(buf))
    of_byte = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    counts = np.bincount(of_byte * N_CLASSES + _CLASS[buf[at[0] :]], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    size = np.maximum(counts.sum(1, keepdims=True), 1)
    h = K.mix(K.span_hashes(K.prefix_sums(buf), s, e))
    ordered = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    distinct = np.bincount((ordered[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    again = np.zeros(len(s), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & ~new[1:]
    last, lead = buf[e - 1], buf[s]
    length = (e - s).astype(np.float64)
    mean = lambda x: np.bincount(passage, weights=x, minlength=n) / words
    more = np.stack(
        [
            distinct / words,
            mean(again),
            np.minimum(mean(length), 40) / 10,
            mean(_CLASS[last] == 7),
            mean(_CLASS[last] == 6),
            mean(_CLASS[last] == 5),
            mean(_CLASS[lead] == 3),
            mean((length == 1) & (_CLASS[lead] == 8)),
            np.log2(words) / 6,
        ],
        axis=1,
    )
    return own[heads], np.hstack([counts / size, more]).astype(np.float32)


def passages(texts: list[bytes]) -> list[np.ndarray]:
    """For each text a matrix (passages x N_FEATURES); a text without words is one passage of zeros."""
    out: list[np.ndarray] = []
    for a, b, some in K.batches(texts):
        if b - a == 1 and len(some[0]) > K.PIECE:  # a very long text, piece by piece
            out.append(np.vstack([_encode([p])[1] for _, p in K.cut_at(some[0], K.WHITE)]))
            continue
        own, x = _encode(some)
        cuts = np.searchsorted(own, np.arange(b - a + 1))
        none = np.zeros((1, N_FEATURES), dtype=np.float32)
        out += [x[i:j] if j > i else none for i, j in zip(cuts[:-1], cuts[1:])]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, texts: list[bytes]) -> list[float]:
        bags = passages(texts)
        x = (np.vstack(bags) - self.mean) / self.scale if bags else np.zeros((0, N_FEATURES))
        z, *_ = _forward(self.p, x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags))
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()


def _forward(p, x, bag, n):
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["a"]
    e = np.exp(e - e.max()) if len(e) else e
    total = np.bincount(bag, weights=e, minlength=n)
    w = e / total[bag]
    pooled = np.stack([np.bincount(bag, weights=w * h[:, j], minlength=n) for j in range(h.shape[1])], axis=1)
    return pooled @ p["c"] + p["d"], h, t, g, w, pooled


def fit_bags(bags: list[np.ndarray], y: np.ndarray, hidden: int = 12, gate: int = 8, steps: int = STEPS, size: int = SIZE, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam on the log loss of the pooled representation; deterministic."""
    rng = np.random.default_rng(7)
    allx = np.vstack(bags) if bags else np.zeros((1, N_FEATURES))
    mean, scale = allx.mean(0), allx.std(0) + 1e-3
    p = {"W": rng.normal(0, 0.3, (N_FEATURES, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)), "a": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
    if len(bags) == 0 or len(set(y.tolist())) < 2:  # nothing to tell apart: the base rate
        p["c"][:] = 0
        rate_y = (float(y.sum()) + 0.5) / (len(y) + 1)
        p["d"][0] = np.log(rate_y / (1 - rate_y))
        return Model(mean, scale, p)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    while step < steps:
        now = rate * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            x = (np.vstack([bags[i] for i in pick]) - mean) / scale
            bag, n = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick]), len(pick)
            z, h, t, g, w, pooled = _forward(p, x, bag, n)
            dz = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[pick]) / n
            dpool = dz[:, None] * p["c"]
            dh = w[:, None] * dpool[bag]
            dw = (dpool[bag] * h).sum(1)
            de = w * (dw - np.bincount(bag, weights=w * dw, minlength=n)[bag])
            dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
            dh += dt @ p["V"].T + dg @ p["U"].T
            du = dh * (1 - h * h)
            grads = {"c": pooled.T @ dz, "d": np.array([dz.sum()]), "a": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "W": x.T @ du, "b": du.sum(0)}
            step += 1
            for k in p:
                q = grads[k] + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * q
                m2[k] = 0.999 * m2[k] + 0.001 * q * q
                p[k] -= now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS) -> Model:
    """Fit on at most ``max_docs`` labelled rows that are not held out. Without labels the score is 0.5 everywhere."""
    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            found = passages([t.encode() for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "label", "features"])

    # about a quarter of the sampled text in size
    rows = sample(docs, labels, label, max_docs).mapInArrow(run, "doc_id bigint, label int, features binary").toPandas().sort_values("doc_id", ignore_index=True)
    bags = [np.frombuffer(f, dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64) for f in rows["features"]]
    return fit_bags(bags, rows["label"].to_numpy(dtype=np.float64))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Scores depend on the text alone: lang, source, n_chars and ids are never read, columns with other names are
    ignored. Null and empty texts are one empty passage; repeated rows get equal scores; an empty table gives none.
    """
    return scored(docs, train(docs, labels, label, max_docs).score, cut)


def keep(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts (score >= ``cut``), with all their columns."""
    return passing(docs, train(docs, labels, label, max_docs).score, cut)
