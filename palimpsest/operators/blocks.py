"""Rows about pairs of documents, streamed past the sentences of both.

Documents fall into blocks. A task holds the sentences of two blocks as arrays and reads the rows of their pairs batch by
batch, so what belongs to a pair (its weights, above all) is never a row of an exchange, and memory follows the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a block; a task holds two.
BLOCK_WORDS = 3_000_000
#: Words of the sentences that a step of a kernel looks at.
STEP_WORDS = 1_000_000

_SENTENCE = ["__doc", "__sent", "__start", "__end", "__words"]


class Block:
    """Sentences of some documents (none of them common) in order of document and place, and their distinct words."""

    def __init__(self, doc, sent, start, end, words):
        order = np.lexsort((sent, doc))
        self.docs, self.doc_at, self.n_sents = np.unique(doc[order], return_index=True, return_counts=True)
        self.sent, self.start, self.end = sent[order].astype(np.int64), start[order], end[order]
        self.wide = int(self.sent.max(initial=0)) + 1
        self.doc_of = np.repeat(np.arange(len(self.docs)), self.n_sents)
        self.places = self.doc_of * self.wide + self.sent
        self.chars = np.concatenate([[0], np.cumsum(self.end - self.start)])
        parts = pc.split_pattern(words.take(pa.array(order)), "\n")
        coded = parts.flatten().dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(by_name), np.int64)
        rank[by_name.to_numpy()] = np.arange(len(by_name))
        self.names, self.n_names = coded.dictionary.take(by_name), max(1, len(by_name))
        self.size = pc.utf8_length(self.names).to_numpy().astype(np.int64)
        self.word = rank[coded.indices.to_numpy()]  # in order; a name's number follows the order of names
        self.word_at = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
        self.bag, self.tf = np.unique(np.repeat(np.arange(len(order)), np.diff(self.word_at)) * self.n_names + self.word, return_counts=True)
        row, self.lemma = np.divmod(self.bag, self.n_names)
        self.bag_at = np.searchsorted(row, np.arange(len(order) + 1))
        self.vocab, back, self.sf = np.unique(self.doc_of[row] * self.n_names + self.lemma, return_inverse=True, return_counts=True)
        self.own_sf = self.sf[back]

    def doc(self, ids) -> np.ndarray:
        return np.searchsorted(self.docs, ids)

    def has(self, ids) -> np.ndarray:
        return self.docs[np.minimum(self.doc(ids), len(self.docs) - 1)] == ids

    def row(self, docs, sents) -> tuple[np.ndarray, np.ndarray]:
        """(rows of sentences by their documents' numbers and their indices, whether there is such a one)."""
        wanted = docs * self.wide + sents
        at = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
        return at, self.places[at] == wanted

    def covered(self, docs, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """Rows from, to (without) of the positions lo to hi among a document's sentences."""
        n, at = self.n_sents[docs], self.doc_at[docs]
        return at + np.minimum(lo, n), at + np.minimum(hi + 1, n)

    def isf(self, own_sf, docs, others, lemma) -> np.ndarray:
        """ln(N / sf) over both documents of words that a document has ``own_sf`` times."""
        wanted = others * self.n_names + lemma
        at = np.minimum(np.searchsorted(self.vocab, wanted), len(self.vocab) - 1)
        return np.log((self.n_sents[docs] + self.n_sents[others]) / (own_sf + np.where(self.vocab[at] == wanted, self.sf[at], 0)))


def spread(first, last) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of all places in ranges [first, last)."""
    n = np.maximum(last - first, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def steps(sizes) -> Iterator[slice]:
    """Slices of rows with about ``STEP_WORDS`` words each, of one row at least."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_WORDS, "right")))
        yield slice(at, to)
        at = to


def cosines(block: Block, d1, d2, rows1, rows2) -> tuple[np.ndarray, np.ndarray]:
    """(cosine, number of common words) of the summed weights of two ranges of sentences, for each pair of documents."""
    out, common = np.zeros(len(d1)), np.zeros(len(d1), np.int64)
    for s in steps(np.maximum(1, block.bag_at[rows1[1]] - block.bag_at[rows1[0]] + block.bag_at[rows2[1]] - block.bag_at[rows2[0]])):
        a, b, n, bags = d1[s], d2[s], s.stop - s.start, []
        for first, last in (rows1, rows2):
            pair, at = spread(block.bag_at[first[s]], block.bag_at[last[s]])
            key, tf, sf = pair * block.n_names + block.lemma[at], block.tf[at], block.own_sf[at]
            if (last[s] - first[s] > 1).any():  # several sentences
                key, some, back = np.unique(key, return_index=True, return_inverse=True)
                tf, sf = np.bincount(back, tf), sf[some]
            bags.append((key, tf, sf, *np.divmod(key, block.n_names)))
        (k1, t1, f1, p1, l1), (k2, t2, f2, p2, l2) = bags
        if not len(k1) or not len(k2):
            continue
        i1 = block.isf(f1, a[p1], b[p1], l1)
        at = np.minimum(np.searchsorted(k1, k2), len(k1) - 1)
        shared, i2 = k1[at] == k2, i1[at]
        i2[~shared] = block.isf(f2[~shared], b[p2[~shared]], a[p2[~shared]], l2[~shared])
        w1, w2 = t1 * i1, t2 * i2
        norms = np.sqrt(np.bincount(p1, w1 * w1, n)) * np.sqrt(np.bincount(p2, w2 * w2, n))
        dot = np.bincount(p2[shared], w1[at[shared]] * w2[shared], n)
        out[s] = np.divide(dot, norms, out=np.zeros(n), where=norms > 0)
        common[s] = np.bincount(p2[shared], minlength=n)
    return out, common


def beside(rows: DataFrame, sents: DataFrame, kernel: Callable[[Block, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, words: str = "lemmas") -> DataFrame:
    """What ``kernel`` makes of batches of ``rows`` (doc1, doc2, and more) beside the sentences of both documents.

    A row meets its sentences in the task of its two blocks; sentences are sent once for each block.
    """
    own = sents.where(~F.col("is_common")).select(F.col("doc_id").alias("__doc"), F.col("sent_idx").alias("__sent"), F.col("start_char").alias("__start"), F.col("end_char").alias("__end"), F.array_join(words, "\n").alias("__words"))
    total = own.agg(F.sum(F.length("__words") - F.length(F.replace("__words", F.lit("\n"))) + 1)).first()[0] or 0
    n = max(4, -(-total // BLOCK_WORDS))
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(n)).cast("int")
    both = lambda x, y: (F.least(x, y) * n + F.greatest(x, y)).cast("int")
    x, y = block("doc1"), block("doc2")
    names = rows.columns
    left = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(both(block("__doc"), F.col("__other")).alias("__key"), F.lit(0).alias("__kind"), *_SENTENCE, *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    right = rows.select(both(x, y).alias("__key"), F.lit(1).alias("__kind"), *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in _SENTENCE], *names)
    lo, hi = F.floor(F.col("__key") / n), F.col("__key") % n
    task = (lo * n - F.floor(lo * (lo - 1) / 2) + hi - lo).cast("int")
    dealt = left.unionByName(right).repartitionById(n * (n + 1) // 2, task).sortWithinPartitions("__key", "__kind", "doc1", "doc2")
    wanted = [f.name for f in rows.schema]

    def run(batches):
        held, key, now = [], None, None
        for b in batches:
            keys, kinds = b.column("__key").to_numpy(), b.column("__kind").to_numpy()
            edges = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if keys[lo] != key:
                    held, key, now = [], keys[lo], None
                if kinds[lo] == 0:
                    held.append(part.select(_SENTENCE))
                    continue
                if now is None and not held:
                    continue  # no sentences, so nothing to say about any pair
                if now is None:
                    some = pa.Table.from_batches(held).combine_chunks()
                    held, now = [], Block(*(some[c].to_numpy() for c in _SENTENCE[:4]), some["__words"].combine_chunks())
                known = [now.has(part.column(c).to_numpy()) for c in ("doc1", "doc2")]
                yield from kernel(now, part.select(wanted).filter(pa.array(known[0] & known[1])))

    return dealt.mapInArrow(run, schema)
