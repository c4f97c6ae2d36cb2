"""Alike sentences of different documents: dice first by a prefix filter, then the pair's own cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.lineage import cut

from .blocks import beside, cosines, spread, steps


def document_pairs(docs: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """(doc1, doc2): unordered pairs of documents, and documents with archive ones whose text isn't among theirs."""
    ids = docs.select("doc_id")
    pairs = ids.select(F.col("doc_id").alias("doc1")).join(ids.select(F.col("doc_id").alias("doc2")), F.col("doc1") < F.col("doc2"))
    if archive is None:
        return pairs
    rest = exclude_known(archive, docs).select(F.col("doc_id").alias("doc2"))
    return pairs.unionByName(ids.select(F.col("doc_id").alias("doc1")).join(rest))


def exclude_known(archive: DataFrame, docs: DataFrame) -> DataFrame:
    """Archive documents whose text no document has."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    return archive.withColumn("__k", key).join(docs.select(key.alias("__k")), "__k", "left_anti").drop("__k")


def known(archive: DataFrame, docs: DataFrame) -> DataFrame:
    """Archive documents whose text a document has."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    return archive.withColumn("__k", key).join(docs.select(key.alias("__k")), "__k", "left_semi").drop("__k")


#: Members of a group that meet in one task, about.
_CHUNK = 1024


def _ranked(groups: DataFrame) -> DataFrame:
    """(gid, o): each group's lemmas as numbers in order, those of rare lemmas first."""
    tokens = groups.select("gid", "m", F.explode("set").alias("lemma"))
    frequency = tokens.groupBy("lemma").agg(F.sum("m").alias("f"))
    ranks = cut(frequency.sort("f", "lemma").select("lemma", F.monotonically_increasing_id().alias("x")))
    return tokens.join(ranks, "lemma").groupBy("gid").agg(F.array_sort(F.collect_list("x")).alias("o"))


def _signature(shift: int):
    """64 bits: some bit for each number of ``o``."""
    return F.aggregate("o", F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(x, shift).bitwiseAND(63).cast("int"))))


def _alike(groups: DataFrame, d: int) -> DataFrame:
    """(gid1, gid2, n_common, n1, n2) of different sets with dice > d / 1000, gid1 < gid2.

    Sets meet on their prefixes and are compared where they meet: candidates are no rows of an exchange. A pair counts
    where its first shared lemma is, so it is found once.
    """
    t = d / (2000 - d)
    n = F.size("o")
    sized = cut(_ranked(groups).withColumns({"n": n, "p": F.least(n, n - F.ceil(n * t - 1e-9).cast("int") + 1) if d > 0 else n, "u": _signature(0), "v": _signature(6)}))
    prefix = sized.select("gid", "n", "u", "v", "o", F.posexplode(F.slice("o", 1, F.col("p"))).alias("r", "x"))
    a, b = (prefix.select("x", *[F.col(c).alias(f"{c}{i}") for c in ("gid", "n", "r", "u", "v", "o")]) for i in (1, 2))
    least = d * (F.col("n1") + F.col("n2"))
    length = F.least("n1", "n2") >= t * F.greatest("n1", "n2") - 1e-9
    place = 2000 * F.least(F.col("n1") - F.col("r1"), F.col("n2") - F.col("r2")) > least
    apart = lambda i, c: F.bit_count(F.col(f"{c}{i}").bitwiseAND(F.bitwise_not(f"{c}{3 - i}")))
    fits = [2000 * (F.col(f"n{i}") - apart(i, c)) > least for c in ("u", "v") for i in (1, 2)]  # each bit that the other lacks is a lemma that it lacks
    met = a.join(b, "x").where((F.col("gid1") < F.col("gid2")) & length & place & fits[0] & fits[1] & fits[2] & fits[3])
    shared = F.array_intersect("o1", "o2")
    return met.where((F.element_at(shared, 1) == F.col("x")) & (2000 * F.size(shared) > least)).select("gid1", "gid2", F.size(shared).alias("n_common"), "n1", "n2")


def dice_pairs(sents: DataFrame, above: float = 0.6) -> DataFrame:
    """(doc1, sent1, doc2, sent2, n_common, n1, n2) of sentences with dice > ``above``, doc1 < doc2.

    Sentences with equal sets of lemmas are one group. Groups are joined on a prefix of their rarest lemmas: sets of
    sizes n1, n2 with dice > d share more than d / 2 * (n1 + n2) lemmas, and the jaccard similarity exceeds
    d / (2 - d), so n - ceil(t * n) + 1 lemmas of each are enough. Lengths cut candidates before the sets are
    compared, and so do positions (at the first lemma that two sets share, what is left of both must be enough) and
    bits of the sets. Thresholds are compared as integers of a thousandth. With a column is_archive, sentences of two
    archive documents don't meet, and the archive document of a pair is doc2.
    """
    d = round(above * 1000)
    archived = F.col("is_archive") if "is_archive" in sents.columns else F.lit(False)
    own = sents.where(~F.col("is_common")).select(F.struct(archived.alias("is_archive"), "doc_id", "sent_idx").alias("s"), F.array_sort(F.array_distinct("lemmas")).alias("set"))
    key = F.sha2(F.array_join("set", "\n"), 256)
    groups = cut(own.groupBy("set").agg(F.count("*").alias("m"), F.min("s.doc_id").alias("lo"), F.max("s.doc_id").alias("hi")).withColumns({"gid": F.monotonically_increasing_id(), "k": key}))
    members = cut(own.select("s", key.alias("k")).join(groups.select("k", "gid", "m", "lo", "hi", F.size("set").alias("n")), "k").drop("k"))
    side = lambda i: members.select(F.col("gid").alias(f"gid{i}"), F.col("s").alias(f"s{i}"))
    across = _alike(groups, d).join(side(1), "gid1").join(side(2), "gid2").select("s1", "s2", "n_common", "n1", "n2")
    chunks = F.ceil(F.col("m") / _CHUNK).cast("int")
    twins = members.where("lo < hi")
    first = twins.select("gid", F.pmod(F.xxhash64("s.doc_id", "s.sent_idx"), chunks).cast("int").alias("c"), F.col("s").alias("s1"), F.col("n").alias("n1"))
    second = twins.select("gid", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("c"), F.col("s").alias("s2"))
    equal = first.join(second, ["gid", "c"]).where("s1 < s2 and s1.doc_id <> s2.doc_id").select("s1", "s2", F.col("n1").alias("n_common"), "n1", F.col("n1").alias("n2"))
    if d >= 1000:
        equal = equal.where(F.lit(False))
    swap = F.col("s1") > F.col("s2")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    both = across.where("s1.doc_id <> s2.doc_id").unionByName(equal).where("not (s1.is_archive and s2.is_archive)")
    return both.select(
        pick("s1.doc_id", "s2.doc_id").alias("doc1"), pick("s1.sent_idx", "s2.sent_idx").alias("sent1"), pick("s2.doc_id", "s1.doc_id").alias("doc2"), pick("s2.sent_idx", "s1.sent_idx").alias("sent2"), "n_common", pick("n1", "n2").alias("n1"), pick("n2", "n1").alias("n2")
    )


def weights(pairs: DataFrame, sents: DataFrame, side: int) -> DataFrame:
    """(doc1, doc2, sent, lemma, w) of the sentences of one side that ``pairs`` (doc1, doc2, sent) names.

    w = tf * ln(N / sf): N counts the sentences of both documents, sf those of both that have the lemma.
    """

    def kernel(block, b):
        doc1, doc2, sent = (b.column(c).to_numpy() for c in ("doc1", "doc2", "sent"))
        docs, others = block.doc(doc1), block.doc(doc2)
        if side == 2:
            docs, others = others, docs
        row, there = block.row(docs, sent)
        doc1, doc2, sent, docs, others, row = (x[there] for x in (doc1, doc2, sent, docs, others, row))
        for s in steps(block.bag_at[row + 1] - block.bag_at[row]):
            pair, at = spread(block.bag_at[row[s]], block.bag_at[row[s] + 1])
            w = block.tf[at] * block.isf(block.own_sf[at], docs[s][pair], others[s][pair], block.lemma[at])
            yield pa.RecordBatch.from_arrays([pa.array(doc1[s][pair]), pa.array(doc2[s][pair]), pa.array(sent[s][pair], pa.int32()), block.names.take(pa.array(block.lemma[at])), pa.array(w)], names=["doc1", "doc2", "sent", "lemma", "w"])

    return beside(pairs.select("doc1", "doc2", "sent"), sents, kernel, "doc1 bigint, doc2 bigint, sent int, lemma string, w double")


def seeds(sents: DataFrame, min_cos: float = 0.6, min_dice: float = 0.6) -> DataFrame:
    """(doc1, doc2, sent1, sent2, cos, dice) with cos > ``min_cos`` and dice > ``min_dice``.

    Only pairs of sentences that survive dice are weighted, in the task that has the words of both documents.
    """

    def kernel(block, b):
        doc1, doc2, sent1, sent2 = (b.column(c).to_numpy() for c in ("doc1", "doc2", "sent1", "sent2"))
        d1, d2 = block.doc(doc1), block.doc(doc2)
        (r1, _), (r2, _) = block.row(d1, sent1), block.row(d2, sent2)
        cos, common = cosines(block, d1, d2, (r1, r1 + 1), (r2, r2 + 1))
        dice = 2 * common / (np.diff(block.bag_at)[r1] + np.diff(block.bag_at)[r2])
        keep = cos > min_cos
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc1, doc2, sent1, sent2, cos, dice)], names=["doc1", "doc2", "sent1", "sent2", "cos", "dice"])

    return beside(dice_pairs(sents, min_dice).select("doc1", "doc2", "sent1", "sent2"), sents, kernel, "doc1 bigint, doc2 bigint, sent1 int, sent2 int, cos double, dice double")
