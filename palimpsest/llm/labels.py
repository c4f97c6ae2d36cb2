"""Labelled samples and model scoring shared by the two classifiers."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut
from .streams import slices

#: Text that a fit reads at most, in bytes; together with the number of rows this bounds all that the driver gathers.
MAX_BYTES = 64 << 20


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; such rows' labels are never learned. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def held_out_id(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, label, text) of training rows in the order of their ids' hashes, the same rows at every run.

    As many as ``most`` rows and ``most_bytes`` of text allow, always whole texts, and one row at least. Rows without id,
    text or a 0/1 label teach nothing. Of repeated ids one row counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    place = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = known.withColumn("place", place).orderBy("place", "doc_id").limit(most)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    rows = cut(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "place").agg(F.min("label").alias("label"), F.min("text").alias("text")))
    upto = F.sum("size").over(Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fit = rows.select("doc_id", "place", F.octet_length("text").cast("bigint").alias("size")).withColumn("upto", upto).where((F.col("upto") <= most_bytes) | (F.col("upto") == F.col("size")))
    return rows.join(F.broadcast(fit.select("doc_id")), "doc_id", "left_semi").select("doc_id", "label", "text")


def scored(docs: DataFrame, score, cut: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; ``score`` maps a list of texts (bytes) to numbers.

    Only the text reaches ``score``. A null text counts as the empty one. Rows are neither joined nor dropped.
    """

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            ids = b.column("doc_id").to_pylist()
            s = score([(t or "").encode() for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([held_out_id(i) for i in ids], pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= cut) for x in s], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def passing(docs: DataFrame, score, cut: float) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``cut``, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, at)):
            s = score([(t or "").encode() for t in b.column(at).to_pylist()])
            yield b.filter(pa.array([x >= cut for x in s], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
