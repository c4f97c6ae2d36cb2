"""Texts written as files of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def to_save(new: DataFrame, existing: DataFrame) -> DataFrame:
    """name, text of ``new`` whose text no existing file has; equal texts once, a name that is taken gets _1, _2 and so on.

    Both have name and text. Numbers go on after the highest that the folder has for a name.
    """
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    fresh = new.select("name", "text", key.alias("k")).join(existing.select(key.alias("k")), "k", "left_anti")
    once = fresh.groupBy("k").agg(F.min(F.struct("name", "text")).alias("f")).select("k", "f.*")
    stem, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    number = F.regexp_extract("name", r"_(\d+)(?:\.[^.]*)?$", 1)
    parts = existing.select("name").union(existing.where(number != "").select(F.concat(F.regexp_replace(stem, r"_\d+$", ""), ext).alias("name")))
    highest = existing.where(number != "").groupBy(F.concat(F.regexp_replace(stem, r"_\d+$", ""), ext).alias("name")).agg(F.max(number.cast("int")).alias("top"))
    taken = parts.distinct().join(highest, "name", "left").select("name", (F.coalesce("top", F.lit(0)) + 1).alias("base"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("k")) - 1
    rows = once.withColumn("place", place).join(taken, "name", "left").withColumn("n", F.col("place") + F.coalesce("base", F.lit(0)))
    return rows.select(F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("n").cast("string"), ext)).alias("name"), F.coalesce("text", F.lit("")).alias("text"))


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def save(rows: DataFrame, folder: str) -> int:
    """Write each row's text as UTF-8 under its name, one at a time from the driver, through Spark's file systems."""
    spark = rows.sparkSession
    parent, files = _files(spark, folder)
    files.mkdirs(parent)
    n = 0
    for r in rows.select("name", "text").toLocalIterator():
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(parent, r["name"]), True)
        try:
            out.write(bytearray(r["text"].encode()))
        finally:
            out.close()
        n += 1
    return n


def remove(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Delete files; those that are missing don't matter."""
    parent, files = _files(spark, folder)
    for name in names:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(parent, name), False)
