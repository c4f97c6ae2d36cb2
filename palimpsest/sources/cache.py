"""Prepared sentences kept from run to run, apart for each set of common documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import is_folder


def common_key(common: DataFrame | None) -> str:
    """A name for a set of common documents, whatever their order; 'none' without any."""
    if common is None:
        return "none"
    texts = common.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("k")).distinct()
    total = texts.agg(F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return f"{total['n']}-{total['s'] or 0}"


def load(spark: SparkSession, folder: str, key: str, like: DataFrame) -> DataFrame:
    """What was saved under ``key``, or no rows of ``like``'s columns where there is nothing."""
    path = f"{folder}/common_key={key}"
    return spark.read.schema(like.schema).parquet(path) if is_folder(spark, path) else like.limit(0)


def save(rows: DataFrame, folder: str, key: str) -> None:
    """Replace what is saved under ``key``. ``rows`` must not be read from there: cut their lineage first."""
    rows.write.mode("overwrite").parquet(f"{folder}/common_key={key}")
