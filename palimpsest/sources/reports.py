"""Written reports read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc1 bigint, doc2 bigint, name1 string, name2 string, n_matches bigint, matches array<struct<match_type:int,start1:int,end1:int,start2:int,end2:int>>"


def read_json(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with their matches, one JSON object a line; lines that are no such object are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder).where("doc1 is not null and doc2 is not null")


def matches(reports: DataFrame) -> DataFrame:
    """One row for each match of the reports."""
    return reports.selectExpr("doc1", "doc2", "inline(matches)")
