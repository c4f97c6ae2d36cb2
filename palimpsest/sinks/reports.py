"""Matches as JSON lines, as a readable report, and as sorted views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import matches as M

NOTHING = "No matches found."


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (doc1, doc2, ...) with name1 and name2: the documents' names, or their ids where they have none."""
    name = F.coalesce(F.col("name"), F.col("doc_id").cast("string")) if "name" in docs.columns else F.col("doc_id").cast("string")
    own = docs.select("doc_id", name.alias("name"))
    side = lambda i: own.select(F.col("doc_id").alias(f"doc{i}"), F.col("name").alias(f"name{i}"))
    return rows.join(side(1), "doc1", "left").join(side(2), "doc2", "left")


def write_json(matches: DataFrame, docs: DataFrame, folder: str) -> None:
    """One JSON object for each pair with its names and matches; texts and sentences are not written."""
    named(M.nested(matches), docs).write.mode("overwrite").json(folder)


def _fragment(start: str, end: str) -> Column:
    return F.format_string("Fragment(%d, %d)", start, end)


def report_lines(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """line: headings of types, their pairs, and the pairs' matches by the first document's start, in that order."""
    rows = named(matches, docs).select("match_type", "doc1", "doc2", "name1", "name2", "start1", "end1", "start2", "end2")
    item = F.concat(F.lit("    Match("), _fragment("start1", "end1"), F.lit(", "), _fragment("start2", "end2"), F.lit(")"))
    order = ["match_type", "level", "name1", "name2", "doc1", "doc2", "below", "start1", "end1", "start2", "end2"]
    one = rows.select("match_type", F.lit(1).alias("level"), "name1", "name2", "doc1", "doc2", F.lit(1).alias("below"), "start1", "end1", "start2", "end2", item.alias("line"))
    none = [F.lit(None).cast("int").alias(c) for c in ("start1", "end1", "start2", "end2")]
    pair = F.format_string("  Pair('%s', '%s'):", F.col("name1"), F.col("name2"))
    pairs = rows.select("match_type", "doc1", "doc2", "name1", "name2").distinct().select("match_type", F.lit(1).alias("level"), "name1", "name2", "doc1", "doc2", F.lit(0).alias("below"), *none, pair.alias("line"))
    kinds = rows.select("match_type").distinct()
    heading = F.concat(F.initcap(M.label(F.col("match_type"))), F.lit(" matches:"))
    heads = kinds.select("match_type", F.lit(0).alias("level"), *[F.lit(None).cast("string").alias(c) for c in ("name1", "name2")], *[F.lit(None).cast("bigint").alias(c) for c in ("doc1", "doc2")], F.lit(0).alias("below"), *none, heading.alias("line"))
    return heads.unionByName(pairs).unionByName(one).orderBy(*order).select("line")


def text_report(matches: DataFrame, docs: DataFrame) -> str:
    """The whole report as text for a reader; as many lines as there are matches, pairs and types. Write larger ones with ``write_text``."""
    n = matches.select("doc1", "doc2").distinct().count()
    if not n:
        return NOTHING
    lines = [r["line"] for r in report_lines(matches, docs).toLocalIterator()]
    return "\n".join([f"There are matches in {n} document pair{'s' if n > 1 else ''}:", *lines]) + "\n"


def write_text(matches: DataFrame, docs: DataFrame, folder: str) -> None:
    """The report's lines as text files whose names sort in the report's order."""
    report_lines(matches, docs).write.mode("overwrite").text(folder)


def results_view(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """label, name1, name2 (in order of names), the spans, and ``place`` of each match within its type."""
    rows = named(matches, docs)
    swap = F.col("name2") < F.col("name1")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a)
    turned = rows.select(M.label(F.col("match_type")).alias("label"), *[pick(f"{c}1", f"{c}2") for c in ("name", "doc", "start", "end")], *[pick(f"{c}2", f"{c}1") for c in ("name", "doc", "start", "end")])
    # one type's places are counted over all its rows; the view is a reader's, by pages
    order = Window.partitionBy("label").orderBy("name1", "name2", "doc1", "doc2", "start1", "start2", "end1", "end2")
    return turned.withColumn("place", F.row_number().over(order))


def page(view: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of a view with ``place``."""
    return view.where((F.col("place") > number * size) & (F.col("place") <= (number + 1) * size))
