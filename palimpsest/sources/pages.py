"""Saved web pages as documents."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DROP = r"(?is)<(script|style|head|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def visible_text(html: Column) -> Column:
    """Text outside markup, white space collapsed; the basic entities are decoded. A regex chain, JVM-side."""
    out = F.regexp_replace(html, _DROP, " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def page_name(url: Column) -> Column:
    """The host, or the last path segment, `_from_` and the host; characters that files can't have go."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    host = F.regexp_extract(bare, r"^([^/]*)", 1)
    last = F.regexp_extract(bare, r"^[^/]*/(?:.*/)?([^/]+)/*$", 1)
    return F.regexp_replace(F.when(last == "", host).otherwise(F.concat(last, F.lit("_from_"), host)), r"[^A-Za-z0-9._-]", "")


def page_documents(pages: DataFrame, least: int = 2000) -> DataFrame:
    """page_id, name, url, text of pages whose text has ``least`` characters or more, equal texts once (least page_id)."""
    rows = pages.where("html is not null").select("page_id", F.concat(page_name(F.col("url")), F.lit(".txt")).alias("name"), "url", visible_text(F.col("html")).alias("text")).where(F.length("text") >= least)
    first = rows.groupBy(F.sha2("text", 256).alias("k")).agg(F.min("page_id").alias("page_id"))
    return rows.join(first.select("page_id"), "page_id", "left_semi")


#: File name endings of content types.
_ENDINGS = {"application/pdf": ".pdf", "application/json": ".json", "application/xml": ".xml", "application/zip": ".zip", "application/msword": ".doc", "text/plain": ".txt", "text/csv": ".csv", "text/xml": ".xml", "text/css": ".css"}

Fetch = Callable[[str], "tuple[bytes, str | None] | None"]


def fetched(urls: DataFrame, fetch: Fetch) -> DataFrame:
    """url, content, content_type of the distinct addresses that ``fetch`` answers; it gives None for the others.

    Each task fetches its addresses one by one; ``fetch`` handles its own errors and time limits.
    """

    def run(batches):
        for b in batches:
            for url in b.column("url").to_pylist():
                got = fetch(url)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([url], pa.string()), pa.array([got[0]], pa.binary()), pa.array([got[1]], pa.string())], names=["url", "content", "content_type"])

    return urls.where("url is not null").select("url").distinct().mapInArrow(run, "url string, content binary, content_type string")


def page_files(pages: DataFrame, least: int = 2000) -> DataFrame:
    """url, name, text, content of fetched pages: HTML as its visible text, other text as it is, the rest as bytes.

    A missing content type is HTML. Pages under ``least`` characters (bytes) are left out, and equal contents but one.
    """
    kind = F.coalesce(F.lower(F.regexp_extract(F.coalesce("content_type", F.lit("text/html")), r"^\s*([^;\s]*)", 1)), F.lit("text/html"))
    is_html, is_text = F.col("kind").startswith("text/html"), F.col("kind").startswith("text")
    raw = F.decode("content", "UTF-8")
    ending = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in _ENDINGS.items() for x in item]), F.col("kind")), F.lit(""))
    rows = pages.where("content is not null").withColumn("kind", kind).select(
        "url", F.concat(page_name(F.col("url")), F.when(is_html, F.lit(".txt")).otherwise(ending)).alias("name"), F.when(is_html, visible_text(raw)).when(is_text, raw).alias("text"), F.when(~is_text, F.col("content")).alias("content")
    )
    rows = rows.where(F.coalesce(F.length("text"), F.length("content")) >= least)
    first = rows.groupBy(F.coalesce(F.sha2("text", 256), F.sha2("content", 256)).alias("k")).agg(F.min("url").alias("url"))
    return rows.join(first.select("url"), "url", "left_semi")
