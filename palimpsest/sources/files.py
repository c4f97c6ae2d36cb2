"""Folders of files as documents. Files are read and decoded on the executors, through Spark's own file readers."""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T

#: Bytes that decide whether a file is text.
SNIFFED = 2048
#: Suffix of caches, which are no documents.
CACHE_SUFFIX = ".pdef"
_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_CONTROL = bytes(b for b in range(32) if b not in b"\t\n\x0b\x0c\r\x1b")

PdfReader = Callable[[bytes], "list[str] | None"]


def is_folder(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.exists(path) and files.getFileStatus(path).isDirectory()


def scan(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, name, content of each file in ``folder`` (and below it, if ``recursive``).

    Anything but a folder is an error. Files without a byte hold no text and aren't read.
    """
    if not is_folder(spark, folder):
        raise NotADirectoryError(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not recursive:
        files = files.option("pathGlobFilter", "*")
    return files.load(folder).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")


def is_binary(content: bytes) -> bool:
    """Whether the first bytes are no text: control characters or NULs, unless a byte order mark explains them."""
    head = content[:SNIFFED]
    return not any(head.startswith(mark) for mark, _ in _BOMS) and any(b in _CONTROL for b in head)


def decode(content: bytes) -> str | None:
    """Composed text by the byte order mark, else UTF-8, else Windows-1252; None where none of them fits."""
    for name in [*(n for mark, n in _BOMS if content.startswith(mark)), "utf-8", "cp1252"]:
        try:
            return unicodedata.normalize("NFC", content.decode(name))
        except UnicodeDecodeError:
            continue
    return None


def pdf_text(pages: list[str]) -> str:
    """The pages that hold text, joined by blanks, with words mended that were hyphenated at a line's end."""
    return re.sub(r"-\s?\n", "", unicodedata.normalize("NFC", " ".join(p for p in pages if p)))


def files_with_text(files: DataFrame, pdf: PdfReader | None = None) -> DataFrame:
    """path, name, text, problem of scanned files; ``text`` is null where ``problem`` says why.

    ``pdf`` turns a PDF's bytes into its pages' texts, or None where it is locked; without it PDFs have no text.
    """

    def run(batches):
        for whole in batches:
            for at in range(whole.num_rows):  # one file's text at a time
                content, name = whole.column("content")[at].as_py() or b"", whole.column("name")[at].as_py() or ""
                text, problem = None, None
                if name.lower().endswith(CACHE_SUFFIX):
                    problem = "cache"
                elif content.startswith(b"%PDF"):
                    pages = pdf(content) if pdf else None
                    text, problem = (None, "locked PDF" if pdf else "no PDF reader") if pages is None else (pdf_text(pages), None)
                elif is_binary(content):
                    problem = "binary"
                else:
                    text = decode(content)
                    problem = "unknown encoding" if text is None else None
                yield pa.RecordBatch.from_arrays([whole.column("path").slice(at, 1), whole.column("name").slice(at, 1), pa.array([text], pa.string()), pa.array([problem], pa.string())], names=["path", "name", "text", "problem"])

    return files.select("path", "name", "content").mapInArrow(run, "path string, name string, text string, problem string")


def documents(files: DataFrame, pdf: PdfReader | None = None) -> DataFrame:
    """doc_id, name, path, text, urls: the files that hold text, equal texts once (the least path's).

    doc_id is a hash of the path, so a file keeps it from run to run.
    """
    rows = files_with_text(files, pdf).where("problem is null")
    first = rows.groupBy(F.sha2("text", 256).alias("k")).agg(F.min("path").alias("path")).select("path")
    return rows.join(first, "path", "left_semi").select(F.xxhash64("path").alias("doc_id"), "name", "path", "text", T.urls(F.col("text")).alias("urls"))


def skipped(files: DataFrame, pdf: PdfReader | None = None) -> DataFrame:
    """path, problem of the files that give no document."""
    return files_with_text(files, pdf).where("problem is not null").select("path", "problem")


def links(uris: DataFrame) -> DataFrame:
    """Distinct http(s) addresses of a column ``uri``, normalised as those in texts are."""
    web = uris.where(F.col("uri").isNotNull() & ~F.col("uri").rlike(r"(?i)^(?!https?:)[a-z][a-z0-9+.-]*:"))
    return web.select(T.normalise_url(F.col("uri")).alias("url")).distinct()


def pair(docs: DataFrame, first: int, second: int) -> DataFrame:
    """The two documents of a pair."""
    return docs.where(F.col("doc_id").isin(first, second))
