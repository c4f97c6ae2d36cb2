"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window of an item occurs in a document only if all of its words do, in order. So it is enough to look where
its rarest word stands (the necessary prefix when the overlap must be the whole window): words are ordered by
their corpus counts, each window is keyed by its rarest word and that word's offset, documents' words are
joined with those keys, the offset and the lengths bound where the window may start, and the words there are
compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

WINDOW = 8
#: Windows of all items (rows, and bytes of their words) up to which what is made of them is broadcast. Both bound every
#: table sent: keys and the vocabulary hold no more words than the windows. Beyond either both sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose A-Z are still there.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of ASCII digits, letters and all characters beyond ASCII, A-Z lower-cased; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), _SPLIT), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win, len): the distinct windows of each item, words joined by spaces. Items without id or words have none."""
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1)), lambda i: F.slice("w", i, window))
    return items.select("item_id", F.explode(parts).alias("x")).select("item_id", F.array_join("x", " ").alias("win"), F.size("x").alias("len")).distinct()


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, w: ``row`` tells texts of a repeated id apart; equal rows share it and so their results."""
    return docs.select(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row"), words(F.col("text")).alias("w"))


def occurrences(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """(doc_id, row, start, len, win) of every window in every document; ``windows``: distinct (win, len)."""
    hint = F.broadcast if small else lambda df: df
    split = windows.withColumn("w", F.split("win", " "))
    vocabulary = split.select(F.explode("w").alias("word")).distinct()
    seen = docs.select(F.explode(words(F.col("text"))).alias("word")).join(hint(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = split.select("win", "len", F.posexplode("w").alias("off", "word")).join(hint(seen), "word", "left")
    best = ranked.groupBy("win", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")).alias("k")).where("k.n > 0")  # a word in no document: neither is the window
    keys = best.select("win", "len", F.col("k.word").alias("word"), F.col("k.off").alias("off"))
    rows = _rows(docs)
    inside = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n_words"))
    exact = F.array_join(F.slice("w", F.col("start") + 1, F.col("len")), " ") == F.col("win")
    if small:
        at = rows.select("doc_id", "row", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
        found = at.join(F.broadcast(keys), "word").where(inside).withColumn("start", F.col("pos") - F.col("off")).where(exact)
    else:
        at = rows.select("doc_id", "row", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
        near = at.join(keys, "word").where(inside).select("doc_id", "row", (F.col("pos") - F.col("off")).alias("start"), "len", "win")
        found = near.withColumnRenamed("doc_id", "d").join(rows, (F.col("d").eqNullSafe(F.col("doc_id"))) & (near["row"] == rows["row"])).drop(near["row"]).where(exact)
    return found.select("doc_id", "row", "start", "len", "win")


def _prepared(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(found windows, windows of items, hinted to be broadcast where they are small); both written to the shared folder."""
    of_item = cut(item_windows(benchmark, window))
    rows, size = of_item.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("win").cast("bigint")), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    found = cut(occurrences(docs, of_item.select("win", "len").distinct(), small))
    return found, F.broadcast(of_item) if small else of_item


def _items(found: DataFrame, of_item: DataFrame) -> DataFrame:
    """(doc_id, row, item_id): the items with a window in each document, once."""
    return found.select("doc_id", "row", "win").distinct().join(of_item.select("win", "item_id"), "win").select("doc_id", "row", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    n_hit counts words inside any occurrence of a window, n_items the items with occurring windows, the digest is of
    their sorted ids; contaminated where n_items >= ``items``. Null, empty and word-less texts have no words;
    rows with a null or repeated id are kept, each judged by its own text; an empty benchmark hits nothing.
    Other columns are not read.
    """
    found, of_item = _prepared(docs, benchmark, window)
    spread = F.flatten(F.transform("places", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))
    hit = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "len")).alias("places")).select("doc_id", "row", F.size(F.array_distinct(spread)).cast("bigint").alias("n_hit"))
    names = _items(found, of_item).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    names = names.select("doc_id", "row", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    key = lambda df, d, r: df.withColumnRenamed("doc_id", d).withColumnRenamed("row", r)
    both = key(hit, "d", "r").join(key(names, "e", "s"), F.col("d").eqNullSafe(F.col("e")) & (F.col("r") == F.col("s"))).drop("e", "s")
    all_rows = _rows(docs).select("doc_id", "row", F.size("w").cast("bigint").alias("n_words"))
    out = all_rows.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_items", F.lit(0)) >= items).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, items: int = 2) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; a repeated id goes by each row's own text."""
    bad = _items(*_prepared(docs, benchmark, window)).groupBy("doc_id", "row").count().where(F.col("count") >= items)
    bad = bad.select(F.col("doc_id").alias("__d"), F.col("row").alias("__r"))
    row = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__d")) & (row == F.col("__r")), "left_anti")


def _runs(found: DataFrame) -> DataFrame:
    """(doc_id, row, runs): the maximal runs [start, end) of words inside occurrences, in order."""
    places = found.select("doc_id", "row", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    order = Window.partitionBy("doc_id", "row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = places.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int")).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def _without(text: Column, runs: Column, mark: str) -> Column:
    """``text`` with ``mark`` in place of each run of words and what stands between them; all else as it was."""
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731 - evaluated once, not once a run
    unit = lambda between, word: F.concat(between, F.coalesce(word, F.lit("")))  # noqa: E731 - the last has no word

    def parts(x):
        head = lambda r, k: F.coalesce(F.get(x["runs"], k - 1)["end"], F.lit(0))
        kept = lambda r, k: F.concat(F.array_join(F.slice(x["u"], head(r, k) + 1, r["start"] - head(r, k)), ""), F.get(x["p"], r["start"]), F.lit(mark))
        tail = F.array_join(F.slice(x["u"], F.element_at(x["runs"], -1)["end"] + 1, F.size(x["u"])), "")
        return F.concat(F.array_join(F.transform(x["runs"], kept), ""), tail)

    pieces = F.struct(F.split(text, _WORD, -1).alias("p"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("w"))
    return bound(pieces, lambda x: bound(F.struct(x["p"].alias("p"), F.zip_with(x["p"], x["w"], unit).alias("u"), runs.alias("runs")), parts))


def scrub(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, items: int = 2, mark: str = "<benchmark>") -> DataFrame:
    """The rows that ``clean`` keeps, with ``mark`` in their texts in place of each run of words inside windows.

    What holds fewer than ``items`` items is no reason to drop a document, but none to keep their words either. The mark is
    a word that keeps those on both sides from making a window. Texts without windows and all other columns stay.
    """
    found, of_item = _prepared(docs, benchmark, window)
    names = _items(found, of_item).groupBy("doc_id", "row").agg(F.count("*").alias("__n")).withColumnsRenamed({"doc_id": "__e", "row": "__s"})
    runs = _runs(found).withColumnsRenamed({"doc_id": "__d", "row": "__r", "runs": "__runs"})
    hit = runs.join(names, F.col("__d").eqNullSafe(F.col("__e")) & (F.col("__r") == F.col("__s"))).drop("__e", "__s")
    row = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__d")) & (row == F.col("__r")), "left").where(F.coalesce("__n", F.lit(0)) < items)
    text = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(_without(F.col("text").cast("string"), F.col("__runs"), mark))
    return own.withColumn("text", text).drop("__d", "__r", "__n", "__runs")
