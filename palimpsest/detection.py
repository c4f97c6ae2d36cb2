"""One call from documents to matches, with archive, common documents, cache and settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.config import DetectionConfig
from palimpsest.functions import text as T
from palimpsest.lineage import cut
from palimpsest.operators import clusters as C
from palimpsest.operators import matches as M
from palimpsest.operators import preprocess as P
from palimpsest.operators import seeds as J
from palimpsest.sources import cache as K
from palimpsest.sources import files as S


@dataclass(frozen=True)
class Detection:
    """What a run found; every part is a DataFrame."""

    docs: DataFrame  # documents and archive, with is_archive
    sents: DataFrame
    seeds: DataFrame
    clusters: DataFrame
    matches: DataFrame
    foreign: DataFrame
    config: DetectionConfig


def translated(docs: DataFrame, translate: Callable[[str], str], lang: str, most: int = 4999) -> DataFrame:
    """``docs`` with foreign texts translated chunk by chunk on the executors by ``translate``, and ``lang`` set."""

    @F.pandas_udf("string")
    def whole(s):
        return s.map(lambda t: None if t is None else "".join(map(translate, T.split_text(t, most))))

    foreign = T.is_foreign(F.col("lang"), lang)
    return docs.withColumn("text", F.when(foreign, whole("text")).otherwise(F.col("text"))).withColumn("lang", F.lit(lang))


def preprocess(docs: DataFrame, common: DataFrame | None = None, config: DetectionConfig | None = None, cache_folder: str | None = None) -> DataFrame:
    """Sentences of all documents. With a cache, those of texts prepared before are taken from it, and it is replaced."""
    config = config or DetectionConfig()
    lang = config.lang if config.rem_stop_words else None
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    keyed = docs.select("doc_id", "text", key.alias("text_key"))
    if not cache_folder or not config.ser:
        return P.prepare(docs, config.min_sent_len, common, lang)
    name = f"{K.common_key(common)}-{config.min_sent_len}-{lang}"
    like = P.prepare(docs, config.min_sent_len, common, lang).withColumn("text_key", F.lit(""))
    old = K.load(docs.sparkSession, cache_folder, name, like)
    reused = old.drop("doc_id").join(keyed.select("doc_id", "text_key"), "text_key")
    new = keyed.join(old.select("text_key").distinct(), "text_key", "left_anti")
    made = P.prepare(new, config.min_sent_len, common, lang).join(new.select("doc_id", "text_key"), "doc_id")
    rows = cut(reused.unionByName(made))
    K.save(rows, cache_folder, name)
    return rows.drop("text_key")


def together(docs: DataFrame, archive: DataFrame | None) -> DataFrame:
    """Distinct texts of both sides with ``is_archive``; archive texts that a document has are left out.

    Ids must be unique over both sides: matches name documents by them.
    """
    own = P.dedupe(docs).withColumn("is_archive", F.lit(False))
    if archive is None:
        return own
    if not archive.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_semi").isEmpty():
        raise ValueError("an archive document has the id of a document")
    rest = J.exclude_known(P.dedupe(archive), docs).withColumn("is_archive", F.lit(True))
    return own.unionByName(rest, allowMissingColumns=True)


def find_matches(docs: DataFrame, archive: DataFrame | None = None, common: DataFrame | None = None, config: DetectionConfig | None = None, cache_folder: str | None = None, translate: Callable[[str], str] | None = None) -> Detection:
    """Matches between all documents, and between documents and archive ones; archive documents aren't paired with each other.

    ``docs``, ``archive``: doc_id, text (lang, name); ``common``: text, whose lines mark sentences that count for nothing.
    Null texts are empty; equal texts are one document; no documents give no matches.
    """
    config = config or DetectionConfig()
    both = together(docs, archive)
    lang = F.coalesce(F.col("lang"), T.language(F.col("text"))) if "lang" in both.columns else T.language(F.col("text"))
    both = cut(both.withColumn("lang", lang))
    foreign = both.where(T.is_foreign(F.col("lang"), config.lang)).select("doc_id", "lang")
    if translate is not None and config.transl:
        both = cut(translated(both, translate, config.lang))
    sents = preprocess(both, common, config, cache_folder).join(both.select("doc_id", "is_archive"), "doc_id")
    sents = cut(sents)
    seeds = cut(J.seeds(sents, config.min_cos_sim, config.min_dice_sim))
    clusters = cut(C.resolved(seeds, sents, config))
    return Detection(both, sents, seeds, clusters, M.all_matches(clusters, sents, both, config), foreign, config)


def reanalyse(found: Detection, first: int, second: int, common: DataFrame | None = None, **changes) -> Detection:
    """One pair of an earlier run again with other settings; the earlier run's own are untouched."""
    return find_matches(S.pair(found.docs, first, second).drop("is_archive"), None, common, replace(found.config, **changes))
