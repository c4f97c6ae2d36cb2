"""Text expressions. All but those named so are built-in Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+"
#: A token may hold symbols and marks; only one of letters and digits alone is a word.
TOKEN = r"[\p{L}\p{N}\p{M}\p{S}]+"
WORD = r"^[\p{L}\p{N}]{2,}$"
URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"']+"
#: Fixed value: marks of broken text extraction.
POOR = r"¨[aou]|ﬀ|\(cid:\d+\)|[a-zA-Z]{50}"


def truncate(s: Column, n: int) -> Column:
    """``s`` if shorter than ``n``, else its first ``n`` characters and three dots (also at length ``n``)."""
    return F.when(F.length(s) < n, s).otherwise(F.concat(F.substring(s, 1, n), F.lit("...")))


def tiles(text: Column) -> Column:
    """Sentences with what parts them; joined they are the text again, so their lengths add up to offsets."""
    return F.regexp_extract_all(text, F.lit(TILE), F.lit(0))


def words(sentence: Column) -> Column:
    """Lower-cased words of two characters or more; a token that holds a symbol (as 5€) is none."""
    return F.filter(F.regexp_extract_all(F.lower(sentence), F.lit(TOKEN), F.lit(0)), lambda w: w.rlike(WORD))


def is_poor_extraction(text: Column) -> Column:
    """Whether extracted text looks broken: blank, split umlauts, ligatures, glyph codes, or 50 letters in a row."""
    return (F.trim(text) == "") | text.rlike(POOR)


def normalise_url(url: Column) -> Column:
    """One trailing punctuation mark and trailing slashes go, doubled ones after the scheme are mended, https is the default scheme."""
    bare = F.regexp_replace(url, r"[.,;:!?)\]}]$", "")
    full = F.when(bare.rlike(r"(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    return F.regexp_replace(F.regexp_replace(full, r"/+$", ""), "///", "//")


def urls(text: Column) -> Column:
    """Distinct http(s) addresses of a text, normalised; no name is looked up."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), normalise_url))


def is_foreign(lang: Column, expected: str) -> Column:
    """Whether a document's language differs; unknown languages count as foreign."""
    return ~lang.eqNullSafe(F.lit(expected))


_SPARK_NAMES = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}


def stop_words(lang: str) -> list[str]:
    """Spark's own stop-word list of a language; of languages without one, none."""
    name = _SPARK_NAMES.get(lang)
    return StopWordsRemover.loadDefaultStopWords(name) if name else []


def without_stop_words(w: Column, lang: Column) -> Column:
    """Words of a sentence that aren't stop words of its language. The lists are constants of the plan."""
    out = w
    for code in _SPARK_NAMES:
        some = stop_words(code)
        out = F.when(lang == code, F.filter(w, lambda x: ~x.isin(some))).otherwise(out)
    return out


def language(text: Column) -> Column:
    """The language most of whose stop words occur in a text, null where none does (a rule-based default)."""
    w = F.array_distinct(words(text))
    votes = F.array(*[F.struct(F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in stop_words(c) if len(x) > 1]))).alias("n"), F.lit(c).alias("lang")) for c in sorted(_SPARK_NAMES)])
    top = F.array_max(votes)
    return F.when((text.isNull()) | (top["n"] == 0), F.lit(None).cast("string")).otherwise(top["lang"])


def split_text(text: str, most: int) -> list[str]:
    """Chunks of at most ``most`` characters, cut after the last sentence end that fits, else hard; lossless."""
    out = []
    while len(text) > most:
        cut = max((m.end() for m in re.finditer(r"[.!?]\s", text[:most])), default=most)
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def chunks(most: int):
    """Pandas UDF (a batch of texts a call): text to its chunks."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else split_text(t, most))

    return split
