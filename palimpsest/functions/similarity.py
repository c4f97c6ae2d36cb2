"""Similarities of bags of words given as maps from lemma to weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _norm(bag: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(bag), F.lit(0.0), lambda s, x: s + x * x))


def cos_sim(a: Column, b: Column) -> Column:
    """Cosine over common lemmas; norms are over all own ones. 0 where a norm is 0."""
    dot = F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.element_at(b, k))
    norms = _norm(a) * _norm(b)
    return F.when(norms > 0, dot / norms).otherwise(F.lit(0.0))


def dice_sim(a: Column, b: Column) -> Column:
    """Twice the common lemmas over all lemmas of both; lemmas of weight 0 count. 0 if both are empty."""
    total = F.size(F.map_keys(a)) + F.size(F.map_keys(b))
    return F.when(total > 0, 2 * F.size(F.array_intersect(F.map_keys(a), F.map_keys(b))) / total).otherwise(F.lit(0.0))
