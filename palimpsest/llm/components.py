"""Connected components by contraction; links and labels stay on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut

_SIGN = -(1 << 63)


def named_by(least: str, digest: str) -> Column:
    """A node's name as bytes that sort by its least id (a node without any last), then by its digest."""
    rank = F.lpad(F.hex(F.col(least).cast("bigint").bitwiseXOR(F.lit(_SIGN))), 16, "0")
    head = F.when(F.col(least).isNull(), F.lit("01")).otherwise(F.concat(F.lit("00"), rank))
    return F.concat(F.unhex(head), F.col(digest))


def first_id(name: str) -> Column:
    """The id that a name made by ``named_by`` starts with, null where it has none."""
    rank = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(_SIGN))
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", rank)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the least node reachable.

    Each round every node points to its least neighbour (or itself), pointers are followed once more, and the graph is
    contracted to the distinct links between what is pointed to. The least node of a component never moves, so its
    name survives. Rounds grow with the logarithm of a component's diameter; each writes its pointers and the links that
    are left into the checkpoint folder, and the rounds' pointers are put together at the end. Joins are sort-merge
    joins, so nothing passes the driver, and partial aggregation meets hot nodes before the exchange. Self-links give
    single nodes; nulls must not occur.
    """
    links = cut(edges.select("a", "b").distinct())
    rounds: list[DataFrame] = []
    while not rounds or not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written before it is joined, so that the join is free to split what points to a hub
        point = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")))
        further = point.select(F.col("a").alias("p"), F.col("p").alias("q")).hint("merge")
        point = cut(point.join(further, "p").select("a", F.col("q").alias("p")))
        rounds.append(point)
        to = lambda c: point.select(F.col("a").alias(c), F.col("p").alias(f"{c}_p")).hint("merge")  # noqa: B023,E731
        left = links.join(to("a"), "a").join(to("b"), "b").where("a_p <> b_p")
        links = cut(left.select(F.least("a_p", "b_p").alias("a"), F.greatest("a_p", "b_p").alias("b")).distinct())
    labels = rounds[0].select(F.col("a").alias("node"), F.col("p").alias("component"))
    for point in rounds[1:]:
        moved = point.select(F.col("a").alias("component"), "p").hint("merge")
        labels = labels.join(moved, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    return cut(labels)
