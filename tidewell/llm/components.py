"""Connected components of an edge table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def with_least(members: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``members`` with the smallest ``value`` of their ``key`` as ``name``; a key may hold a third of all rows.

    The smallest values are combined before they are shuffled, and written out
    with one row per key, so that the join with them can be split where a key is hot.
    """
    return members.join(cut(members.groupBy(key).agg(F.min(value).alias(name))), key)


def components(edges: DataFrame) -> DataFrame:
    """Label each node of ``edges`` (a long, b long) with the smallest id it reaches.

    Returns (node, root), one row per node that has an edge to another node.

    Each round draws a new random order of the nodes and contracts every node
    into its first neighbour in that order, or keeps it if it comes before all
    of them. An expected constant share of the nodes goes in each round, so the
    number of rounds is logarithmic however long the chains are. All steps are
    an aggregation with map-side combine or a join with a table that has one
    row per node, so a hub with many edges never gathers in one task. Loops,
    repeated edges and null ends are ignored; an empty table gives no rows.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return (
            e.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )

    left = cut(tidy(edges.select("a", "b")))
    steps: list[DataFrame] = []
    while not left.isEmpty():
        order = lambda c, k=len(steps): F.xxhash64(F.lit(k), F.col(c))
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            left.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        first = both.groupBy("u").agg(F.min(F.struct(order("v").alias("o"), F.col("v"))).alias("f"))
        step = cut(
            first.select("u", F.when(F.col("f.o") < order("u"), F.col("f.v")).otherwise(F.col("u")).alias("to"))
        )
        steps.append(step)
        ends = step.select(F.col("u").alias("a"), F.col("to").alias("a2"))
        other = step.select(F.col("u").alias("b"), F.col("to").alias("b2"))
        left = cut(
            tidy(left.join(ends, "a").join(other, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")))
        )
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    top = steps[-1]
    for step in reversed(steps[:-1]):
        above = top.select(F.col("u").alias("to"), F.col("to").alias("end"))
        top = step.join(above, "to", "left").select("u", F.coalesce("end", "to").alias("to"))
    top = cut(top)
    # A component's kept node is no neighbour of itself, but stands in ``top`` as its own end.
    rooted = with_least(top.select("to", "u", F.least("u", "to").alias("low")), "to", "low", "root")
    return rooted.select(F.col("u").alias("node"), "root")
