"""Ranks on the graph of queries and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..metrics import over
from ..sources.facts import Facts
from ..sources.staging import staged
from .scoring import during, named

ROUNDS, DAMPING, STRONG = 25, 0.85, 0.05


def edges(facts: Facts, period, least=50, top_queries=1000, top_urls=500) -> DataFrame:
    """q, u, w: impressions of the pairs between the queries and pages seen most."""
    rows = named(during(facts.page_queries, period), "query", "url").groupBy(F.col("query").alias("q"), F.col("url").alias("u")).agg(F.sum("impressions").cast("double").alias("w"))
    rows = rows.where(F.col("w") >= least)
    best = lambda c, n: rows.groupBy(c).agg(F.sum("w").alias("t")).orderBy(F.desc("t"), c).limit(n).select(c)
    return rows.join(F.broadcast(best("q", top_queries)), "q").join(F.broadcast(best("u", top_urls)), "u").select("q", "u", "w")


def next_ranks(shares: DataFrame, rank: DataFrame, n: Column, damping: float) -> DataFrame:
    """One round: ranks are one row for each node of the two top lists."""
    sent = shares.join(F.broadcast(rank), ["kind", "node"]).groupBy(F.col("to_kind").alias("kind"), F.col("to").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("r"))
    return sent.select("kind", "node", ((1 - damping) / n + damping * F.col("r")).alias("rank"))


def pagerank_deltas(facts: Facts, period, rounds=ROUNDS, damping=DAMPING, **options) -> DataFrame:
    """step and l1: by how much all ranks moved in each round."""
    e = edges(facts, period, **options)
    both = e.select(F.lit("query").alias("kind"), F.col("q").alias("node"), F.lit("url").alias("to_kind"), F.col("u").alias("to"), "w").unionAll(
        e.select(F.lit("url"), F.col("u"), F.lit("query"), F.col("q"), "w")
    )
    by = Window.partitionBy("kind", "node")
    shares = staged(both.withColumn("share", over(F.col("w"), F.sum("w").over(by))).select("kind", "node", "to_kind", "to", "share"))
    nodes = shares.select("kind", "node").distinct()
    sizes = {r.kind: r.n for r in nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # two rows
    n = F.when(F.col("kind") == "query", float(sizes.get("query", 1))).otherwise(float(sizes.get("url", 1)))
    rank = nodes.select("kind", "node", (1 / n).alias("rank"))
    moves = None
    for k in range(1, rounds + 1):
        then, rank = rank, staged(next_ranks(shares, rank, n, damping))
        moved = rank.join(then.withColumnRenamed("rank", "was"), ["kind", "node"]).agg(F.lit(k).alias("step"), F.coalesce(F.sum(F.abs(F.col("rank") - F.col("was"))), F.lit(0.0)).alias("l1"))
        moves = moved if moves is None else moves.unionAll(moved)
    return moves


def bipartite_pagerank(facts: Facts, period, rounds=ROUNDS, damping=DAMPING, stage_every=8, **options) -> DataFrame:
    """kind, node, rank, total, degree and strong (edges that carry a twentieth or more of the node's weight).

    The two sides swap ranks each round through shares fixed before. The graph
    is bounded by the top lists, so a round is one small join and aggregation;
    ranks are written out every few rounds, which keeps plans short.
    """
    e = edges(facts, period, **options)
    both = e.select(F.lit("query").alias("kind"), F.col("q").alias("node"), F.lit("url").alias("to_kind"), F.col("u").alias("to"), "w").unionAll(
        e.select(F.lit("url"), F.col("u"), F.lit("query"), F.col("q"), "w")
    )
    by = Window.partitionBy("kind", "node")
    flow = staged(both.select("*", F.sum("w").over(by).alias("total"), F.count("*").over(by).alias("degree")).withColumn("share", over(F.col("w"), F.col("total"))))
    nodes = staged(
        flow.groupBy("kind", "node").agg(F.max("total").alias("total"), F.max("degree").alias("degree"), F.count_if(F.col("share") >= STRONG).alias("strong"))
    )
    sizes = {r.kind: r.n for r in nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # two rows
    n = F.when(F.col("kind") == "query", float(sizes.get("query", 1))).otherwise(float(sizes.get("url", 1)))
    rank = nodes.select("kind", "node", (1 / n).alias("rank"))
    shares = flow.select("kind", "node", "to_kind", "to", "share")
    for k in range(1, rounds + 1):
        rank = next_ranks(shares, rank, n, damping)
        if k % stage_every == 0 and k < rounds:
            rank = staged(rank)
    return nodes.join(rank, ["kind", "node"]).select("kind", "node", "rank", "total", "degree", "strong")
