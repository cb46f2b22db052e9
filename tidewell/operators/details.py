"""What stands behind the rows of an analyzer: members, series, points, and sorted pages."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.facts import Facts
from . import movement, scoring, series

#: Most rows of a page, and how many it has if nothing is said.
MOST_ROWS, PAGE_ROWS = 50_000, 1000
#: Points of a page's long tail up to which all are shown; of more the first WHOLE_HEAD, and then ranks that grow by STEP.
ALL_POINTS, WHOLE_HEAD, STEP = 80, 10, 1.15


def sorted_page(
    rows: DataFrame, allowed: tuple[str, ...], otherwise: tuple[str, str], sort_by: str | None = None, sort_dir: str | None = None, limit: int | None = None, offset: int | None = None, ties: tuple[str, ...] = ()
) -> DataFrame:
    """A page of an analyzer's rows by one of the allowed columns; what is not allowed or makes no sense counts as not said."""
    column = sort_by if sort_by in allowed else otherwise[0]
    way = sort_dir if sort_dir in ("asc", "desc") else otherwise[1]
    n = min(int(limit), MOST_ROWS) if limit and limit > 0 else PAGE_ROWS
    skip = int(offset) if offset and offset > 0 else 0
    first = F.desc_nulls_last(column) if way == "desc" else F.asc_nulls_last(column)
    page = rows.orderBy(first, *[F.asc_nulls_last(t) for t in ties if t != column])
    return (page.offset(skip) if skip else page).limit(n)


def largest_members(queries: DataFrame, clusters: DataFrame, most: int | None = 25) -> DataFrame:
    """Of each cluster in ``clusters`` the queries with most impressions: cluster, rank, query, impressions, clicks, position."""
    kept = queries.join(clusters.select("cluster"), "cluster", "left_semi")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("impressions"), "query")))
    shown = ranked if most is None else ranked.where(F.col("rank") <= most)
    return shown.select("cluster", "rank", "query", "impressions", "clicks", "position")


def cluster_members(facts: Facts, period, most: int | None = None, **options) -> DataFrame:
    named = {k: v for k, v in options.items() if k != "smallest"}
    return largest_members(scoring.clustered_queries(facts, period, **named), scoring.clustering(facts, period, **options), most)


def atlas_members(facts: Facts, period, most: int | None = 25, **options) -> DataFrame:
    named = {k: v for k, v in options.items() if k != "smallest"}
    return largest_members(scoring.atlas_queries(facts, period, **named), scoring.intent_atlas(facts, period, **options), most)


def shown_ranks(most: int = 1 << 30) -> list[int]:
    """The ranks after the head that stand on the log-spaced grid: each the first at or beyond the next power of STEP."""
    ranks, rank, k = [], WHOLE_HEAD, 1
    while rank < most:
        rank = max(rank + 1, ceil(STEP**k))
        ranks.append(rank)
        k += 1
    return ranks


def long_tail_points(facts: Facts, period, least=5, fewest=10) -> DataFrame:
    """url, rank, query, impressions and clicks of the points that a chart of each page's queries shows."""
    rows = scoring.named(scoring.pairs(facts, period, least), "query", "url")
    by = W.partitionBy("url")
    ranked = rows.select("url", "query", "impressions", "clicks", F.row_number().over(by.orderBy(F.desc("impressions"), "query")).alias("rank"), F.count("*").over(by).alias("n")).where(F.col("n") >= fewest)
    # Some 150 ranks, whatever the number of queries.
    shown = (F.col("n") <= ALL_POINTS) | (F.col("rank") <= WHOLE_HEAD) | F.col("rank").isin(shown_ranks())
    return ranked.where(shown).select("url", "rank", "query", "impressions", "clicks")


def decay_series(facts: Facts, now, before, **options) -> DataFrame:
    """url, week, clicks and impressions of decaying pages over both periods."""
    pages = movement.decay(facts, now, before, **options).select("url")
    rows = movement.either(facts.page_queries, now, before).join(pages, "url", "left_semi")
    return rows.groupBy("url", F.date_trunc("week", "date").cast("date").alias("week")).agg(*movement.aggregates("clicks", "impressions"))


def ctr_anomaly_series(facts: Facts, period, days=2, **options) -> DataFrame:
    """The days of each pair whose click rate broke down; breach marks the days on which it did."""
    pairs = series.ctr_anomaly(facts, period, days, **options).select("query", "url")
    rows = series.ctr_breaches(facts, period, **options).join(pairs, ["query", "url"], "left_semi")
    return rows.select("query", "url", "date", "ctr", "position", "impressions", "rolling_ctr", "rolling_sd", "z", (F.col("breach") & (F.col("z") < 0)).alias("breach"))


def ctr_sides(facts: Facts, period, each=25, **options) -> DataFrame:
    """The outliers of click rate by side, over and under what their band expects, the furthest first; ``each`` of a side at most."""
    side = F.when(F.col("ctr_diff") > 0, "over").when(F.col("ctr_diff") < 0, "under")
    rows = scoring.ctr_outliers(facts, period, **options).withColumn("side", side).where("side IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("side").orderBy(F.desc(F.round(F.abs("ctr_diff"), 9)), "query"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= each)


def breadth_lists(facts: Facts, period, most=20) -> DataFrame:
    """The fragile pages with most clicks and the authorities with most queries: list, rank, url, keyword_count, clicks, impressions."""
    rows = scoring.keyword_breadth(facts, period)

    def first(flag: str, column: str) -> DataFrame:
        page = rows.where(flag).orderBy(F.desc(column), "url").limit(most)
        return page.select(F.lit(flag).alias("list"), F.row_number().over(W.orderBy(F.desc(column), "url")).alias("rank"), "url", "keyword_count", "clicks", "impressions")

    return first("fragile", "clicks").unionByName(first("authority", "keyword_count"))


def breadth_stats(facts: Facts, period) -> DataFrame:
    """One row: pages, mean number of queries, and how many pages are fragile and authorities by their number of queries alone."""
    n = F.col("keyword_count")
    return scoring.keyword_breadth(facts, period).agg(
        F.count("*").alias("total_pages"), F.avg(n).alias("avg_keywords"), F.count_if(n <= 2).alias("fragile_count"), F.count_if(n >= 20).alias("authority_count")
    )
