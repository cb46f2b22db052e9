"""Precomputed aggregates of the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..metrics import aggregates, over


def anonymous_share(whole, known):
    """The share of impressions that no query accounts for, between 0 and 1; 0 if there are none."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - over(F.coalesce(known, F.lit(0)).cast("double"), whole))), F.lit(0.0))


def daily_totals(pages: DataFrame, queries: DataFrame) -> DataFrame:
    known = queries.groupBy("date").agg(F.sum("impressions").alias("known"))
    days = pages.groupBy("date").agg(*aggregates())
    return days.join(known, "date", "left").withColumn("anonymous_share", anonymous_share(F.col("impressions"), F.col("known"))).drop("known")


def weekly_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.date_trunc("week", "date").cast("date").alias("week")).agg(*aggregates())


def top_recent(facts: DataFrame, key: str, anchor: str, days: int = 28, most: int = 1000) -> DataFrame:
    """The keys with most clicks since ``days`` before the anchor."""
    recent = facts.where(F.col("date") >= F.date_sub(F.lit(anchor).cast("date"), days))
    return recent.groupBy(key).agg(*aggregates()).orderBy(F.desc("clicks"), key).limit(most)


def canonical_variants(queries: DataFrame, dim: DataFrame, most: int = 10) -> DataFrame:
    """canonical, variant_count, rank and query of the first ``most`` variants by clicks."""
    each = queries.groupBy("query").agg(*aggregates("clicks", "impressions")).join(dim.select("query", "query_canonical"), "query", "left")
    each = each.withColumn("canonical", F.coalesce("query_canonical", "query"))
    by = W.partitionBy("canonical")
    ranked = each.select("canonical", "query", "clicks", "impressions", F.count("*").over(by).alias("variant_count"), F.row_number().over(by.orderBy(F.desc("clicks"), "query")).alias("rank"))
    return ranked.where(F.col("rank") <= most)


def canonical_daily(queries: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts by canonical query and day, for reads that need no raw query."""
    sums = [F.sum(m).alias(m) for m in ("clicks", "impressions", "sum_position")]
    named = queries.join(dim.select("query", "query_canonical"), "query", "left")
    return named.groupBy(F.coalesce("query_canonical", "query").alias("query_canonical"), "date").agg(*sums)


def hourly_to_daily(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("url", "date").agg(*[F.sum(m).alias(m) for m in ("clicks", "impressions", "sum_position")])


def indexing_metadata(events: DataFrame) -> DataFrame:
    """Updates and removals by day, from (ts, kind)."""
    return events.groupBy(F.col("ts").cast("date").alias("date")).agg(F.count_if(F.col("kind") == "update").alias("updates"), F.count_if(F.col("kind") == "remove").alias("removals"))


VERDICTS = ("PASS", "PARTIAL", "FAIL", "NEUTRAL")


def indexing_health(inspections: DataFrame, anchor: str, days: int = 90) -> DataFrame:
    """Verdicts of each day, from (inspected_at, verdict)."""
    rows = inspections.withColumn("date", F.col("inspected_at").cast("date")).where(F.col("date") > F.date_sub(F.lit(anchor).cast("date"), days))
    return rows.groupBy("date").agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS])


def index_percent(sitemap: DataFrame, pages: DataFrame) -> DataFrame:
    """Share of distinct sitemap addresses that were clicked."""
    urls = sitemap.select("url").distinct()
    clicked = pages.where("clicks > 0").select("url", F.lit(1).alias("hit")).distinct()
    met = urls.join(clicked, "url", "left").agg(F.count("*").alias("sitemap_urls"), F.count("hit").alias("clicked_urls"))
    return met.withColumn("percent", F.coalesce(100 * over(F.col("clicked_urls").cast("double"), F.col("sitemap_urls")), F.lit(0.0)))


def sitemap_health(generations: DataFrame) -> DataFrame:
    """The newest generation of each feed and day, from (feed, generated_at, urls, errors, warnings)."""
    day = F.col("generated_at").cast("date")
    newest = F.row_number().over(W.partitionBy("feed", day).orderBy(F.desc("generated_at"), F.desc("urls")))
    return generations.withColumn("date", day).withColumn("n", newest).where("n = 1").drop("n")


def recent_changes(events: DataFrame, anchor: str, days: int) -> DataFrame:
    """Added and removed addresses of the last days, from (feed, loc, observed_at, op); updates are no changes of the list."""
    rows = events.withColumn("date", F.col("observed_at").cast("date")).where(F.col("op").isin("added", "removed"))
    return rows.where(F.col("date").between(F.date_sub(F.lit(anchor).cast("date"), days), F.lit(anchor).cast("date")))


def sitemap_change_days(events: DataFrame, anchor: str, days: int = 28) -> DataFrame:
    """How many addresses each feed added and removed on each day."""
    return recent_changes(events, anchor, days).groupBy("date", "feed").agg(F.count_if(F.col("op") == "added").alias("added"), F.count_if(F.col("op") == "removed").alias("removed"))


def sitemap_latest_changes(events: DataFrame, anchor: str, days: int = 28, most: int = 200) -> DataFrame:
    """op, feed, loc and observed_at of the latest ``most`` additions and as many removals."""
    rows = recent_changes(events, anchor, days).select("op", "feed", "loc", "observed_at")
    latest = lambda op: rows.where(F.col("op") == op).orderBy(F.desc("observed_at"), "feed", "loc").limit(most)
    return latest("added").unionByName(latest("removed"))
