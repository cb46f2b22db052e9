"""Search-performance facts made from the star-schema test tables.

``dense`` has a row for nearly each pair and day of one month; ``sparse`` has
seven years with few rows per pair; ``long`` is sparse with longer queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Parts up to which Spark may broadcast them as it sees fit; more would cross the driver whole, as their files look small to its size check.
BROADCAST_PARTS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(m).alias(m) for m in ("clicks", "impressions", "sum_position")]
    return rows.groupBy(*keys, "date").agg(*sums)


@dataclass(frozen=True)
class Facts:
    page_queries: DataFrame

    @property
    def queries(self) -> DataFrame:
        return summed(self.page_queries, "query")

    @property
    def pages(self) -> DataFrame:
        return summed(self.page_queries, "url")

    @property
    def dates(self) -> DataFrame:
        return summed(self.page_queries)


def dense(spark: SparkSession, sf_dir: str) -> Facts:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("/"), "event_type").alias("url"),
        F.concat(F.lit("q"), (F.col("user_id") % 8).cast("string")).alias("query"),
        F.col("ts").cast("date").alias("date"),
        (F.col("value") >= 12).cast("long").alias("clicks"),
        F.lit(10).cast("long").alias("impressions"),
        ((k % 20) * 10).cast("double").alias("sum_position"),
    )
    return Facts(summed(rows, "url", "query"))


def line_rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One row of each order line with its metrics, part and the named columns."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    if part.count() > BROADCAST_PARTS:
        part = part.hint("merge")
    slot = (F.col("l_partkey") + 7 * F.col("l_linenumber")) % 30
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("url"),
        F.col("p_name").alias("query"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("long").alias("clicks"),
        F.col("l_quantity").cast("long").alias("impressions"),
        (slot * F.col("l_quantity")).alias("sum_position"),
        *more,
    )


def sparse(spark: SparkSession, sf_dir: str) -> Facts:
    return Facts(summed(line_rows(spark, sf_dir), "url", "query"))


def long(spark: SparkSession, sf_dir: str) -> Facts:
    rows = line_rows(spark, sf_dir, "p_size", "p_type")
    lead = F.when(F.col("p_size") % 5 == 0, "how to ").when(F.col("p_size") % 5 == 1, "best ").otherwise("")
    named = rows.withColumn("query", F.concat(lead, "query", F.lit(" "), F.lower("p_type")))
    return Facts(summed(named, "url", "query"))


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir, "l_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    where = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.lower("n_name").alias("country"))
    return summed(rows.join(orders, "l_orderkey").join(where, "c_custkey"), "country")


def search_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("searchAppearance"))
    return summed(line_rows(spark, sf_dir, "l_orderkey").join(orders, "l_orderkey"), "searchAppearance")


def device_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dates`` with its nine columns by device."""
    rows = line_rows(spark, sf_dir, "l_returnflag")
    sums = [F.sum(m).alias(m) for m in ("clicks", "impressions", "sum_position")]
    flags = {"desktop": "A", "mobile": "N", "tablet": "R"}
    pivots = [
        F.sum(F.when(F.col("l_returnflag") == f, F.col(m)).otherwise(0)).alias(f"{m}_{d}")
        for m in ("clicks", "impressions", "sum_position")
        for d, f in flags.items()
    ]
    return rows.groupBy("date").agg(*sums, *pivots)
