"""Rollups as files: the canonical one built in steps that can be resumed, a table of top keywords, and the sets of both."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rollups import canonical_daily
from .published import Published, Superseded

CANONICAL = T.StructType().add("query_canonical", "string").add("date", "date").add("clicks", "long").add("impressions", "long").add("sum_position", "double")
#: The rollups that every site has, and those for reads by canonical query.
DEFAULT_ROLLUPS = (
    "daily_totals", "weekly_totals", "top_pages_28d", "top_keywords_28d", "top_countries_28d", "indexing_metadata", "indexing_health", "index_percent", "sitemap_health",
    "sitemap_changes_28d",
)
CANONICAL_ROLLUPS = ("query_canonical_variants", "query_canonical_daily")


def top_keywords(queries: DataFrame, anchor: str, days: int = 28, most: int = 1000) -> DataFrame:
    """query, clicks, impressions and sum_position of the queries with most clicks since ``days`` before the anchor; sums, so reads can add and filter."""
    recent = queries.where(F.col("date") >= F.date_sub(F.lit(anchor).cast("date"), days))
    sums = recent.groupBy("query").agg(F.sum("clicks").cast("long").alias("clicks"), F.sum("impressions").cast("long").alias("impressions"), F.sum("sum_position").cast("double").alias("sum_position"))
    return sums.orderBy(F.desc("clicks"), "query").limit(most)


@dataclass(frozen=True)
class RollupFiles:
    """Versions of rollups under a root, a folder of Parquet for each; reads take the newest that is published."""

    spark: SparkSession
    root: str

    def records(self, rollup: str) -> Published:
        return Published(self.spark, f"{self.root}/{rollup}")

    def write(self, rollup: str, rows: DataFrame, built_at: int) -> None:
        """Write and publish a version; raises if one as new is published."""
        records = self.records(rollup)
        after = self.older(records, built_at)
        rows.write.mode("overwrite").parquet(f"{self.root}/{rollup}/versions/{built_at}")
        records.commit({"built_at": built_at}, str(built_at), after)

    def write_set(self, ids: tuple[str, ...], made: dict[str, DataFrame], built_at: int) -> list[str]:
        """Write those rollups of a set that ``made`` has; the ids it lacks."""
        for rollup in ids:
            if rollup in made:
                self.write(rollup, made[rollup], built_at)
        return [i for i in ids if i not in made]

    def older(self, records: Published, built_at: int) -> str | None:
        newest = records.newest()
        if newest and self.built_at(newest) >= built_at:
            raise Superseded(f"a version as new as {built_at} is published")
        return newest

    @staticmethod
    def built_at(name: str) -> int:
        return int(name.removesuffix(".json").split("_")[1])

    def read(self, rollup: str) -> DataFrame:
        newest = self.records(rollup).newest()
        if newest is None:
            raise LookupError(f"no rollup {rollup}")
        return self.spark.read.parquet(f"{self.root}/{rollup}/versions/{self.built_at(newest)}")


@dataclass(frozen=True)
class CanonicalRollup:
    """Facts by canonical query and day, built window by window of days and within one by shards of canonical queries.

    What is built is a version, named by when its build began. Its first step
    writes down the windows and the number of shards, which later steps take
    from there, whatever they are given; days that come later belong to the next version. Each
    part, a window's shard, has a mark once it is whole. A part without one is
    built again from the facts. After the last part the version is published,
    and until then reads take the one before. A query's days of a window lie in
    one part, so reads need no further sums.
    """

    spark: SparkSession
    root: str
    window_days: int = 28
    shards: int = 1

    @property
    def records(self) -> Published:
        return Published(self.spark, self.root)

    def plan(self, queries: DataFrame, built_at: int) -> dict:
        """The windows (first and last day) and the number of shards of a version."""
        name = f"plans/{built_at}.json"
        if not self.records.exists(name):
            ends = queries.agg(F.min("date").cast("date").alias("a"), F.max("date").cast("date").alias("z")).first()
            windows = []
            at = ends.a
            while at is not None and at <= ends.z:
                last = min(at + dt.timedelta(self.window_days - 1), ends.z)
                windows.append([at.isoformat(), last.isoformat()])
                at = last + dt.timedelta(1)
            self.records.put(name, {"windows": windows, "shards": self.shards, "window_days": self.window_days})
        return self.records.get(name)

    def part(self, built_at: int, first: str, shard: int) -> str:
        return f"parts/{built_at}/window={first}/shard={shard}"

    def pending(self, plan: dict, built_at: int) -> Iterator[tuple[str, str, int]]:
        """First day, last day and shard of the parts that have no mark."""
        for first, last in plan["windows"]:
            for shard in range(plan["shards"]):
                if not self.records.exists(f"{self.part(built_at, first, shard)}/_whole"):
                    yield first, last, shard

    def build(self, queries: DataFrame, dim: DataFrame, built_at: int, most: int | None = None, seconds: float | None = None) -> int:
        """Build parts until all are there, or ``most`` of them or ``seconds`` are used up; how many are left.

        With 0 left the version is published. ``queries`` holds query, date and the additive metrics, ``dim``
        query and query_canonical, one row for each query. A call with the same ``built_at`` goes on where the last one ended.
        """
        newest = self.records.newest()
        if newest and RollupFiles.built_at(newest) == built_at:
            return 0
        RollupFiles(self.spark, self.root).older(self.records, built_at)
        plan = self.plan(queries, built_at)
        began, made = time.monotonic(), 0
        for first, last, shard in self.pending(plan, built_at):
            if (most is not None and made >= most) or (seconds is not None and made and time.monotonic() - began > seconds):
                return sum(1 for _ in self.pending(plan, built_at))
            self.build_part(queries, dim, built_at, first, last, shard, plan["shards"])
            made += 1
        after = RollupFiles(self.spark, self.root).older(self.records, built_at)
        self.records.commit({"built_at": built_at, **plan}, str(built_at), after)
        return 0

    def build_part(self, queries: DataFrame, dim: DataFrame, built_at: int, first: str, last: str, shard: int, shards: int) -> None:
        days = queries.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        # Every part reads all of ``dim``; it is joined by key, so that it isn't sent to the driver for each of them.
        rows = canonical_daily(days, dim.hint("merge")).where(F.pmod(F.xxhash64("query_canonical"), F.lit(shards)) == shard)
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CANONICAL])
        name = self.part(built_at, first, shard)
        rows.repartitionByRange("date", "query_canonical").sortWithinPartitions("date", "query_canonical").write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.records.mark(f"{name}/_whole")

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """query_canonical, date, clicks, impressions and sum_position of the newest version, of a period if given; only windows that meet it are opened."""
        newest = self.records.newest()
        if newest is None:
            raise LookupError("no version is published")
        record = self.records.load(newest)
        met = [w for w in record["windows"] if w[0] <= (last or "9999") and w[1] >= (first or "")]
        paths = [f"{self.root}/{self.part(record['built_at'], a, shard)}" for a, _ in met for shard in range(record["shards"])]
        if not paths:
            return self.spark.createDataFrame([], CANONICAL)
        rows = self.spark.read.schema(CANONICAL).parquet(*paths)
        if first:
            rows = rows.where(F.col("date") >= F.lit(first).cast("date"))
        return rows.where(F.col("date") <= F.lit(last).cast("date")) if last else rows
