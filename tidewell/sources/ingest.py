"""Raw rows to facts, and facts on disk: replace a day, merge an hour, compact, purge, overlay."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..metrics import to_sum_position
from ..schemas import DEVICES, FACTS, FactTable
from .staging import staged
from .tiers import shadowed, spans


def to_path(url: Column) -> Column:
    """An address without scheme, host, query and fragment; '/' if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.when(bare == "", "/").when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def from_api(rows: DataFrame, table: str, date: str | None = None) -> DataFrame:
    """Facts from (keys array<string>, clicks, impressions, position): one key for each dimension in order, and the date last unless it is given."""
    t = FACTS[table]
    keys = [F.element_at("keys", i + 1) for i in range(len(t.dimensions) + 1)]
    dims = [(to_path(k) if d == "url" else k.cast("int") if d == "hour" else k).alias(d) for d, k in zip(t.dimensions, keys, strict=False)]
    day = F.lit(date).cast("date") if date else keys[len(t.dimensions)].cast("date")
    return rows.select(
        *dims, day.alias("date"), F.col("clicks").cast("int").alias("clicks"), F.col("impressions").cast("int").alias("impressions"),
        to_sum_position(F.col("position").cast("double"), F.col("impressions").cast("double")).alias("sum_position"),
    )


def last_of_each(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Of rows that repeat a key, the one that arrived last; of several that arrived at once, the one with the largest hash."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(arrival), F.desc(F.xxhash64(*rows.columns))))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def summed_by_key(rows: DataFrame, table: str) -> DataFrame:
    """One row per stored key, metrics added: paths that fold together add up."""
    t = FACTS[table]
    sums = [F.sum(c).alias(c) for c in t.additive if c in rows.columns]
    rest = [F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c not in (*t.key, *t.additive)]
    return rows.groupBy(*t.key).agg(*sums, *rest)


def dates_row(totals: DataFrame, devices: DataFrame, queries: DataFrame) -> DataFrame:
    """``dates`` from site totals, rows by device (date, device, metrics) and query rows."""
    metrics = ("clicks", "impressions", "sum_position")
    wide = devices.groupBy("date").agg(*[F.sum(F.when(F.lower("device") == d, F.col(m))).alias(f"{m}_{d}") for m in metrics for d in DEVICES])
    known = queries.groupBy("date").agg(F.sum("impressions").alias("known"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("known", F.lit(0)) / F.nullif(F.col("impressions"), F.lit(0))))
    rows = totals.join(wide, "date", "left").join(known, "date", "left")
    return rows.select("date", *metrics, F.coalesce(share, F.lit(0.0)).alias("anonymized_impressions_pct"), *[F.coalesce(f"{m}_{d}", F.lit(0)).alias(f"{m}_{d}") for m in metrics for d in DEVICES])


#: Days of a period after which its files are merged into the next one: days into weeks, weeks into months, months into quarters.
TIER_DAYS = {"raw": 7, "d7": 30, "d30": 90}
TIERS = ("raw", "d7", "d30", "d90")
#: Milliseconds after which a lock's holder counts as lost.
LOST_LOCK_MS = 3_600_000
#: Younger days may still be written again.
PENDING_DAYS = 4


def start_of(day: dt.date, tier: str) -> dt.date:
    """The first day of the day, week, month or quarter that a tier puts a day into; weeks begin on Mondays and on the first of a month, so tiers nest."""
    month = day.replace(day=1)
    if tier == "d7":
        return max(month, day - dt.timedelta(day.weekday()))
    return day if tier == "raw" else month if tier == "d30" else dt.date(day.year, 3 * ((day.month - 1) // 3) + 1, 1)


def end_of(first: dt.date, tier: str) -> dt.date:
    """The last day of the period of a tier that begins on ``first``."""
    day = first
    while start_of(day + dt.timedelta(1), tier) == first:
        day += dt.timedelta(1)
    return day


def start_column(day: Column, tier: str) -> Column:
    trunc = lambda unit: F.date_trunc(unit, day).cast("date")
    return {"raw": day, "d7": F.greatest(trunc("week"), trunc("month")), "d30": trunc("month"), "d90": trunc("quarter")}[tier]


@dataclass(frozen=True)
class FactStore:
    """Fact tables under a root, partitioned by site, search type, tier and the first day of what a partition holds.

    A day lies in one partition. It is replaced as a whole, so writing it twice
    changes nothing. Days come as partitions of their own (tier raw); ``compact``
    merges those of closed weeks, months and quarters. Reads give a period, and
    Spark opens only partitions that may hold its days; within them it skips
    row groups by the clustered key.
    """

    spark: SparkSession
    root: str

    PARTS = ("site_id", "search_type", "tier", "first_day")

    def path(self, table: str, *parts: str) -> str:
        return "/".join([f"{self.root}/{table}", *(f"{k}={v}" for k, v in zip(self.PARTS, parts, strict=False))])

    def hadoop(self, path: str):
        """A path and its file system."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        where, fs = self.hadoop(path)
        return fs.exists(where)

    def delete(self, path: str) -> None:
        where, fs = self.hadoop(path)
        fs.delete(where, True)

    def schema(self, table: str) -> T.StructType:
        """The table's columns, counts as long (they are sums), and the partition columns."""
        long = lambda f: f.name != "hour" and f.dataType == T.IntegerType()
        fields = [T.StructField(f.name, T.LongType()) if long(f) else f for f in FACTS[table].schema()]
        return T.StructType([*fields, *[T.StructField(p, T.DateType() if p == "first_day" else T.StringType()) for p in self.PARTS]])

    def whole(self, table: str) -> DataFrame:
        """All rows with their partition columns, by the table's schema: no footers are read, columns a file lacks are null, and a table without a file is empty."""
        if not self.exists(self.path(table)):
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).parquet(self.path(table))

    def read(self, table: str, first: str | None = None, last: str | None = None, site: str | None = None, search_type: str | None = None) -> DataFrame:
        """Rows of a period, site and search type (all where they are not given), with site_id and search_type."""
        rows = self.whole(table)
        if site is not None:
            rows = rows.where(F.col("site_id") == site)
        if search_type is not None:
            rows = rows.where(F.col("search_type") == search_type)
        if last is not None:
            rows = rows.where((F.col("first_day") <= F.lit(last).cast("date")) & (F.col("date") <= F.lit(last).cast("date")))
        if first is not None:
            day = dt.date.fromisoformat(first)
            begun = F.lit(False)
            for tier in TIERS:
                begun = begun | ((F.col("tier") == tier) & (F.col("first_day") >= F.lit(start_of(day, tier))))
            rows = rows.where(begun & (F.col("date") >= F.lit(day)))
        return self.once(table, rows, first, last, site).drop("tier", "first_day")

    def once(self, table: str, rows: DataFrame, first: str | None = None, last: str | None = None, site: str | None = None) -> DataFrame:
        """``rows`` of ``whole`` with each day from its finest partition alone, so that a merge that is under way or was broken off changes no sum.

        Partitions that supply nothing are left out by their partition columns,
        so they are not opened; where none overlap, the plan is as it was.
        """
        if table == "hourly_pages":
            return rows
        bounds = [dt.date.fromisoformat(x) if x else None for x in (first, last)]
        for p, days in shadowed(self.partitions(table, site), TIERS, end_of, *bounds).items():
            whole = spans(p, days, end_of)
            here = reduce(lambda a, b: a & b, [F.col(name) == F.lit(value) for name, value in zip(self.PARTS, p, strict=True)])
            inside = reduce(lambda a, b: a | b, [F.col("date").between(*map(F.lit, d)) for d in days])
            rows = rows.where(~here if whole else ~(here & inside))
        return rows

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], FACTS[table].schema())

    def put(self, table: str, placed: DataFrame, files: int | None = None) -> None:
        """Write rows with partition columns, replacing their partitions. Columns that the table doesn't have are left out."""
        t: FactTable = FACTS[table]
        placed = placed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema(table) if f.name in placed.columns])
        # Partitions are spread over tasks by key range, so a large one is not one task.
        spread = placed.repartitionByRange(*([files] if files else []), *self.PARTS, *t.cluster)
        (
            spread.sortWithinPartitions(*self.PARTS, *t.cluster).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd").partitionBy(*self.PARTS).parquet(self.path(table))
        )

    def mark(self, table: str, site: str, search_type: str, tier: str, first: dt.date) -> str:
        """The file that says a merged partition is whole; Spark doesn't read names that begin with an underscore."""
        return f"{self.path(table, site, search_type, tier, first.isoformat())}/_merged"

    def set_mark(self, *partition) -> None:
        where, fs = self.hadoop(self.mark(*partition))
        fs.create(where, True).close()

    def tier_of(self, table: str, site: str, search_type: str, day: dt.date) -> str:
        """The tier of the partition that a day is to be written to: the one that reads take it from; raw if none holds it.

        Where a merge was broken off after its partition was marked, the parts
        of that day are deleted first, so the merged one supplies it.
        """
        holders = [t for t in TIERS if self.exists(self.path(table, site, search_type, t, start_of(day, t).isoformat()))]
        for k in range(len(holders) - 1, 0, -1):
            if self.exists(self.mark(table, site, search_type, holders[k], start_of(day, holders[k]))):
                for finer in holders[:k]:
                    self.delete_all(table, site, search_type, finer, [start_of(day, finer)])
                return holders[k]
        return holders[0] if holders else "raw"

    @contextmanager
    def locked(self, site: str, table: str, wait: float = 600.0) -> Iterator[None]:
        """Hold the lock of a site's table: a file that only one can create. Its holder's age says when it counts as lost."""
        where, fs = self.hadoop(f"{self.root}/_locks/{table}/{site}")
        until = time.monotonic() + wait
        while not fs.createNewFile(where):
            if fs.exists(where) and time.time() * 1000 - fs.getFileStatus(where).getModificationTime() > LOST_LOCK_MS:
                fs.delete(where, False)
            elif time.monotonic() > until:
                raise TimeoutError(f"{table} of {site} is locked")
            else:
                time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(where, False)

    def write_days(self, table: str, rows: DataFrame, site: str, search_type: str = "web", files: int | None = None) -> None:
        """Replace every day that ``rows`` holds, in the partition where it lies."""
        keyed = summed_by_key(rows, table).withColumn("date", F.col("date").cast("date"))
        days = [r.date for r in keyed.select("date").distinct().collect()]  # the days of one sync
        with self.locked(site, table):
            tiers = {day: self.tier_of(table, site, search_type, day) for day in days}
            self.replace(table, keyed, site, search_type, tiers, files)

    def replace(self, table: str, rows: DataFrame, site: str, search_type: str, tiers: dict[dt.date, str], files: int | None = None) -> None:
        """Write ``rows`` in place of the days in ``tiers``; other days of merged partitions stay."""
        by_tier: dict[str, list[dt.date]] = {}
        for day, tier in tiers.items():
            by_tier.setdefault(tier, []).append(day)
        placed = None
        for tier, days in by_tier.items():
            part = rows.where(F.col("date").isin(days))
            if tier != "raw":
                starts = sorted({start_of(d, tier) for d in days})
                old = self.whole(table).where((F.col("site_id") == site) & (F.col("search_type") == search_type) & (F.col("tier") == tier) & F.col("first_day").isin(starts))
                part = part.unionByName(staged(old.where(~F.col("date").isin(days)).drop(*self.PARTS)), allowMissingColumns=True)
            part = part.withColumn("tier", F.lit(tier)).withColumn("first_day", start_column(F.col("date"), tier))
            placed = part if placed is None else placed.unionByName(part)
        merged = {(site, search_type, t, start_of(d, t)) for d, t in tiers.items() if t != "raw"}
        marked = [p for p in merged if self.exists(self.mark(table, *p))]
        if placed is not None:
            self.put(table, placed.withColumn("site_id", F.lit(site)).withColumn("search_type", F.lit(search_type)), files)
        for p in marked:
            self.set_mark(table, *p)

    def merge_hours(self, rows: DataFrame, site: str, search_type: str = "web") -> None:
        """Upsert hourly rows by (url, date, hour): new ones win, hours that are not among them stay."""
        days = [r.date for r in rows.select(F.col("date").cast("date").alias("date")).distinct().collect()]  # the days of one sync
        old = self.whole("hourly_pages").where((F.col("site_id") == site) & (F.col("search_type") == search_type) & F.col("date").isin(days)).select(*rows.columns)
        both = old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        self.write_days("hourly_pages", staged(last_of_each(both, ["url", "date", "hour"], "_new").drop("_new")), site, search_type)

    def purge_urls(self, table: str, urls: DataFrame, site: str, search_type: str = "web") -> None:
        """Rewrite the partitions that hold any of the urls (url) without them; those that hold nothing else are deleted."""
        mine = self.whole(table).where((F.col("site_id") == site) & (F.col("search_type") == search_type))
        wanted = urls.select("url").distinct()
        hit = staged(mine.join(wanted, "url", "left_semi").select("tier", "first_day").distinct())
        kept = staged(mine.join(hit, ["tier", "first_day"], "left_semi").join(wanted, "url", "left_anti"))
        self.put(table, kept)
        for r in hit.join(kept.select("tier", "first_day").distinct(), ["tier", "first_day"], "left_anti").collect():  # partitions, not rows
            self.delete(self.path(table, site, search_type, r.tier, r.first_day.isoformat()))

    def partitions(self, table: str, site: str | None = None) -> list[tuple[str, str, str, dt.date]]:
        """(site, search type, tier, first day) of each partition of a site or of all, from the names of folders alone."""
        found = [()]
        for depth in range(len(self.PARTS)):
            deeper = []
            for parts in found:
                where, fs = self.hadoop(self.path(table, *parts))
                names = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()] if fs.exists(where) else []
                deeper += [(*parts, n.partition("=")[2]) for n in names if n.startswith(f"{self.PARTS[depth]}=")]
            found = [p for p in deeper if depth or site is None or p[0] == site]
        return sorted((a, b, t, dt.date.fromisoformat(d)) for a, b, t, d in found)

    def compact(self, table: str, today: dt.date, site: str | None = None) -> int:
        """Merge days of closed weeks, weeks of closed months and months of closed quarters; how many partitions were made.

        A period is merged once its last day is older than TIER_DAYS of its
        parts. Search types are never merged, hours not at all. The new
        partition is written, marked as whole, and then its parts are deleted.
        Reads take each day from its finest partition (``once``), so they give
        the same sums at each step. Where a run was broken off, the next one
        goes by the mark: if it is there, the parts are deleted; if not, what
        was written is merged again from the parts, and from itself for the days
        that no part holds.
        """
        if table == "hourly_pages":
            return 0
        made = 0
        for fine, coarse in zip(TIERS, TIERS[1:], strict=False):
            cutoff = today - dt.timedelta(max(TIER_DAYS[fine], PENDING_DAYS))
            groups: dict[tuple[str, str, dt.date], list[dt.date]] = {}
            for where, kind, tier, first in self.partitions(table, site):
                if tier == fine and end_of(start_of(first, coarse), coarse) < cutoff:
                    groups.setdefault((where, kind, start_of(first, coarse)), []).append(first)
            for (where, kind, start), firsts in groups.items():
                with self.locked(where, table):
                    made += self.merge(table, where, kind, fine, coarse, start, firsts)
        return made

    def merge(self, table: str, site: str, search_type: str, fine: str, coarse: str, start: dt.date, firsts: list[dt.date]) -> int:
        """One step of ``compact``: 1 if the partition was written, 0 if parts were left to delete."""
        exists = self.exists(self.path(table, site, search_type, coarse, start.isoformat()))
        if not (exists and self.exists(self.mark(table, site, search_type, coarse, start))):
            mine = self.whole(table).where((F.col("site_id") == site) & (F.col("search_type") == search_type))
            parts = (F.col("tier") == fine) & F.col("first_day").isin(firsts)
            older = (F.col("tier") == coarse) & (F.col("first_day") == F.lit(start))
            rows = self.once(table, mine, site=site).where(parts | older if exists else parts)
            # A partition that is read cannot be written over, so its rows are put aside.
            rows = staged(rows) if exists else rows
            self.put(table, rows.withColumn("tier", F.lit(coarse)).withColumn("first_day", F.lit(start)))
            self.set_mark(table, site, search_type, coarse, start)
            self.delete_all(table, site, search_type, fine, firsts)
            return 1
        self.delete_all(table, site, search_type, fine, firsts)
        return 0

    def sweep(self, now_ms: int, grace_ms: int, site: str | None = None) -> int:
        """Delete what no read needs and is older than ``grace_ms``; how many folders that were.

        Those are folders of writes that broke off, and parts of partitions that
        are marked as whole. A part is looked at again under the lock of its
        table and site, as a writer may be at it. Younger ones stay, as their writer may
        still be at work or their reader at reading.
        """
        swept = 0
        for table in FACTS:
            where, fs = self.hadoop(self.path(table))
            if not fs.exists(where):
                continue
            broken = [f for f in fs.listStatus(where) if f.isDirectory() and f.getPath().getName().startswith((".spark-staging", "_temporary"))]
            for f in broken:
                swept += f.getModificationTime() <= now_ms - grace_ms and bool(fs.delete(f.getPath(), True))
            if table == "hourly_pages":
                continue
            found = set(self.partitions(table, site))
            for p in sorted(found):
                over = [(*p[:2], t, start_of(p[3], t)) for t in TIERS[TIERS.index(p[2]) + 1 :]]
                if not any(c in found for c in over):
                    continue
                with self.locked(p[0], table):
                    path, _ = self.hadoop(self.path(table, *p[:3], p[3].isoformat()))
                    old = fs.exists(path) and fs.getFileStatus(path).getModificationTime() <= now_ms - grace_ms
                    if old and any(self.exists(self.mark(table, *c)) for c in over):
                        swept += bool(fs.delete(path, True))
        return swept

    def delete_all(self, table: str, site: str, search_type: str, tier: str, firsts: list[dt.date]) -> None:
        for first in firsts:
            self.delete(self.path(table, site, search_type, tier, first.isoformat()))

    def drop_old_hours(self, today: dt.date, keep_days: int = 14) -> int:
        """Delete hourly partitions older than ``keep_days``; how many there were."""
        old = [p for p in self.partitions("hourly_pages") if p[3] < today - dt.timedelta(keep_days)]
        for site, kind, tier, first in old:
            self.delete_all("hourly_pages", site, kind, tier, [first])
        return len(old)

    def watermarks(self, table: str) -> DataFrame:
        """The oldest and newest day of each site and search type."""
        return self.whole(table).groupBy("site_id", "search_type").agg(F.min("date").alias("oldest_date"), F.max("date").alias("newest_date"))

    def note_sync(self, states: DataFrame) -> None:
        """Append sync states (site_id, table, search_type, date, state, at); a state is pending, inflight, done or failed."""
        columns = ["site_id", "table", "search_type", "date", "state", "at"]
        known = F.col("state").isin(*SYNC_STATES)
        checked = F.when(known, F.col("state")).otherwise(F.raise_error(F.concat(F.lit("no sync state "), F.coalesce("state", F.lit("null")))))
        states.withColumn("state", checked).select(*columns).write.mode("append").parquet(f"{self.root}/sync_state")

    def sync_state(self) -> DataFrame:
        """The latest state of each site, table, search type and day."""
        rows = self.spark.read.parquet(f"{self.root}/sync_state")
        return last_of_each(rows, ["site_id", "table", "search_type", "date"], "at")

    def append_once(self, name: str, rows: DataFrame) -> str:
        """Add rows under their identity: adding the same rows again, in any order, changes nothing."""
        identity = append_identity(rows)
        rows.withColumn("append_id", F.lit(identity)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("append_id").parquet(f"{self.root}/{name}")
        return identity

    def views(self, sites: dict[str, str]) -> None:
        """A view of each table over several stores (label to root), with the label as ``site``."""
        for name in FACTS:
            parts = [store.read(name).withColumn("site", F.lit(label)) for label, root in sites.items() if (store := FactStore(self.spark, root)).exists(store.path(name))]
            if parts:
                reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).createOrReplaceTempView(name)


SYNC_STATES = ("pending", "inflight", "done", "failed")


def append_identity(rows: DataFrame) -> str:
    """A hash of rows and how often each comes, whatever the order of rows and columns; sums of row hashes, so nothing is sorted."""
    told = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    digest = F.sha2(told, 256)
    part = lambda i: F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(part(i)), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return rows.agg(F.sha2(F.concat_ws(":", F.lit(",".join(sorted(rows.columns))), F.count("*").cast("string"), *sums), 256).alias("id")).first().id


def overlay(lake: DataFrame, fresh: DataFrame) -> DataFrame:
    """The lake, and fresh rows of days it does not hold."""
    return lake.unionByName(fresh.join(lake.select("date").distinct(), "date", "left_anti"), allowMissingColumns=True)


def compacted(files: DataFrame, table: str, written_at: str) -> DataFrame:
    """One row per key of overlapping files, the newest, in cluster order within tasks."""
    return last_of_each(files, list(FACTS[table].key), written_at).sortWithinPartitions(*FACTS[table].cluster)


def partitions_of(first: str, last: str, grain: str = "day") -> list[str]:
    """Names of the days, weeks (by Monday), months or quarters that a period meets."""
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    names: dict[str, None] = {}
    for i in range((b - a).days + 1):
        d = a + dt.timedelta(i)
        monday = d - dt.timedelta(d.weekday())
        names[{"day": d.isoformat(), "week": monday.isoformat(), "month": d.strftime("%Y-%m"), "quarter": f"{d.year}-Q{(d.month + 2) // 3}"}[grain]] = None
    return list(names)


def live_files(entries: list[tuple[str, str, str, int]]) -> list[str]:
    """Of (name, first day, last day, order written), those needed to cover each day once: finer files before coarser, newer before older."""
    span = lambda e: (dt.date.fromisoformat(e[2]) - dt.date.fromisoformat(e[1])).days
    seen: set[dt.date] = set()
    kept = []
    for name, first, last, _ in sorted(entries, key=lambda e: (span(e), -e[3])):
        a = dt.date.fromisoformat(first)
        days = {a + dt.timedelta(i) for i in range((dt.date.fromisoformat(last) - a).days + 1)}
        if not days <= seen:
            kept.append(name)
            seen |= days
    return kept


def export(df: DataFrame, kind: str, path: str) -> None:
    """parquet, csv, json or ndjson."""
    if kind == "parquet":
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("json", "ndjson"):
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no export {kind!r}")


def rendered(page: DataFrame, kind: str) -> str:
    """A page of results as json (a list of rows), csv (with a header) or table, as text; pages are bounded by their limit."""
    if kind == "table":
        pdf = page.toPandas()
        return pdf.to_string(index=False)
    if kind == "json":
        return "[" + ",".join(r.j for r in page.select(F.to_json(F.struct(*page.columns), {"ignoreNullFields": "false"}).alias("j")).collect()) + "]"
    if kind == "csv":
        lines = page.select(F.to_csv(F.struct(*page.columns)).alias("c")).collect()
        return "\n".join([",".join(page.columns), *(r.c for r in lines)])
    raise ValueError(f"no output {kind!r}")
