"""Facts from streams: hourly windows under a watermark, and whole days replaced as they complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import FACTS
from ..sources.ingest import FactStore, from_api


def hourly_facts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """url, date, hour and sums of each hour, from a stream of (ts, url, clicks, impressions, sum_position).

    An hour comes out once the watermark has passed it; later rows of it are dropped.
    """
    hours = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "url").agg(*[F.sum(m).alias(m) for m in ("clicks", "impressions", "sum_position")])
    start = F.col("window.start")
    return hours.select("url", start.cast("date").alias("date"), F.hour(start).alias("hour"), "clicks", "impressions", "sum_position")


def daily_facts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """url, date and sums of each day that the watermark has passed."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "url").agg(*[F.sum(m).alias(m) for m in ("clicks", "impressions", "sum_position")])
    return days.select("url", F.col("window.start").cast("date").alias("date"), "clicks", "impressions", "sum_position")


def write_days(stream: DataFrame, store: FactStore, table: str, site: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces the days it completes, or adds its hours to those that are stored; a batch that is run again writes the same rows."""

    def put(batch: DataFrame, _epoch: int) -> None:
        if batch.isEmpty():
            return
        if table == "hourly_pages":
            store.merge_hours(batch, site)
        else:
            store.write_days(table, batch, site)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def latest_rows(raw: DataFrame, table: str, late: str = "0 days") -> DataFrame:
    """Facts of a table from API rows (keys array<string>, clicks, impressions, position, arrived), each exact key tuple as it arrived last.

    The date is the key after the table's dimensions. Of tuples that arrive at
    one time the one with the largest hash counts; rows without a date are left
    out. Addresses that fold together stay apart here and add up when the facts
    are written (``summed_by_key``), as each tuple is a fact of its own.

    Over a stream, the state holds one row for each tuple, in Spark's own state
    store; a date comes out, with all its tuples in one batch, once a date newer
    by more than ``late`` has been seen, and tuples of it that arrive later
    are dropped. The newest dates stay until then. Over a table, all dates come out.
    """
    date = F.element_at("keys", len(FACTS[table].dimensions) + 1).try_cast("date")
    # Midnight in UTC, whatever the session's zone, as windows are laid from there.
    day = F.timestamp_seconds(F.unix_date(date).cast("long") * 86_400)
    metrics = F.struct("clicks", "impressions", "position")
    last = F.max_by(metrics, F.struct("arrived", F.xxhash64("clicks", "impressions", "position"))).alias("last")
    latest = raw.withColumn("day", day).where("day IS NOT NULL").withWatermark("day", late).groupBy(F.window("day", "1 day"), "keys").agg(last)
    return from_api(latest.select("keys", "last.*"), table)
