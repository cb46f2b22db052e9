"""Which days of a period each table holds, which it lacks, and whether that is enough to read the period."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .periods import islands


def coverage(days: DataFrame, tables: dict[str, bool], first: str, last: str) -> DataFrame:
    """table, required, kind (covered or gap), first_day, last_day, days: the runs of a period's days that each table holds or lacks.

    ``days`` has (table, date), in any order and repeated; ``tables`` says of each
    that is asked for whether it is required. Held days become runs, and what
    lies between one run and the next, or an end of the period, is a gap. A
    table without a day is one gap.
    """
    spark = days.sparkSession
    asked = spark.createDataFrame(list(tables.items()), "table string, required boolean")
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    held = days.where(F.col("date").between(low, high)).join(F.broadcast(asked.select("table")), "table", "left_semi")
    runs = islands(held, "table")
    # A run before the period lets the first gap begin with it.
    edge = asked.select("table", F.date_sub(low, 1).alias("last_day"))
    ends = runs.select("table", "first_day", "last_day").unionByName(edge, allowMissingColumns=True)
    after = F.coalesce(F.lead("first_day").over(W.partitionBy("table").orderBy("last_day")), F.date_add(high, 1))
    between = ends.select("table", F.date_add("last_day", 1).alias("first_day"), F.date_sub(after, 1).alias("last_day")).where("first_day <= last_day")
    spans = runs.select("table", F.lit("covered").alias("kind"), "first_day", "last_day").unionByName(between.select("table", F.lit("gap").alias("kind"), "first_day", "last_day"))
    return spans.join(F.broadcast(asked), "table").select("table", "required", "kind", "first_day", "last_day", (F.datediff("last_day", "first_day") + 1).alias("days"))


def verdict(spans: DataFrame, first: str, last: str, grace_days: int = 0) -> DataFrame:
    """One row, complete and version, from ``coverage`` of a period.

    Complete means that some table is required and no required one lacks a
    day, but for the last ``grace_days``, which may still be on their way (the
    first day never is). The version changes with any covered run: the
    first 32 hex digits of SHA-256 over the runs in order.
    """
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    gate = max(a, b - dt.timedelta(max(0, grace_days)))
    lacks = F.count_if(F.col("required") & (F.col("kind") == "gap") & (F.col("first_day") <= F.lit(gate)))
    told = F.when(F.col("kind") == "covered", F.concat_ws("\0", "table", F.col("first_day").cast("string"), F.col("last_day").cast("string")))
    return spans.agg(
        ((F.count_if("required") > 0) & (lacks == 0)).alias("complete"),
        F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(told)), "\n"), 256), 1, 32).alias("version"),
    )
