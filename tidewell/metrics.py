"""The metric algebra: facts hold clicks, impressions and sum_position = (position - 1) * impressions.

Ratios are never stored or averaged; each is recovered from sums, so it stays
exact under any grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = ("clicks", "impressions", "ctr", "position")


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0))


def clicks() -> Column:
    return F.sum("clicks").cast("double")


def impressions() -> Column:
    return F.sum("impressions").cast("double")


def ctr() -> Column:
    return over(F.sum("clicks").cast("double"), F.sum("impressions"))


def position() -> Column:
    return over(F.sum("sum_position"), F.sum("impressions")) + 1


def sql_functions(spark: SparkSession) -> None:
    """Let SQL of this session say ``gsc_position(sum(sum_position), sum(impressions))`` for ``position()``: null without impressions.

    It takes the sums, as functions written in SQL hold no aggregates of their
    own and one in Python would get each group whole; so Spark adds up before the shuffle.
    """
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION gsc_position(sum_position DOUBLE, impressions DOUBLE) RETURNS DOUBLE "
        "RETURN sum_position / NULLIF(impressions, 0) + 1"
    )


def aggregates(*names: str) -> list[Column]:
    made = {"clicks": clicks, "impressions": impressions, "ctr": ctr, "position": position}
    return [made[n]().alias(n) for n in (names or METRICS)]


def to_sum_position(position: Column, impressions: Column) -> Column:
    """Positions below 1 count as 1."""
    return (F.greatest(position, F.lit(1.0)) - 1) * impressions


def percent_change(now: Column, before: Column) -> Column:
    return F.when(before == 0, F.when(now > 0, 100.0).otherwise(0.0)).otherwise((now - before) * 100.0 / F.nullif(before, F.lit(0.0)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))
