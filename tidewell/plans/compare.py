"""Two periods side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..metrics import METRICS, over
from .planner import Lake, grouped, ordering, paged, plan, rows_of
from .spec import QueryError, QuerySpec

PREVIOUS = {m: f"prev{m.title()}" for m in METRICS}


def kept(kind: str):
    now, before = F.col("clicks"), F.col("prevClicks")
    seen, was = F.col("impressions"), F.col("prevImpressions")
    conditions = {"new": (was == 0) & (seen > 0), "lost": (was > 0) & (seen == 0), "improving": now > before, "declining": (now < before) & (before > 0)}
    if kind not in conditions:
        raise QueryError("unknown-comparison", f"no comparison filter {kind!r}")
    return conditions[kind]


def compared(lake: Lake, current: QuerySpec, previous: QuerySpec, kind: str | None = None) -> DataFrame:
    """All groups of either period; a missing side is zero.

    The previous side takes the current side's dimension filters and its own
    period, and no conditions on metrics: a group that falls under a threshold
    now is still compared with what it was.
    """
    now, before = plan(current), plan(previous)
    a = grouped(rows_of(lake, now), now)
    b = grouped(rows_of(lake, before, prefilter=False, filters=now.spec.filter), now, having=False)
    b = b.select(*now.spec.dimensions, *[F.col(m).alias(PREVIOUS[m]) for m in METRICS])
    keys = list(now.spec.dimensions)
    both = a.join(b, keys, "outer") if keys else a.crossJoin(b)
    cols = [F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in (*METRICS, *PREVIOUS.values())]
    rows = both.select(*keys, *cols)
    return rows.where(kept(kind)) if kind else rows


def comparison(lake: Lake, current: QuerySpec, previous: QuerySpec, kind: str | None = None, by_change: str | None = None) -> DataFrame:
    """A page of ``compared``; ``by_change`` (asc or desc) ranks by the change in clicks before the page is cut."""
    p = plan(current)
    rows = compared(lake, current, previous, kind)
    if by_change is None:
        return paged(rows, p)
    if by_change not in ("asc", "desc"):
        raise QueryError("invalid-order", f"no direction {by_change!r}")
    rows = rows.withColumn("clicksChange", F.col("clicks") - F.col("prevClicks"))
    return paged(rows, p, ordering(p, "clicksChange", by_change))


def comparison_count(lake: Lake, current: QuerySpec, previous: QuerySpec, kind: str | None = None) -> DataFrame:
    return compared(lake, current, previous, kind).agg(F.count("*").alias("total"))


def comparison_totals(lake: Lake, current: QuerySpec, previous: QuerySpec) -> DataFrame:
    """Totals of both periods from one scan, however the periods overlap."""
    now, before = plan(current), plan(previous)
    wide = plan(current)
    first, last = min(now.first, before.first), max(now.last, before.last)
    rows = rows_of(lake, type(wide)(now.spec, now.dataset, first, last))
    out = []
    for p, prefix in ((now, "total"), (before, "prevTotal")):
        inside = F.col("date").between(F.lit(p.first).cast("date"), F.lit(p.last).cast("date"))
        c, i, s = (F.sum(F.when(inside, F.col(m))) for m in ("clicks", "impressions", "sum_position"))
        out += [c.cast("double").alias(f"{prefix}Clicks"), i.cast("double").alias(f"{prefix}Impressions"), over(c.cast("double"), i).alias(f"{prefix}Ctr"), (over(s, i) + 1).alias(f"{prefix}Position")]
    return rows.agg(*out)


