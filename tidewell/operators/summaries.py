"""What a dashboard says above an analyzer's rows. Each reads a few aggregated rows."""

from __future__ import annotations

from statistics import mean

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def velocity_trend(weeks: list[int]) -> str:
    """Later against earlier weeks' new queries; the middle week counts to the later half."""
    if not weeks:
        return "stable"
    mid = len(weeks) // 2
    early, late = (mean(weeks[:mid]) if mid else 0.0), mean(weeks[mid:])
    least = max(1.0, 0.15 * mean(weeks))
    return "accelerating" if late - early > least else "decelerating" if early - late > least else "stable"


def content_velocity_summary(rows: DataFrame) -> dict:
    weeks = [r.new_keywords for r in rows.orderBy("week").collect()]  # some sixty weeks at most
    return {"total_new": sum(weeks), "avg_new_per_week": mean(weeks) if weeks else 0.0, "trend": velocity_trend(weeks)}


def gap_trend(first: float, last: float, tolerance: float = 0.005) -> str:
    change = abs(last) - abs(first)
    return "stable" if abs(change) < tolerance else "improving" if change < 0 else "worsening"


def device_gap_summary(days: DataFrame, width: int = 7) -> dict:
    """Mean gaps and how those of the last days compare with those of the first."""
    ends = [days.orderBy(o).limit(width).agg(F.avg("ctr_gap"), F.avg("position_gap")).first() for o in (F.asc("date"), F.desc("date"))]
    whole = days.agg(F.avg("ctr_gap"), F.avg("position_gap")).first()
    first, last = ([x or 0.0 for x in e] for e in ends)
    return {"avg_ctr_gap": whole[0] or 0.0, "avg_position_gap": whole[1] or 0.0, "ctr_trend": gap_trend(first[0], last[0]), "position_trend": gap_trend(first[1], last[1])}


def seasonality_summary(rows: DataFrame) -> dict:
    months = rows.orderBy("month").collect()
    pick = lambda flag: sorted({r.month[5:7] for r in months if r[flag]})
    return {
        "strength": months[0].strength if months else 0.0, "has_seasonality": bool(months) and months[0].strength > 0.3, "peak_months": pick("is_peak"),
        "trough_months": pick("is_trough"), "insufficient_data": len(months) < 12,
    }


def brand_summary(rows: DataFrame) -> dict:
    first = rows.select("brand_clicks", "non_brand_clicks", "brand_impressions", "non_brand_impressions").limit(1).collect()
    b, n, bi, ni = first[0] if first else (0.0, 0.0, 0.0, 0.0)
    return {"brand_clicks": b, "non_brand_clicks": n, "brand_impressions": bi, "non_brand_impressions": ni, "brand_share": b / (b + n) if b + n else 0.0}


def survival_median(curve: DataFrame) -> DataFrame:
    """Median tenure of each cohort, interpolated between the last point above one half and the first at or below it; null if none is."""
    points = curve.groupBy("cohort").agg(F.sort_array(F.collect_list(F.struct("tenure", "survival"))).alias("p"))
    below = F.get(F.filter("p", lambda x: x["survival"] <= 0.5), F.lit(0))
    above = F.filter("p", lambda x: x["survival"] > 0.5)
    before = F.coalesce(F.get(above, F.size(above) - 1), F.struct(F.lit(0).alias("tenure"), F.lit(1.0).alias("survival")))
    share = (before["survival"] - 0.5) / F.nullif(before["survival"] - below["survival"], F.lit(0.0))
    return points.select("cohort", (before["tenure"] + share * (below["tenure"] - before["tenure"])).alias("median_tenure"))


def movers_counts(rows: DataFrame) -> dict:
    found = {r.direction: r.n for r in rows.groupBy("direction").agg(F.count("*").alias("n")).collect()}
    return {d: found.get(d, 0) for d in ("rising", "declining", "stable")}
