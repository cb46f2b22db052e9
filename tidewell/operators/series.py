"""Analyzers of daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..metrics import aggregates, over
from ..schemas import DEVICES
from ..sources.facts import Facts
from .scoring import during, named


def daily_pairs(facts: Facts, period, least: float = 0) -> DataFrame:
    rows = named(during(facts.page_queries, period), "query", "url")
    return rows.groupBy("query", "url", "date").agg(*aggregates()).where(F.col("impressions") >= least)


def seasonality(facts: Facts, period, metric="clicks") -> DataFrame:
    """Months against their mean."""
    months = during(facts.dates, period).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum(metric).cast("double").alias("value"))
    stats = months.agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("sd"), F.count("*").alias("month_count"))
    versus = F.when(F.col("mean") > 0, over(F.col("value"), F.col("mean"))).otherwise(0.0)
    return months.crossJoin(F.broadcast(stats)).select(
        "month", "value", versus.alias("vs_average"), (versus > 1.5).alias("is_peak"),
        ((F.col("mean") > 0) & (versus < 0.5)).alias("is_trough"),
        F.when(F.col("mean") > 0, F.least(over(F.col("sd"), F.col("mean")), F.lit(1.0))).otherwise(0.0).alias("strength"), "month_count",
    )


def ctr_breaches(facts: Facts, period, least=5, rows_needed=14, z_least=2.0, most_shift=1.5) -> DataFrame:
    """Each day of a pair against its 28 rows before: z of the click rate, shift of the position, and whether that is a breach."""
    w = W.partitionBy("query", "url").orderBy("date").rowsBetween(-28, -1)
    rolled = daily_pairs(facts, period, least).select(
        "*",
        F.avg("ctr").over(w).alias("rolling_ctr"),
        F.stddev_pop("ctr").over(w).alias("rolling_sd"),
        over(F.sum(F.col("position") * F.col("impressions")).over(w), F.sum("impressions").over(w)).alias("rolling_position"),
        F.count("*").over(w).alias("rolling_n"),
    )
    enough = F.col("rolling_n") >= rows_needed
    z = F.when(enough & (F.col("rolling_sd") > 0), over(F.col("ctr") - F.col("rolling_ctr"), F.col("rolling_sd"))).otherwise(0.0)
    shift = F.coalesce(F.abs(F.col("position") - F.col("rolling_position")), F.lit(0.0))
    return rolled.select("*", z.alias("z"), shift.alias("shift")).withColumn("breach", enough & (F.abs("z") >= z_least) & (F.col("shift") <= most_shift))


def ctr_anomaly(facts: Facts, period, days=2, rows_needed=14, **options) -> DataFrame:
    """Pairs whose click rate fell out of its range on several days while their position held."""
    rows = ctr_breaches(facts, period, rows_needed=rows_needed, **options)
    down, based = F.col("breach") & (F.col("z") < 0), F.col("rolling_n") >= rows_needed
    return rows.groupBy("query", "url").agg(
        F.count_if(down).alias("breach_days_down"),
        F.count_if(F.col("breach") & (F.col("z") > 0)).alias("breach_days_up"),
        F.round(F.sum(F.when(down, (F.col("rolling_ctr") - F.col("ctr")) * F.col("impressions")).otherwise(0.0))).alias("clicks_lost"),
        F.sum(F.when(down, F.abs("z") * F.col("impressions")).otherwise(0.0)).alias("severity"),
        F.max(F.when(F.col("breach"), F.abs("z")).otherwise(0.0)).alias("max_z"),
        F.avg(F.when(based, F.col("rolling_ctr"))).alias("baseline_ctr"),
        over(F.sum(F.when(based, F.col("rolling_position") * F.col("impressions"))), F.sum(F.when(based, F.col("impressions")))).alias("baseline_position"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
    ).where(F.col("breach_days_down") >= days)


def position_volatility(facts: Facts, period, least=10, fewest_days=7, top=30) -> DataFrame:
    """Days of the most volatile pages: spread of their queries' positions plus the shift from the day before."""
    q = daily_pairs(facts, period, 1)
    daily = q.groupBy("url", "date").agg(
        F.count("*").alias("query_count"),
        F.sum("impressions").alias("day_impressions"),
        over(F.sum(F.col("position") * F.col("impressions")), F.sum("impressions")).alias("avg_position"),
        F.coalesce(F.stddev_pop("position"), F.lit(0.0)).alias("pos_sd"),
        F.min("position").alias("best_position"),
        F.max("position").alias("worst_position"),
    ).where(F.col("day_impressions") >= least)
    before = F.lag("avg_position").over(W.partitionBy("url").orderBy("date"))
    scored = daily.withColumn("shift", F.coalesce(F.abs(F.col("avg_position") - before), F.lit(0.0))).withColumn("volatility", F.col("pos_sd") + F.col("shift"))
    best = scored.groupBy("url").agg(
        F.avg("volatility").alias("page_volatility"), F.max("volatility").alias("page_peak"), F.sum("day_impressions").alias("page_impressions"), F.count("*").alias("days")
    ).where(F.col("days") >= fewest_days).orderBy(F.desc(F.round("page_volatility", 9)), "url").limit(top).drop("days")
    return scored.join(F.broadcast(best), "url")  # at most ``top`` rows


def stl_days(facts: Facts, period, metric="clicks", days=21, least=100) -> DataFrame:
    """Each day of a pair as trend (centred week), weekday season and residual."""
    by = W.partitionBy("query", "url")
    rows = daily_pairs(facts, period).withColumn("observed", F.col(metric))
    kept = rows.select("*", F.count("*").over(by).alias("days"), F.sum("impressions").over(by).alias("total")).where((F.col("days") >= days) & (F.col("total") >= least)).drop("days", "total")
    week = by.orderBy("date").rowsBetween(-3, 3)
    trend = kept.withColumn("trend", F.when(F.count("*").over(week) == 7, F.avg("observed").over(week))).withColumn("detrended", F.col("observed") - F.col("trend"))
    season = trend.withColumn("raw", F.avg("detrended").over(W.partitionBy("query", "url", F.dayofweek("date"))))
    season = season.withColumn("seasonal", F.col("raw") - F.avg("raw").over(by)).withColumn("residual", F.col("observed") - F.col("trend") - F.col("seasonal"))
    sd = F.stddev_pop("residual").over(by)
    return season.withColumn("anomaly", F.coalesce((sd > 0) & (F.abs("residual") > 2 * sd), F.lit(False))).drop("raw")


def stl_decompose(facts: Facts, period, **options) -> DataFrame:
    by_entity = stl_days(facts, period, **options).groupBy("query", "url").agg(
        F.sum("impressions").alias("total_impressions"),
        F.count("*").alias("days"),
        F.var_pop("detrended").alias("vd"),
        F.var_pop("seasonal").alias("vs"),
        F.var_pop("residual").alias("vr"),
        F.count_if("anomaly").alias("residual_anomalies"),
        F.regr_slope("observed", F.unix_date("date").cast("double")).alias("slope"),
    )
    flat = F.coalesce(F.col("vd") == 0, F.lit(True))
    return by_entity.select(
        "query", "url", "total_impressions", "days",
        F.when(flat, 0.0).otherwise(F.least(over(F.col("vs"), F.col("vd")), F.lit(1.0))).alias("seasonal_strength"),
        F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - over(F.col("vr"), F.col("vd")))).alias("trend_strength"),
        "residual_anomalies", F.coalesce("slope", F.lit(0.0)).alias("trend_slope"),
    )


def change_point(facts: Facts, period, metric="position", days=21, least=100, side=7, threshold=10.0) -> DataFrame:
    """The day after which a pair's series is best told apart in two by a Gaussian likelihood ratio; the earliest of equal ones."""
    rows = daily_pairs(facts, period, 1).select("query", "url", "date", "impressions", F.col(metric).alias("x"), (F.col("impressions") if metric == "position" else F.lit(1.0)).alias("w"))
    by = W.partitionBy("query", "url")
    so_far = by.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    parts = {"n": F.lit(1), "w": F.col("w"), "s": F.col("x") * F.col("w"), "q": F.col("x") * F.col("x") * F.col("w")}
    sums = [F.sum(e).over(win).alias(f"{k}{name}") for name, win in (("all", by), ("left", so_far)) for k, e in parts.items()]
    rows = rows.select("*", F.sum("impressions").over(by).alias("total_impressions"), *sums).where((F.col("nall") >= days) & (F.col("total_impressions") >= least))
    rows = rows.select("*", *[(F.col(f"{k}all") - F.col(f"{k}left")).alias(f"{k}right") for k in parts])
    mean = lambda name: over(F.col(f"s{name}"), F.col(f"w{name}"))
    var = lambda name: F.greatest(over(F.col(f"q{name}"), F.col(f"w{name}")) - mean(name) * mean(name), F.lit(1e-9))
    llr = F.col("nall") * F.log(var("all")) - F.col("nleft") * F.log(var("left")) - F.col("nright") * F.log(var("right"))
    scored = rows.where((F.col("nleft") >= side) & (F.col("nright") >= side)).select(
        "query", "url", "date", "nall", "total_impressions", F.round(llr, 6).alias("llr"),
        mean("left").alias("left_mean"), mean("right").alias("right_mean"), F.sqrt(var("left")).alias("left_sd"), F.sqrt(var("right")).alias("right_sd"),
    )
    best = F.max_by(F.struct("date", "left_mean", "right_mean", "left_sd", "right_sd"), F.struct(F.col("llr"), -F.unix_date("date")))
    return scored.groupBy("query", "url").agg(F.max("nall").alias("total_days"), F.max("total_impressions").alias("total_impressions"), F.max("llr").alias("llr"), best.alias("at")).where(
        F.col("llr") > threshold
    ).select("query", "url", "total_days", "total_impressions", F.col("at.date").alias("change_date"), "llr", "at.left_mean", "at.right_mean", "at.left_sd", "at.right_sd")


def episodes(facts: Facts, period, least=5, depth=10.0) -> DataFrame:
    """Stays of pairs among the first ``depth`` positions: first day, last day, length, whether it may go on, and cohort."""
    days = daily_pairs(facts, period, least).withColumn("inside", F.col("position") <= depth)
    by = W.partitionBy("query", "url").orderBy("date")
    entry = (F.col("inside") & ~F.coalesce(F.lag("inside").over(by), F.lit(False))).cast("int")
    runs = days.withColumn("entry", entry).where("inside").withColumn("run", F.sum("entry").over(by.rowsBetween(W.unboundedPreceding, 0)))
    stays = runs.groupBy("query", "url", "run").agg(F.min("date").alias("entry_date"), F.max("date").alias("exit_date"))
    end = days.agg(F.max("date").alias("end"))  # one row
    part = F.regexp_extract("url", "^(?:https?://[^/]+)?/([^/?#]+)", 1)
    return stays.crossJoin(F.broadcast(end)).select(
        "query", "url", "entry_date", "exit_date", (F.datediff("exit_date", "entry_date") + 1).alias("tenure"),
        (F.col("exit_date") >= F.date_sub("end", 2)).alias("censored"), F.when(part == "", "home").otherwise(part).alias("cohort"),
    )


def survival(facts: Facts, period, **options) -> DataFrame:
    """Kaplan-Meier curves of the stays, by cohort and for all together."""
    found = episodes(facts, period, **options).select("tenure", "censored", F.explode(F.array("cohort", F.lit("__all__"))).alias("cohort"))
    at = found.groupBy("cohort", "tenure").agg(F.count_if(~F.col("censored")).alias("events"), F.count("*").alias("ending"))
    longest_first = W.partitionBy("cohort").orderBy(F.desc("tenure")).rowsBetween(W.unboundedPreceding, 0)
    risk = at.withColumn("at_risk", F.sum("ending").over(longest_first))
    stay = F.log(F.greatest(1 - F.col("events") / F.col("at_risk"), F.lit(1e-9)))
    shortest_first = W.partitionBy("cohort").orderBy("tenure").rowsBetween(W.unboundedPreceding, 0)
    return risk.select("cohort", "tenure", "events", "at_risk", F.exp(F.sum(stay).over(shortest_first)).alias("survival"))


def device_gap(dates: DataFrame, period) -> DataFrame:
    """Click rate and position by day and device, from the device columns of ``dates``."""
    rows = during(dates, period)
    each = [
        F.struct(F.lit(d.upper()).alias("device"), *[F.coalesce(F.col(f"{m}_{d}").cast("double"), F.lit(0.0)).alias(m) for m in ("clicks", "impressions", "sum_position")])
        for d in DEVICES
    ]
    long = rows.select("date", F.explode(F.array(*each)).alias("d")).select("date", "d.*")
    return long.groupBy("date", "device").agg(*aggregates())


def device_gap_days(dates: DataFrame, period) -> DataFrame:
    """Desktop against mobile, by day."""
    wide = device_gap(dates, period).groupBy("date").pivot("device", ["DESKTOP", "MOBILE"]).agg(F.coalesce(F.max("ctr"), F.lit(0.0)).alias("ctr"), F.coalesce(F.max("position"), F.lit(0.0)).alias("position"))
    return wide.select("date", (F.col("DESKTOP_ctr") - F.col("MOBILE_ctr")).alias("ctr_gap"), (F.col("MOBILE_position") - F.col("DESKTOP_position")).alias("position_gap"))


def filled_days(days: DataFrame, through: str | None = None) -> DataFrame:
    """date, clicks, impressions with a zero row for each missing day up to the last one or ``through``."""
    known = days.groupBy("date").agg(F.sum("clicks").cast("double").alias("clicks"), F.sum("impressions").cast("double").alias("impressions"))
    last = F.greatest(F.max("date"), F.lit(through).cast("date")) if through else F.max("date")
    calendar = known.agg(F.min("date").alias("a"), last.alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("date"))
    return calendar.join(known, "date", "left").select("date", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("clicks", "impressions")])


#: Fixed values of the trajectory rules.
WINDOW_DAYS, RECORD_DAYS, PEAK_CLICKS, PEAK_IMPRESSIONS = 7, 28, 20, 200
CLIFF, CLIFF_DAYS, STAYS_LOW, CLIMB_DAYS, START_SHARE = 0.15, 21, 0.25, 56, 0.25
NEAR_PEAK, DECLINE, GROWTH_BACK, GROWTH_SHARE, DISAGREE = 0.9, 0.7, 56, 0.8, 0.25
OUTLIER_TIMES, OUTLIER_RADIUS, OUTLIER_FLOOR = 3, 7, 3
OVERCOUNT = ("2025-05-13", "2026-04-27")


def rolling_weeks(days: DataFrame, through: str | None = None) -> DataFrame:
    """Seven-day sums of a site's record, as counted and with outlier days cut to three times the median around them.

    One site's days are one window: some hundreds of rows, whatever the size of
    the facts.
    """
    order = W.orderBy("date")
    out = filled_days(days, through).withColumn("i", F.row_number().over(order) - 1)
    for m in ("clicks", "impressions"):
        around = F.percentile(m, F.lit(0.5)).over(order.rowsBetween(-OUTLIER_RADIUS, OUTLIER_RADIUS))
        out = out.withColumn(f"{m}_cut", F.least(F.col(m), F.greatest(OUTLIER_TIMES * around, F.lit(float(OUTLIER_FLOOR)))))
    week = order.rowsBetween(1 - WINDOW_DAYS, 0)
    sums: list[Column] = [
        F.when(F.col("i") >= WINDOW_DAYS - 1, F.sum(f"{m}{cut}").over(week)).alias(f"{m}{cut}_week") for m in ("clicks", "impressions") for cut in ("", "_cut")
    ]
    return out.select("*", *sums)


def trajectory(days: DataFrame, through: str | None = None) -> DataFrame:
    """One row: the shape of a site's record against its best week, and the metric that carries the read."""
    r = rolling_weeks(days, through)
    last = lambda c: F.max_by(c, "i")
    peak = lambda c: F.max_by("i", F.when(F.col(c).isNotNull(), F.struct(F.col(c), F.col("i"))))
    head = r.agg(
        F.count("*").alias("days"), F.min("date").alias("start"), F.min(F.when((F.col("clicks") > 0) | (F.col("impressions") > 0), F.col("i"))).alias("first_i"),
        *[e for m in ("clicks", "impressions") for e in (F.max(f"{m}_cut_week").alias(f"{m}_peak"), peak(f"{m}_cut_week").alias(f"{m}_at"), last(f"{m}_cut_week").alias(f"{m}_last"))],
    )
    enough_c, enough_i = F.col("clicks_peak") >= PEAK_CLICKS, F.col("impressions_peak") >= PEAK_IMPRESSIONS
    peak_day = F.date_add("start", F.col("impressions_at"))
    overcount = (F.date_sub(peak_day, WINDOW_DAYS - 1) <= F.lit(OVERCOUNT[1]).cast("date")) & (peak_day >= F.lit(OVERCOUNT[0]).cast("date"))
    apart = F.abs(over(F.col("clicks_last"), F.col("clicks_peak")) - over(F.col("impressions_last"), F.col("impressions_peak"))) > DISAGREE
    basis = (
        F.when(~enough_c & ~enough_i, F.lit(None)).when(~enough_c, "impressions").when(~enough_i | overcount | F.coalesce(apart, F.lit(False)), "clicks").otherwise("impressions")
    )
    head = head.withColumn("basis", F.when(F.col("days") >= RECORD_DAYS, basis))
    pick = lambda a: F.when(F.col("basis") == "clicks", F.col(f"clicks_{a}")).otherwise(F.col(f"impressions_{a}"))
    met = r.crossJoin(F.broadcast(head.select("*", pick("peak").alias("peak"), pick("at").alias("at"), pick("last").alias("latest"))))
    week = F.when(F.col("basis") == "clicks", F.col("clicks_cut_week")).otherwise(F.col("impressions_cut_week"))
    met = met.withColumn("v", week)
    after = F.col("i") > F.col("at")
    drop = met.groupBy("days", "start", "first_i", "basis", "peak", "at", "latest").agg(
        F.min(F.when(after & (F.col("v") <= CLIFF * F.col("peak")), F.col("i"))).alias("drop_i"),
        F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("i", "v")))).alias("weeks"),
    )
    value = lambda i: F.get(F.filter("weeks", lambda w: w["i"] == i), F.lit(0))["v"]
    from_i = F.coalesce(F.array_max(F.transform(F.filter("weeks", lambda w: (w["i"] > F.col("at")) & (w["i"] < F.col("drop_i")) & (w["v"] >= DECLINE * F.col("peak"))), lambda w: w["i"])), F.col("at"))
    low = ~F.exists("weeks", lambda w: (w["i"] >= F.col("drop_i")) & (w["v"] > STAYS_LOW * F.col("peak")))
    cliff = F.col("drop_i").isNotNull() & (F.col("drop_i") - from_i <= CLIFF_DAYS) & low
    week_one = F.col("first_i") + WINDOW_DAYS - 1
    launch = (F.col("at") - F.col("first_i") <= CLIMB_DAYS) & (week_one < F.col("at")) & F.coalesce(value(week_one) <= START_SHARE * F.col("peak"), F.lit(False))
    ratio = over(F.col("latest"), F.col("peak"))
    before = F.col("days") - 1 - GROWTH_BACK
    growing = (ratio >= NEAR_PEAK) & (before >= WINDOW_DAYS - 1) & F.coalesce(value(before) <= GROWTH_SHARE * F.col("latest"), F.lit(False))
    shape = (
        F.when(F.col("basis").isNull(), "insufficient-data").when(cliff & launch, "launch-honeymoon-then-cliff").when(cliff, "sudden-drop")
        .when(ratio <= DECLINE, "gradual-decline").when(growing, "growing").otherwise("steady")
    )
    known = F.col("basis").isNotNull()
    return drop.select(
        "days", "basis", F.when(known, F.col("peak")).alias("peak_week"), F.when(known, F.col("latest")).alias("latest_week"), F.when(known, ratio).alias("ratio"),
        F.when(known, F.date_add("start", F.col("at"))).alias("peak_end"), F.when(cliff & known, F.col("drop_i") - from_i).alias("drop_days"), shape.alias("shape"),
    )
