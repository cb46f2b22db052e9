"""Analyzers that compare two periods or follow entities over weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..metrics import aggregates, over, percent_change
from ..sources.facts import Facts
from ..sources.staging import staged
from .scoring import during, named

#: Most edits between two queries that still count as the same.
EDITS = 2
#: Pairs that may meet in one piece before a second one must be shared.
HEAVY_PAIRS = 100_000


def either(df: DataFrame, now: tuple[str, str], before: tuple[str, str]) -> DataFrame:
    """Rows of both periods; rows in both count once."""
    inside = lambda p: F.col("date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))
    return df.where(inside(now) | inside(before))


def both_periods(df: DataFrame, keys: list[str], now, before) -> DataFrame:
    """One row per key with now_* and before_* sums from a single scan; positions are null in a period without rows."""
    inside = lambda p: F.col("date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))
    sums = [F.sum(F.when(inside(p), F.col(m))).alias(f"{n}_{m}") for n, p in (("now", now), ("before", before)) for m in ("clicks", "impressions", "sum_position")]
    rows = either(df, now, before).groupBy(*keys).agg(*sums)
    made: list[Column] = []
    for n in ("now", "before"):
        made += [F.coalesce(F.col(f"{n}_{m}").cast("double"), F.lit(0.0)).alias(f"{n}_{m}") for m in ("clicks", "impressions")]
        made.append((over(F.col(f"{n}_sum_position"), F.col(f"{n}_impressions")) + 1).alias(f"{n}_position"))
    return rows.select(*keys, *made)


def movers(facts: Facts, now, before, least=50, threshold=0.2) -> DataFrame:
    """Pairs of either period with their changes and direction."""
    change = F.col("clicks_change_percent")
    direction = (
        F.when((change > 0) & (F.abs(change) / 100 >= threshold), "rising")
        .when((change < 0) & (F.abs(change) / 100 >= threshold), "declining")
        .otherwise("stable")
    )
    rows = both_periods(facts.page_queries, ["query", "url"], now, before).where(F.greatest("now_impressions", "before_impressions") >= least)
    return rows.select(
        "*",
        (F.col("now_clicks") - F.col("before_clicks")).alias("clicks_change"),
        percent_change(F.col("now_clicks"), F.col("before_clicks")).alias("clicks_change_percent"),
        (F.col("now_impressions") - F.col("before_impressions")).alias("impressions_change"),
        percent_change(F.col("now_impressions"), F.col("before_impressions")).alias("impressions_change_percent"),
        (F.col("now_position") - F.col("before_position")).alias("position_change"),
    ).withColumn("direction", direction)


def movers_top(facts: Facts, now, before, direction: str | None = None, limit=2000, **options) -> DataFrame:
    """The movers with the largest change in clicks."""
    found = movers(facts, now, before, **options)
    kept = found.where(F.col("direction") == direction) if direction else found.where("direction <> 'stable'")
    return kept.orderBy(F.desc(F.abs("clicks_change")), "query", "url").limit(limit)


def weekly_series(facts: Facts, selected: DataFrame, now, before) -> DataFrame:
    """query, url, week and sums of the selected pairs over both periods."""
    rows = either(facts.page_queries, now, before).join(selected.select("query", "url"), ["query", "url"], "left_semi")
    return rows.groupBy("query", "url", F.date_trunc("week", "date").cast("date").alias("week")).agg(*aggregates("clicks", "impressions"))


def decay(facts: Facts, now, before, least_clicks=50, threshold=0.2) -> DataFrame:
    """Pages that had clicks before and lost a good part of them."""
    lost = F.col("before_clicks") - F.col("now_clicks")
    return (
        both_periods(facts.page_queries, ["url"], now, before)
        .where(F.col("before_clicks") >= least_clicks)
        .select(
            "url", "now_clicks", "before_clicks", lost.alias("lost_clicks"), over(lost, F.col("before_clicks")).alias("decline_percent"),
            "now_position", "before_position", (F.col("now_position") - F.col("before_position")).alias("position_drop"),
        )
        .where((F.col("decline_percent") >= threshold) & (F.col("lost_clicks") > 0))
    )


def trends(facts: Facts, period, weeks=28, dimension="pages", least=100) -> DataFrame:
    """Growth and slope of weekly clicks; with an odd number of weeks the middle one counts to the first half."""
    source, key = (facts.queries, "query") if dimension == "keywords" else (facts.pages, "url")
    weekly = during(source, period).groupBy(F.col(key).alias("entity"), F.date_trunc("week", "date").cast("date").alias("week")).agg(
        *aggregates("clicks", "impressions"), F.sum("sum_position").alias("sum_position")
    )
    by = W.partitionBy("entity")
    placed = weekly.select("*", (F.row_number().over(by.orderBy("week")) - 1).cast("double").alias("i"), F.count("*").over(by).alias("n"))
    first = F.col("i") < F.col("n") / 2
    rows = placed.groupBy("entity").agg(
        F.sum("clicks").alias("total_clicks"),
        F.sum("impressions").alias("total_impressions"),
        F.max("n").alias("weeks"),
        F.coalesce(F.regr_slope("clicks", "i"), F.lit(0.0)).alias("slope"),
        F.sum(F.when(first, F.col("clicks")).otherwise(0.0)).alias("early"),
        F.sum(F.when(first, 0.0).otherwise(F.col("clicks"))).alias("late"),
        (over(F.sum("sum_position"), F.sum("impressions")) + 1).alias("avg_position"),
    ).where((F.col("total_impressions") >= least) & (F.col("weeks") >= max(2, weeks // 4)))
    ratio = F.when(F.col("early") == 0, F.when(F.col("late") > 0, 10.0).otherwise(1.0)).otherwise(over(F.col("late"), F.col("early")))
    r, s = F.col("growth_ratio"), F.col("slope")
    trend = (
        F.when((r >= 1.5) & (s > 0), "accelerating").when((r >= 1.1) & (s >= 0), "growing").when(r < 0.5, "cratering")
        .when((r < 0.9) & (s < 0), "declining").otherwise("steady")
    )
    return rows.withColumn("growth_ratio", ratio).select("entity", "total_clicks", "total_impressions", "weeks", "slope", "growth_ratio", "avg_position", trend.alias("trend"))


def query_migration(facts: Facts, now, before, least=20) -> DataFrame:
    """Queries that left one page and came up at another, equal or nearly so, by pair of pages.

    Equal queries meet in an equi-join on the query. Near ones are blocked: two
    words within EDITS letters share at least one of EDITS + 1 pieces of the shorter's
    length class at a shift of at most EDITS, so candidates come from joins on
    (length, piece) and never from all pairs of a length.
    """
    inside = lambda p: F.col("date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))
    seen = lambda p: F.sum(F.when(inside(p), F.col("impressions"))).cast("double")
    both = named(either(facts.page_queries, now, before), "query", "url").groupBy("query", "url").agg(seen(before).alias("a"), seen(now).alias("b"))
    was, is_there = (F.coalesce(F.col(c) >= least, F.lit(False)) for c in ("a", "b"))
    # The facts are read once; what follows uses these rows many times.
    moved = staged(both.where(was != is_there).withColumn("left", was))
    lost = moved.where("left").select(F.col("url").alias("source"), F.col("query").alias("gone"), "a")
    gained = moved.where("NOT left").select(F.col("url").alias("target"), F.col("query").alias("come"), "b")
    words = lost.select("gone").distinct().join(near_words(lost.select(F.col("gone").alias("x")), gained.select(F.col("come").alias("y"))), F.col("gone") == F.col("x")).drop("x")
    same = lost.select("gone").distinct().join(gained.select("come").distinct(), F.col("gone") == F.col("come"))
    matches = same.unionByName(words.withColumnRenamed("y", "come"))
    absorbed = F.least("a", "b")
    return (
        lost.join(matches, "gone").join(gained, "come").where("source <> target")
        .groupBy("source", "target")
        .agg(F.sum(absorbed).alias("weight"), F.count("*").alias("query_count"), F.count_if(F.col("gone") == F.col("come")).alias("exact_count"))
    )


def near_words(left: DataFrame, right: DataFrame, edits: int = EDITS, heavy: int = HEAVY_PAIRS) -> DataFrame:
    """(x, y): different words within ``edits`` edits.

    x is cut into edits + 1 pieces by its length; edits can touch all but one of
    them, and the untouched piece stands in y at most ``edits`` places off. A
    piece in which more than ``heavy`` pairs would meet, as a common beginning,
    is split by a second key: of the halves of the other pieces, edits can touch all
    but two, so the words also share one of those, again at most ``edits`` places
    off. Words too short to be cut are looked up by length alone, of which
    there are few.
    """
    n = edits + 1
    xs = left.select("x").distinct().withColumn("lx", F.length("x"))
    ys = right.select("y").distinct().withColumn("ly", F.length("y"))
    begin = lambda k, size: F.floor(size * k / n).cast("int")
    piece = lambda word, at, size: F.substring(word, at + 1, size)
    x_keys = xs.where(F.col("lx") >= n).select(
        "x", "lx", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), piece(F.col("x"), begin(k, F.col("lx")), begin(k + 1, F.col("lx")) - begin(k, F.col("lx"))).alias("piece")) for k in range(n)])).alias("key")
    ).select("x", "lx", "key.*")
    sized = ys.withColumn("lx", F.explode(F.sequence(F.greatest(F.lit(n), F.col("ly") - edits), F.col("ly") + edits)))
    shifted = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.when(begin(k, F.col("lx")) + d >= 0, piece(F.col("y"), begin(k, F.col("lx")) + d, begin(k + 1, F.col("lx")) - begin(k, F.col("lx")))).alias("piece"))
            for k in range(n)
            for d in range(-edits, edits + 1)
        ]
    )
    y_keys = sized.where("ly + 2 >= lx").select("y", "lx", F.explode(shifted).alias("key")).select("y", "lx", "key.*").where("piece IS NOT NULL").distinct()
    key = ["lx", "k", "piece"]
    many = x_keys.groupBy(key).agg(F.count("*").alias("nx")).join(y_keys.groupBy(key).agg(F.count("*").alias("ny")), key).where(F.col("nx") * F.col("ny") > heavy).select(key)
    many = staged(many)
    plain = x_keys.join(many, key, "left_anti").join(y_keys, key).select("x", "y")
    # Half h of piece j: of the halves of the other pieces, edits leave at least one as it is, too.
    half = lambda j, h: begin(j, F.col("lx")) + F.floor((begin(j + 1, F.col("lx")) - begin(j, F.col("lx"))) * h / 2).cast("int")
    place = lambda j, h, word, d: F.struct(F.lit(j).alias("j"), F.lit(h).alias("h"), F.when(half(j, h) + d >= 0, piece(word, half(j, h) + d, half(j, h + 1) - half(j, h))).alias("second"))
    halves = [(j, h) for j in range(n) for h in range(2)]
    x_seconds = x_keys.join(many, key, "left_semi").select("x", *key, F.explode(F.array(*[place(j, h, F.col("x"), 0) for j, h in halves])).alias("s"))
    y_seconds = y_keys.join(many, key, "left_semi").select("y", *key, F.explode(F.array(*[place(j, h, F.col("y"), d) for j, h in halves for d in range(-edits, edits + 1)])).alias("s"))
    seconds = [t.select(w, *key, "s.*").where("j <> k AND second IS NOT NULL").distinct() for t, w in ((x_seconds, "x"), (y_seconds, "y"))]
    cut = plain.unionByName(seconds[0].join(seconds[1], [*key, "j", "h", "second"]).select("x", "y"))
    short = xs.where(F.col("lx") < n).join(ys.where(F.col("ly") < n + edits).withColumn("lx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ly") - edits), F.col("ly") + edits))), "lx").select("x", "y")
    return cut.unionByName(short).distinct().where((F.col("x") != F.col("y")) & F.levenshtein("x", "y", edits).between(0, edits))


def content_velocity(facts: Facts, period) -> DataFrame:
    """Distinct queries of each ISO week, and those never seen before in the period."""
    rows = during(facts.queries, period).where("impressions > 0").select("query", "date")
    week = lambda c: F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
    total = rows.groupBy(week(F.col("date")).alias("week")).agg(F.countDistinct("query").alias("total_keywords"))
    first = rows.groupBy("query").agg(F.min("date").alias("date"))
    new = first.groupBy(week(F.col("date")).alias("week")).agg(F.count("*").alias("new_keywords"))
    return total.join(new, "week", "left").select("week", F.coalesce("new_keywords", F.lit(0)).cast("long").alias("new_keywords"), "total_keywords")
