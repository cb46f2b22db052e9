"""Row-scoring analyzers: each groups facts, filters the groups and scores what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..metrics import aggregates, clamp, over, position
from ..sources.facts import Facts
from .dealt import pairs_within, running_sum


def during(df: DataFrame, period: tuple[str, str]) -> DataFrame:
    return df.where(F.col("date").between(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date")))


def named(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose dimensions are neither null nor empty."""
    for c in columns:
        df = df.where(F.col(c) != "")
    return df


def pairs(facts: Facts, period: tuple[str, str], least: float = 0) -> DataFrame:
    """query, url and the four metrics, for pairs with at least ``least`` impressions."""
    return during(facts.page_queries, period).groupBy("query", "url").agg(*aggregates()).where(F.col("impressions") >= least)


def striking_distance(facts: Facts, period, low=4.0, high=20.0, least=100, most_ctr=0.05) -> DataFrame:
    """Pairs just below the top results that are seen but seldom clicked."""
    return (
        pairs(facts, period, least)
        .where(F.col("position").between(low, high) & (F.col("ctr") <= most_ctr))
        .withColumn("potential_clicks", F.round(F.col("impressions") * 0.15))
    )


#: Expected click rates of positions 1 to 10, and beyond.
EXPECTED_CTR = (0.30, 0.15, 0.10, 0.07, 0.05, 0.04, 0.03, 0.025, 0.02, 0.015)
EXPECTED_CTR_BEYOND = 0.01


def expected_ctr(rank: Column, table: tuple[float, ...] = EXPECTED_CTR) -> Column:
    at = F.round(clamp(rank, 1.0, float(len(EXPECTED_CTR)))).cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, table)), at - 1), F.lit(EXPECTED_CTR_BEYOND))


def opportunity(facts: Facts, period, least=100, weights=(1.0, 1.0, 1.0)) -> DataFrame:
    """Geometric mean of how near a pair is to page one, how often it is seen and how far its click rate lags."""
    p = F.col("position")
    near = F.when(p <= 3, 0.2).when(p > 50, 0.1).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(p - 11) / 15))
    seen = F.when(F.col("impressions") <= 0, 0.0).otherwise(F.least(F.log10("impressions") / 5, F.lit(1.0)))
    want = expected_ctr(p)
    lag = F.when(F.col("ctr") >= want, 0.0).otherwise(F.least((want - F.col("ctr")) / want, F.lit(1.0)))
    scored = pairs(facts, period, least).select("*", near.alias("position_score"), seen.alias("impression_score"), lag.alias("ctr_gap_score"))
    product = F.lit(1.0)
    for c, w in zip(("position_score", "impression_score", "ctr_gap_score"), weights, strict=True):
        product = product * F.pow(F.col(c), F.lit(w))
    return scored.withColumn("opportunity_score", F.round(F.pow(product, F.lit(1 / sum(weights))) * 100)).withColumn(
        "potential_clicks", F.round(F.col("impressions") * expected_ctr(F.least(p, F.lit(3.0))))
    )


def zero_click(facts: Facts, period, least=1000, deepest=10.0, below_ctr=0.03) -> DataFrame:
    """Often seen on page one and hardly clicked."""
    p = F.col("position")
    usual = F.when(p <= 1, 0.30).when(p <= 3, 0.15).when(p <= 5, 0.08).otherwise(0.04)
    missed = F.greatest(F.lit(0.0), F.round(F.col("impressions") * usual) - F.col("clicks"))
    return pairs(facts, period, least).where((p <= deepest) & (F.col("ctr") < below_ctr)).withColumn("missed_clicks", missed)


def brand_pattern(terms: list[str]) -> str:
    if not terms:
        raise ValueError("brand needs at least one term")
    special = r"\.^$*+?{}[]|()-/"
    return "|".join("".join("\\" + c if c in special else c for c in t.lower()) for t in terms)


def brand(facts: Facts, period, terms: list[str], least=10) -> DataFrame:
    """Pairs by whether their query names the brand, and the totals of both segments.

    The totals are one small aggregate joined back, not a window over all rows.
    """
    rows = pairs(facts, period, least).withColumn(
        "segment", F.when(F.lower("query").rlike(brand_pattern(terms)), "brand").otherwise("non-brand")
    )
    is_brand = F.col("segment") == "brand"
    totals = rows.agg(
        *[F.sum(F.when(is_brand if of == "brand" else ~is_brand, F.col(m)).otherwise(0.0)).alias(f"{of}_{m}") for m in ("clicks", "impressions") for of in ("brand", "non_brand")]
    )
    return rows.crossJoin(F.broadcast(totals))


def cannibalization(facts: Facts, period, least=50, rivals=2) -> DataFrame:
    """Queries that several pages compete for: leader, spread of impressions and clicks lost to weaker pages."""
    agg = named(pairs(facts, period, least), "query", "url")
    whole = agg.groupBy("query").agg(
        F.sum("impressions").alias("total_impressions"), F.sum("clicks").alias("total_clicks"), F.count("*").alias("competitors")
    ).where((F.col("competitors") >= rivals) & (F.col("total_impressions") >= rivals * least))
    first = W.partitionBy("query").orderBy(F.desc("impressions"), F.desc("clicks"), "url")
    ranked = agg.join(whole, "query").select(
        "*",
        (F.col("impressions") / F.nullif("total_impressions", F.lit(0.0))).alias("share"),
        F.first("url").over(first).alias("leader_url"),
        F.first("ctr").over(first).alias("leader_ctr"),
        F.first("position").over(first).alias("leader_position"),
    )
    lost = F.when((F.col("url") != F.col("leader_url")) & (F.col("leader_ctr") > F.col("ctr")), (F.col("leader_ctr") - F.col("ctr")) * F.col("impressions")).otherwise(0.0)
    events = ranked.groupBy("query", "total_impressions", "total_clicks", "competitors", "leader_url", "leader_ctr", "leader_position").agg(
        F.sum(F.pow(F.col("share") * 100, F.lit(2))).alias("hhi"), F.sum(lost).alias("stolen_clicks")
    )
    spread = F.greatest(F.lit(0.0), 1 - F.col("hhi") / 10000)
    taken = F.least(F.col("stolen_clicks") / F.greatest(F.col("total_clicks") + F.col("stolen_clicks"), F.lit(1.0)), F.lit(1.0))
    seen = F.least(F.log10(F.greatest("total_impressions", F.lit(10.0))) / 5, F.lit(1.0))
    return events.select(
        "*", spread.alias("fragmentation"), F.round(F.least(F.lit(100.0), 100 * F.pow(spread * taken * seen, F.lit(1 / 3)))).alias("severity")
    )


def competitor_edges(facts: Facts, period, least=50, rivals=2, most=1000) -> DataFrame:
    """Pairs of pages that compete for the ``most`` gravest queries: for how many, and the impressions of the weaker page.

    The graph is that of a page of findings, so its queries are bounded; a
    query gives an edge for each two of its pages, as the graph has them. The
    pages of a query meet tile by tile (``pairs_within``), and tasks add up the
    edges of their tiles before edges are shuffled.
    """
    agg = named(pairs(facts, period, least), "query", "url")
    kept = cannibalization(facts, period, least, rivals).orderBy(F.desc("severity"), F.desc(F.round("stolen_clicks", 6)), "query").limit(most).select("query")
    rows = agg.join(kept, "query", "left_semi").select("query", "url", "impressions")
    met = pairs_within(rows, "query", "url")
    return met.groupBy(F.col("url").alias("source"), F.col("other_url").alias("target")).agg(F.count("*").alias("queries"), F.sum(F.least("impressions", "other_impressions")).alias("weight"))


#: Words and phrases that open a query and name its intent.
INTENT_PREFIXES = (
    "how to", "what is", "what are", "why is", "why do", "where to", "when to", "best", "top", "vs", "versus", "compare",
    "review", "buy", "cheap", "free", "near me",
)


def clustered_queries(facts: Facts, period, least=10, by="both") -> DataFrame:
    """Queries with their cluster: the intent words they open with, else their first two words if they have three or more."""
    words = F.split(F.lower("query"), r"\s+")
    intent = F.nullif(F.regexp_extract(F.lower("query"), rf"^({'|'.join(INTENT_PREFIXES)})(\s|$)", 1), F.lit(""))
    prefix = F.when(F.size(words) >= 3, F.array_join(F.slice(words, 1, 2), " "))
    none = F.lit(None).cast("string")
    intent, prefix = (intent if by != "prefix" else none), (prefix if by != "intent" else none)
    agg = during(facts.queries, period).groupBy("query").agg(*aggregates()).where(F.col("impressions") >= least)
    keyed = agg.select("*", F.coalesce(intent, prefix).alias("cluster"), F.when(intent.isNotNull(), "intent").otherwise("prefix").alias("kind"))
    return keyed.where("cluster IS NOT NULL")


def clustering(facts: Facts, period, least=10, smallest=2, by="both") -> DataFrame:
    """Clusters of queries that open alike."""
    return clustered_queries(facts, period, least, by).groupBy("cluster").agg(
        F.min("kind").alias("cluster_type"),
        F.count("*").alias("keyword_count"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("impressions").alias("total_impressions"),
        (over(F.sum((F.col("position") - 1) * F.col("impressions")), F.sum("impressions")) + 1).alias("avg_position"),
    ).where(F.col("keyword_count") >= smallest)


def concentration(facts: Facts, period, dimension="pages", top=10) -> DataFrame:
    """One row: Gini coefficient, Herfindahl index and the share of the top items among those with clicks.

    Items are counted by their clicks, and ranks follow from running sums over
    ranges of distinct click counts (``running_sum``), so no task orders them all.
    """
    source, key = (facts.queries, "query") if dimension == "keywords" else (facts.pages, "url")
    items = during(source, period).groupBy(F.col(key).alias("key")).agg(F.sum("clicks").cast("double").alias("clicks")).where("clicks > 0")
    ranked = running_sum(items.groupBy("clicks").agg(F.count("*").alias("n")), "clicks", "n", "below")
    total = ranked.agg(F.sum(F.col("n") * F.col("clicks")).alias("total"), F.sum("n").alias("items"))
    # n items with equal clicks hold ranks below + 1 to below + n.
    ranks = F.col("n") * F.col("below") + F.col("n") * (F.col("n") + 1) / 2
    sums = ranked.crossJoin(F.broadcast(total)).withColumn("over", F.col("items") - F.col("below") - F.col("n")).agg(
        F.sum((2 * ranks - F.col("n") * (F.col("items") + 1)) * F.col("clicks")).alias("weighted"),
        F.sum(F.col("n") * F.pow(100 * F.col("clicks") / F.col("total"), F.lit(2))).alias("h"),
        F.sum(F.col("clicks") * F.greatest(F.lit(0), F.least("n", F.lit(top) - F.col("over")))).alias("top_clicks"),
        F.max("total").alias("total"),
        F.max("items").alias("items"),
    )
    zero = F.lit(0.0)
    hhi = F.coalesce("h", zero)
    return sums.select(
        F.coalesce(over(F.col("weighted"), F.col("items") * F.col("total")), zero).alias("gini"),
        hhi.alias("hhi"),
        F.coalesce(over(F.col("top_clicks"), F.col("total")), zero).alias("top_share"),
        F.coalesce("items", F.lit(0)).cast("long").alias("total_items"),
        F.coalesce("total", zero).alias("total_clicks"),
        F.when(hhi > 2500, "high").when(hhi > 1500, "medium").otherwise("low").alias("risk"),
    )


def long_tail(facts: Facts, period, least=5, fewest=10) -> DataFrame:
    """Slope of log impressions over log rank of each page's queries."""
    rows = named(pairs(facts, period, least), "query", "url")
    rank = F.row_number().over(W.partitionBy("url").orderBy(F.desc("impressions"), "query"))
    logs = rows.withColumn("rank", rank).select("*", F.log("rank").alias("x"), F.log("impressions").alias("y"))
    fit = logs.groupBy("url").agg(
        F.count("*").alias("query_count"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.max("impressions").alias("head_impressions"),
    ).where(F.col("query_count") >= fewest)
    shape = F.when(F.col("slope") > -0.6, "flat-tail").when(F.col("slope") > -1.2, "balanced").otherwise("head-heavy")
    return fit.select("*", over(F.col("head_impressions"), F.col("total_impressions")).alias("head_share"), shape.alias("fingerprint"))


#: Words that name no topic.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "of", "to", "in", "for", "on", "and", "or", "with", "at", "by",
    "from", "into", "about", "as", "so", "than", "then", "that", "this", "my", "your", "our", "their", "his", "her", "its", "me",
    "you", "what", "how", "why", "when", "where", "who", "which", "do", "does",
)


def atlas_queries(facts: Facts, period, least=20, token_least=50) -> DataFrame:
    """Queries with their two weightiest words as cluster."""
    rows = during(named(facts.queries, "query"), period).groupBy("query").agg(*aggregates("impressions", "clicks", "position")).where(F.col("impressions") >= least)
    tokens = rows.select("query", "impressions", F.explode(F.split(F.lower("query"), r"\s+")).alias("token")).where(
        (F.length("token") >= 3) & ~F.col("token").isin(*STOP_WORDS)
    )
    weights = tokens.groupBy("token").agg(F.sum("impressions").alias("weight")).where(F.col("weight") >= token_least)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("weight"), "token"))
    keys = (
        tokens.join(weights, "token").withColumn("place", place).where("place <= 2")
        .groupBy("query").agg(F.sort_array(F.collect_list("token")).alias("two")).where(F.size("two") >= 2)
        .select("query", F.array_join("two", " + ").alias("cluster"))
    )
    return rows.join(keys, "query")


def intent_atlas(facts: Facts, period, least=20, token_least=50, smallest=3) -> DataFrame:
    """Clusters of queries that share their two weightiest words."""
    return atlas_queries(facts, period, least, token_least).groupBy("cluster").agg(
        F.count("*").alias("keyword_count"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
        over(F.sum("clicks"), F.sum("impressions")).alias("ctr"),
        (over(F.sum((F.col("position") - 1) * F.col("impressions")), F.sum("impressions")) + 1).alias("avg_position"),
    ).where(F.col("keyword_count") >= smallest)


def bayesian_ctr(facts: Facts, period, least=50, deepest=30, prior_from=5) -> DataFrame:
    """Click rates shrunk towards those of pairs at the same rank, with 95 % intervals."""
    rows = named(pairs(facts, period, least), "query", "url").where(F.col("position") <= deepest)
    rows = rows.withColumn("bucket", F.round(F.least("position", F.lit(float(deepest)))).cast("int"))
    mean = rows.groupBy("bucket").agg(F.count("*").alias("n"), over(F.sum(F.col("ctr") * F.col("impressions")), F.sum("impressions")).alias("mu"))
    spread = rows.join(F.broadcast(mean), "bucket").groupBy("bucket", "n", "mu").agg(
        F.greatest(over(F.sum(F.col("impressions") * F.pow(F.col("ctr") - F.col("mu"), F.lit(2))), F.sum("impressions")), F.lit(1e-9)).alias("v")
    )  # at most ``deepest`` rows
    weight = F.col("mu") * (1 - F.col("mu")) / F.col("v") - 1
    fits = (F.col("n") >= prior_from) & (F.col("mu") > 0) & (F.col("mu") < 1) & (weight > 0)
    prior = spread.select(
        "bucket", "mu",
        F.when(fits, F.greatest(F.lit(0.5), F.col("mu") * weight)).otherwise(2.0).alias("prior_alpha"),
        F.when(fits, F.greatest(F.lit(0.5), (1 - F.col("mu")) * weight)).otherwise(48.0).alias("prior_beta"),
    )
    a, b = F.col("prior_alpha") + F.col("clicks"), F.col("prior_beta") + F.col("impressions") - F.col("clicks")
    post = rows.join(F.broadcast(prior), "bucket").select("*", (a / (a + b)).alias("posterior_mean"), F.sqrt(a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1))).alias("posterior_sd"))
    low = F.greatest(F.lit(0.0), F.col("posterior_mean") - 1.96 * F.col("posterior_sd"))
    high = F.least(F.lit(1.0), F.col("posterior_mean") + 1.96 * F.col("posterior_sd"))
    return post.select(
        "query", "url", "clicks", "impressions", "ctr", "position", "bucket", "prior_alpha", "prior_beta", "posterior_mean", "posterior_sd",
        low.alias("ci_low"), high.alias("ci_high"),
        ((F.col("posterior_mean") - F.col("ctr")) * F.col("impressions")).alias("expected_clicks_delta"),
        over(F.abs(F.col("ctr") - F.col("posterior_mean")), F.col("posterior_sd")).alias("significance"),
        F.when(F.col("ctr") > high, "overperforming").when(F.col("ctr") < low, "underperforming").otherwise("expected").alias("classification"),
    )


def position_distribution(facts: Facts, period) -> DataFrame:
    p = F.col("sum_position") / F.col("impressions") + 1
    return during(facts.queries, period).where("impressions > 0").groupBy("date").agg(
        F.count_if(p <= 3).alias("pos_1_3"),
        F.count_if((p > 3) & (p <= 10)).alias("pos_4_10"),
        F.count_if((p > 10) & (p <= 20)).alias("pos_11_20"),
        F.count_if(p > 20).alias("pos_20_plus"),
        F.count("*").alias("total"),
    )


def ctr_curve(facts: Facts, period) -> DataFrame:
    """Click rate by band of positions."""
    p = F.col("sum_position") / F.col("impressions") + 1
    band = F.lit("20+")
    for most, name in ((20.5, "11-20"), (10.5, "6-10"), (5.5, "4-5"), (3.5, "3"), (2.5, "2"), (1.5, "1")):
        band = F.when(p <= most, name).otherwise(band)
    rows = during(facts.queries, period).where("impressions > 0")
    return rows.groupBy(band.alias("bucket")).agg(
        F.avg(F.col("clicks") / F.col("impressions")).alias("avg_ctr"),
        position().alias("median_position"),
        F.countDistinct("query").alias("keyword_count"),
        *[c.alias(f"total_{n}") for c, n in zip(aggregates("clicks", "impressions"), ("clicks", "impressions"), strict=True)],
    )


def ctr_outliers(facts: Facts, period, least=20, most=50) -> DataFrame:
    """Queries whose click rate is farthest from the mean of their band."""
    agg = during(facts.queries, period).where("impressions > 0").groupBy("query").agg(*aggregates()).where(F.col("impressions") >= least)
    p = F.col("position")
    banded = agg.withColumn("band", F.when(p <= 3.5, "top3").when(p <= 10.5, "page1").when(p <= 20.5, "page2").otherwise("deep"))
    mean = banded.groupBy("band").agg(F.avg("ctr").alias("expected_ctr"))  # four rows
    found = banded.join(F.broadcast(mean), "band").withColumn("ctr_diff", F.col("ctr") - F.col("expected_ctr"))
    return found.orderBy(F.desc(F.round(F.abs("ctr_diff"), 9)), "query").limit(most)


def dark_traffic(facts: Facts, period) -> DataFrame:
    """Clicks of pages that no query accounts for."""
    whole = during(facts.pages, period).groupBy("url").agg(F.sum("clicks").cast("double").alias("total_clicks")).where("total_clicks > 0")
    known = during(facts.page_queries, period).groupBy("url").agg(
        F.sum("clicks").cast("double").alias("attributed"), F.countDistinct("query").alias("keywords")
    )
    told = F.coalesce("attributed", F.lit(0.0))
    return whole.join(known, "url", "left").select(
        "url", "total_clicks", told.alias("attributed_clicks"), (F.col("total_clicks") - told).alias("dark_clicks"),
        over(F.col("total_clicks") - told, F.col("total_clicks")).alias("dark_percent"), F.coalesce("keywords", F.lit(0)).alias("keyword_count"),
    ).where("dark_clicks > 0")


def keyword_breadth(facts: Facts, period) -> DataFrame:
    """Each page with its number of distinct queries and the class that gives it."""
    n = F.col("keyword_count")
    rows = during(facts.page_queries, period).where("impressions > 0").groupBy("url").agg(F.countDistinct("query").alias("keyword_count"), *aggregates("clicks", "impressions"))
    bucket = F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 15, "6-15").when(n <= 50, "16-50").otherwise("50+")
    return rows.select("*", bucket.alias("bucket"), ((n <= 2) & (F.col("clicks") >= 5)).alias("fragile"), (n >= 20).alias("authority"))


def keyword_breadth_summary(facts: Facts, period) -> DataFrame:
    return keyword_breadth(facts, period).groupBy("bucket").agg(F.count("*").alias("page_count"), F.min("keyword_count").alias("sort_key"))
