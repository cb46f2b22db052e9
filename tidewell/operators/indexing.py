"""Inspections, coverage states, canonical addresses and sitemaps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..metrics import over

#: What a search engine says of a page's coverage, by tag.
COVERAGE = {
    "unknown_to_google": ["URL is unknown to Google"],
    "discovered_not_indexed": ["Discovered - currently not indexed"],
    "crawled_not_indexed": ["Crawled - currently not indexed"],
    "indexed": ["Submitted and indexed", "Indexed, not submitted in sitemap", "Indexed, though blocked by robots.txt", "Indexed; consider marking as canonical", "Page indexed without content"],
    "noindex": ["Excluded by ‘noindex’ tag", "Excluded by 'noindex' tag"],
    "blocked_robots": ["Blocked by robots.txt"],
    "soft_404": ["Soft 404"],
    "not_found": ["Not found (404)"],
    "server_error": ["Server error (5xx)"],
    "access_denied": ["Blocked due to unauthorized request (401)"],
    "access_forbidden": ["Blocked due to access forbidden (403)"],
    "blocked_4xx": ["Blocked due to other 4xx issue"],
    "redirect": ["Page with redirect"],
    "redirect_error": ["Redirect error"],
    "alternate_canonical": ["Alternate page with proper canonical tag"],
    "duplicate_no_canonical": ["Duplicate without user-selected canonical"],
    "duplicate_google_canonical": ["Duplicate, Google chose different canonical than user"],
    "page_removed": ["Blocked by page removal tool"],
}
STATE_FIELDS = ("verdict", "coverage_state", "indexing_state", "robots_txt_state", "page_fetch_state", "google_canonical")


def coverage_tag(prose: Column) -> Column:
    tags = F.create_map(*[F.lit(x) for tag, texts in COVERAGE.items() for t in texts for x in (t, tag)])
    text = F.trim(prose)
    return F.when(F.coalesce(text, F.lit("")) == "", "not_reported").otherwise(F.coalesce(F.try_element_at(tags, text), F.lit("unrecognized")))


def coverage_counts(inspections: DataFrame) -> DataFrame:
    """(tag, n) of every tag, zeros too."""
    spark = inspections.sparkSession
    known = spark.createDataFrame([(t,) for t in (*COVERAGE, "not_reported", "unrecognized")], "tag string")
    counts = inspections.groupBy(coverage_tag(F.col("coverage_state")).alias("tag")).agg(F.count("*").alias("n"))
    return known.join(counts, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def canonical_kind(user: Column, chosen: Column) -> Column:
    """none, formatting, path or cross_domain: how the declared canonical differs from the chosen one."""
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, "^https?://([^/?#]+)", 1)), "^www[.]", "")
    rest = lambda u: F.regexp_replace(F.regexp_replace(u, "^https?://[^/?#]+", ""), "/*(#.*)?$", "")
    bad = (host(user) == "") | (host(chosen) == "")
    return (
        F.when(F.coalesce(user, F.lit("")).eqNullSafe("") | F.coalesce(chosen, F.lit("")).eqNullSafe("") | (user == chosen), "none")
        .when(bad, "path").when(host(user) != host(chosen), "cross_domain").when(rest(user) == rest(chosen), "formatting").otherwise("path")
    )


def latest(inspections: DataFrame) -> DataFrame:
    """The newest inspection of each url; of several at one moment, the one with the largest hash."""
    newest = F.row_number().over(W.partitionBy("url").orderBy(F.desc("inspected_at"), F.desc(F.xxhash64(*inspections.columns))))
    return inspections.withColumn("n", newest).where("n = 1").drop("n")


def transitions(inspections: DataFrame, fields: tuple[str, ...] = STATE_FIELDS) -> DataFrame:
    """Inspections that differ from the one before in any state field, nulls compared as values; one of each url and moment.

    Those of one moment come in the order of their hashes, so reruns agree.
    """
    tie = F.xxhash64(*inspections.columns)
    by = W.partitionBy("url").orderBy("inspected_at", tie)
    used = [f for f in fields if f in inspections.columns]
    rows = inspections.select("*", F.lag("inspected_at").over(by).alias("previous_at"), *[F.lag(f).over(by).alias(f"previous_{f}") for f in used])
    changed = F.lit(False)
    for f in used:
        changed = changed | ~F.col(f).eqNullSafe(F.col(f"previous_{f}"))
    first = F.row_number().over(W.partitionBy("url", "previous_at").orderBy("inspected_at", tie))
    return rows.where(F.col("previous_at").isNotNull() & changed).withColumn("_n", first).where("_n = 1").drop("_n")


def issue_conditions(today: Column) -> dict[str, Column]:
    """The filter of each kind of indexing issue; the states it names are fixed values."""
    state, fetch = F.col("coverage_state"), F.col("page_fetch_state")
    older = lambda n: F.col("last_crawl_time").cast("date") < F.date_sub(today, n)
    both: Callable[[str, str], Column] = lambda f, tag: (fetch == f) | (state == COVERAGE[tag][0])
    says = lambda tag: state == COVERAGE[tag][0]
    return {
        "canonical_mismatch": F.col("canonical_kind") == "path", "canonical_cross_domain": F.col("canonical_kind") == "cross_domain",
        "canonical_formatting": F.col("canonical_kind") == "formatting", "stale_crawl": older(30), "very_stale_crawl": older(60),
        "not_indexed": F.col("verdict").isin("FAIL", "PARTIAL", "NEUTRAL"), "unknown_to_google": says("unknown_to_google"),
        "crawled_not_indexed": says("crawled_not_indexed"), "discovered_not_indexed": says("discovered_not_indexed"),
        "not_found": both("NOT_FOUND", "not_found"), "soft_404": both("SOFT_404", "soft_404"), "server_error": both("SERVER_ERROR", "server_error"),
        "access_forbidden": both("ACCESS_FORBIDDEN", "access_forbidden"), "access_denied": both("ACCESS_DENIED", "access_denied"),
        "blocked_4xx": both("BLOCKED_4XX", "blocked_4xx"), "redirect_error": both("REDIRECT_ERROR", "redirect_error"),
        "crawl_error": fetch.isin("INTERNAL_CRAWL_ERROR", "INVALID_URL"), "blocked_robots": F.col("robots_txt_state") == "DISALLOWED",
        "noindex": F.col("indexing_state").contains("noindex") | state.contains("noindex"), "redirect": says("redirect"),
        "sitemap_redirect": says("redirect") & (F.col("sitemaps") != "[]"), "alternate_canonical": says("alternate_canonical"),
        "duplicate_no_canonical": says("duplicate_no_canonical"), "indexed_consider_canonical": state == COVERAGE["indexed"][3],
        "page_removed": says("page_removed"), "fragment_url": F.col("url").contains("#"), "mobile_fail": F.col("mobile_verdict").isin("FAIL", "PARTIAL"),
        "rich_results_fail": F.col("rich_results_verdict") == "FAIL", "rich_results_warning": F.col("rich_results_verdict") == "PARTIAL",
        "rich_results_pass": F.col("rich_results_verdict") == "PASS",
    }


#: What each issue is called and how grave it is.
ISSUES = {
    "canonical_mismatch": ("Canonical mismatch", "warning"), "canonical_cross_domain": ("Cross-domain canonical", "error"),
    "canonical_formatting": ("Canonical formatting differs", "info"), "stale_crawl": ("Not crawled in 30+ days", "info"),
    "very_stale_crawl": ("Not crawled in 60+ days", "warning"), "not_indexed": ("Not indexed", "error"),
    "unknown_to_google": ("Unknown to Google", "warning"), "crawled_not_indexed": ("Crawled, not indexed", "error"),
    "discovered_not_indexed": ("Discovered, not indexed", "warning"), "not_found": ("404 Not Found", "error"), "soft_404": ("Soft 404", "error"),
    "server_error": ("Server error", "error"), "access_forbidden": ("Blocked: forbidden (403)", "error"),
    "access_denied": ("Blocked: unauthorized (401)", "error"), "blocked_4xx": ("Blocked: other 4xx", "error"), "redirect_error": ("Redirect error", "error"),
    "crawl_error": ("Crawl error", "warning"), "blocked_robots": ("Blocked by robots.txt", "warning"), "noindex": ("Noindex tag", "info"),
    "redirect": ("Redirect", "info"), "sitemap_redirect": ("Sitemap URL redirects", "warning"), "alternate_canonical": ("Alternate page with canonical", "info"),
    "duplicate_no_canonical": ("Duplicate, no canonical declared", "warning"), "indexed_consider_canonical": ("Indexed, Google suggests a canonical", "info"),
    "page_removed": ("Removed via removal tool", "info"), "fragment_url": ("Fragment URL (#)", "warning"), "mobile_fail": ("Mobile usability issues", "warning"),
    "rich_results_fail": ("Rich results errors", "error"), "rich_results_warning": ("Rich results warnings", "warning"), "rich_results_pass": ("Has rich results", "info"),
}
ISSUE_COLUMNS = (
    "canonical_kind", "last_crawl_time", "verdict", "coverage_state", "page_fetch_state", "robots_txt_state", "indexing_state", "sitemaps", "url",
    "mobile_verdict", "rich_results_verdict",
)


def issue_counts(inspections: DataFrame, today: str) -> DataFrame:
    """(issue, n): one scan counts every kind; columns that are missing count as null."""
    rows = inspections.select(*[(F.col(c) if c in inspections.columns else F.lit(None).cast("string").alias(c)) for c in ISSUE_COLUMNS])
    found = issue_conditions(F.lit(today).cast("date"))
    sums = rows.agg(*[F.count_if(c).alias(k) for k, c in found.items()])
    return sums.unpivot([], list(found), "issue", "n")


def labelled_issues(counts: DataFrame) -> DataFrame:
    """``counts`` (issue, n) with label and severity."""
    table = counts.sparkSession.createDataFrame([(k, label, severity) for k, (label, severity) in ISSUES.items()], "issue string, label string, severity string")
    return counts.join(F.broadcast(table), "issue")


@dataclass(frozen=True)
class CollapsePolicy:
    """A count has collapsed if the most before it is at least ``least``, it is under ``ratio`` of that, and it fell by ``drop`` or more; the newest ``skip`` counts set no mark."""

    ratio: float
    least: int
    drop: int
    skip: int

    def collapsed(self, count: Column, mark: Column) -> Column:
        return (mark >= self.least) & (count < mark * self.ratio) & (mark - count >= self.drop)


#: When a sync stops to ask, and when trust in a sitemap ends.
SYNC_COLLAPSE, TRUST_COLLAPSE = CollapsePolicy(0.5, 10, 10, 1), CollapsePolicy(0.2, 20, 0, 2)


def sitemap_collapse(counts: DataFrame, policy: CollapsePolicy = TRUST_COLLAPSE) -> DataFrame:
    """State of each sitemap by its counts (feed, date, urls): feed, state, current, high_water, now_collapsed, ever_collapsed.

    The newest count is held against the most of the older ones. A drop waits
    for a second low count (awaiting_confirmation), then persists; one that has
    risen again was a blip (recovered_blip); else none. now_collapsed compares
    the newest count with all before it, and is null for a single one;
    ever_collapsed tells whether any count fell so against those before it.
    Null and negative counts are zero.
    """
    newest = W.partitionBy("feed").orderBy(F.desc("date"))
    older = W.partitionBy("feed").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    rows = counts.select("feed", "date", F.greatest(F.coalesce("urls", F.lit(0)), F.lit(0)).alias("urls"))
    rows = rows.select("*", F.row_number().over(newest).alias("n"), F.coalesce(F.max("urls").over(older), F.lit(0)).alias("before"))
    at = lambda n: F.max(F.when(F.col("n") == n, F.col("urls")))
    sums = rows.groupBy("feed").agg(
        F.count("*").alias("k"), at(1).alias("current"), F.coalesce(at(2), F.lit(0)).alias("previous"), F.coalesce(F.max(F.when(F.col("n") > policy.skip, F.col("urls"))), F.lit(0)).alias("high_water"),
        F.coalesce(F.max(F.when(F.col("n") > 1, F.col("urls"))), F.lit(0)).alias("most_before"), F.bool_or(policy.collapsed(F.col("urls"), F.col("before"))).alias("ever_collapsed"),
    )
    low, was_low = policy.collapsed(F.col("current"), F.col("high_water")), policy.collapsed(F.col("previous"), F.col("high_water"))
    state = F.when(F.col("k") <= policy.skip, "none").when(low & was_low, "persisted").when(low, "awaiting_confirmation").when(was_low, "recovered_blip").otherwise("none")
    now = F.when(F.col("k") >= 2, policy.collapsed(F.col("current"), F.col("most_before")))
    return sums.select("feed", state.alias("state"), "current", "high_water", now.alias("now_collapsed"), "ever_collapsed")


def sitemap_error_deltas(before: DataFrame, now: DataFrame) -> DataFrame:
    """Sitemaps (path, errors, warnings) whose errors or warnings have changed; those that were not known before have not."""
    old = before.select("path", F.coalesce("errors", F.lit(0)).alias("e"), F.coalesce("warnings", F.lit(0)).alias("w"))
    rows = now.join(old, "path").select("path", (F.col("errors") - F.col("e")).alias("error_delta"), (F.col("warnings") - F.col("w")).alias("warning_delta"), F.col("errors").alias("new_errors"), F.col("warnings").alias("new_warnings"))
    return rows.where("error_delta <> 0 OR warning_delta <> 0")


#: Days after which a sitemap's last download counts as old.
STALE_DOWNLOAD_DAYS = 7


def trust_gate(sites: DataFrame, now: Column) -> DataFrame:
    """``sites`` with trust_state: whether what is known of their indexing can be believed.

    Columns: connected, no_sitemaps, sitemaps_pending and sitemap_collapsed
    (boolean), live_status (reachable, timeout, error or null without a probe)
    and live_code, inspected and total_urls, indexing_status, downloaded_at.
    States: not_connected, no_sitemap, pending, broken (the probe failed and
    old evidence agrees), blip (the probe alone failed), unknown (no probe, but
    old evidence), ok.
    """
    seen = F.coalesce("inspected", "total_urls", F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    old = F.coalesce(now.cast("timestamp").cast("double") - F.col("downloaded_at").cast("timestamp").cast("double") >= 86_400 * STALE_DOWNLOAD_DAYS, F.lit(False))
    evidence, failed = old | yes("sitemap_collapsed"), F.coalesce(F.col("live_status").isin("timeout", "error"), F.lit(False))
    syncing = F.coalesce(~F.col("indexing_status").isin("complete", "partial", ""), F.lit(False))
    state = (
        F.when(~yes("connected"), "not_connected").when(yes("no_sitemaps") | F.coalesce(F.col("live_code") == 404, F.lit(False)), "no_sitemap")
        .when((seen <= 0) | syncing, "pending").when(failed & evidence, "broken").when(failed, "blip").when(F.col("live_status").isNull() & evidence, "unknown").otherwise("ok")
    )
    return sites.withColumn("trust_state", state)


def stacked(readings: DataFrame, first: str, last: str, top: int = 5, most_buckets: int = 30) -> DataFrame:
    """Levels of series (series, day, value) over a period, stacked: bucket_start, bucket_end, series, value, is_other.

    Days of the axis are those with a reading in the period, dealt to at most
    ``most_buckets`` buckets of equal length; a bucket shows the level of its
    last day. A series carries its last reading forward; before its first one
    it holds that. The ``top`` series by their last level keep their name and
    the others are one, unless it would be a single one. Series that are never
    above zero in the period are left out.
    """
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    known = readings.where(F.col("day") <= b).groupBy("series", "day").agg(F.max("value").alias("value"))
    days = known.where(F.col("day") >= a).select("day").distinct()
    # A row for each day of the period at most.
    placed = days.select("day", (F.row_number().over(W.orderBy("day")) - 1).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))
    size = F.greatest(F.lit(1), F.ceil(F.col("n") / most_buckets))
    axis = placed.groupBy(F.floor(F.col("i") / size).alias("bucket")).agg(F.min("day").alias("bucket_start"), F.max("day").alias("bucket_end"))
    by = W.partitionBy("series").orderBy("day")
    grid = known.select("series").distinct().crossJoin(F.broadcast(days))
    held = grid.join(known, ["series", "day"], "outer").select(
        "series", "day", F.coalesce(F.last("value", ignorenulls=True).over(by), F.first("value", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing))).alias("value")
    ).where(F.col("day") >= a)
    latest = held.groupBy("series").agg(F.max_by("value", "day").alias("level"), F.max("value").alias("most")).where("most > 0")
    # Series are ranked in one task; they are sites or issues, not readings.
    ranked = latest.withColumn("place", F.row_number().over(W.orderBy(F.desc("level"), "series"))).withColumn("k", F.count("*").over(W.partitionBy()))
    other = (F.col("place") > top) & (F.col("k") != top + 1)
    shown = held.join(F.broadcast(axis), F.col("day") == F.col("bucket_end")).join(ranked.select("series", other.alias("is_other")), "series")
    name = F.when(F.col("is_other"), "other").otherwise(F.col("series"))
    return shown.groupBy("bucket_start", "bucket_end", name.alias("series"), "is_other").agg(F.sum("value").alias("value"))


def verdict_freshness(inspections: DataFrame, today: str) -> DataFrame:
    """Inspections older than a week and a month, and the share within a week in percent."""
    age = F.datediff(F.lit(today).cast("date"), F.col("inspected_at").cast("date"))
    rows = inspections.agg(F.count("*").alias("total"), F.count_if(age > 7).alias("older_7"), F.count_if(age > 30).alias("older_30"))
    return rows.withColumn("fresh_percent", F.coalesce(F.round(100 * over((F.col("total") - F.col("older_7")).cast("double"), F.col("total")), 1), F.lit(0.0)))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, removed and updated addresses between two generations (loc, lastmod)."""
    old = before.select("loc", F.col("lastmod").alias("previous_lastmod"), F.lit(True).alias("was"))
    new = after.select("loc", "lastmod", F.lit(True).alias("is"))
    op = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("lastmod").eqNullSafe(F.col("previous_lastmod")), "updated")
    return new.join(old, "loc", "outer").select(op.alias("op"), "loc", "lastmod", "previous_lastmod").where("op IS NOT NULL")


def members(generation: DataFrame, urls: DataFrame) -> DataFrame:
    """The urls that a published generation lists."""
    return urls.join(generation.select(F.col("loc").alias("url")), "url", "left_semi")


def carried_forward(readings: DataFrame, first: str, last: str) -> DataFrame:
    """(day, total, sites): the sum over sites of each site's last reading on or before the day, from (site, day, value)."""
    span = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    grid = readings.select("site").distinct().select("site", F.explode(span).alias("day"))
    known = readings.groupBy("site", "day").agg(F.max("value").alias("value"))
    both = grid.join(known, ["site", "day"], "outer")
    held = F.last("value", ignorenulls=True).over(W.partitionBy("site").orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    rows = both.withColumn("held", held).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows.groupBy("day").agg(F.coalesce(F.sum("held"), F.lit(0)).alias("total"), F.count("held").alias("sites"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Both ends of the score interval of a share."""
    p, nn = over(hits.cast("double"), n), F.nullif(n.cast("double"), F.lit(0.0))
    centre, half = (p + z * z / (2 * nn)) / (1 + z * z / nn), z / (1 + z * z / nn) * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn))
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def cohort_diagnosis(pages: DataFrame, least: int = 20, z: float = 1.959963984540054) -> DataFrame:
    """Share of indexed pages by section (first part of the path) against all others, with a Newcombe interval, from (url, indexed)."""
    section = F.coalesce(F.nullif(F.regexp_extract("url", "^(?:https?://[^/]+)?/([^/?#]+)", 1), F.lit("")), F.lit("home"))
    each = pages.groupBy(section.alias("section")).agg(F.count("*").alias("n"), F.count_if("indexed").alias("hits"))
    whole = each.agg(F.sum("n").alias("all_n"), F.sum("hits").alias("all_hits"))
    rows = each.where(F.col("n") >= least).crossJoin(F.broadcast(whole))
    rn, rh = F.col("all_n") - F.col("n"), F.col("all_hits") - F.col("hits")
    (l1, u1), (l2, u2) = wilson(F.col("hits"), F.col("n"), z), wilson(rh, rn, z)
    p1, p2 = over(F.col("hits").cast("double"), F.col("n")), over(rh.cast("double"), rn)
    low = p1 - p2 - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    high = p1 - p2 + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    return rows.select("section", "n", "hits", p1.alias("share"), p2.alias("other_share"), low.alias("low"), high.alias("high"), F.coalesce((low > 0) | (high < 0), F.lit(False)).alias("differs"))
