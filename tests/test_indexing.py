"""Cohorts, sitemap collapse, trust and leads against slow versions and cases."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict
from statistics import NormalDist

from pyspark.sql import functions as F

from tidewell.operators import cohorts
from tidewell.operators import indexing as I
from tidewell.operators import rollups

DAY = dt.date(2024, 1, 1)


def slow_outliers(pages):
    def keys(path):
        parts = [x for x in path.split("/") if x]
        out = [("section", "/" + "/".join(parts[:k])) for k in (1, 2) if len(parts) >= k] or [("section", "/")]
        at = path.find("/v")
        versioned = False
        while at >= 0:
            digits = ""
            for c in path[at + 2 :]:
                if not c.isdigit():
                    break
                digits += c
            rest = path[at + 2 + len(digits) :]
            versioned |= bool(digits) and rest.startswith("/") and len(rest) > 1
            at = path.find("/v", at + 1)
        return [*out, ("lifecycle", "versioned" if versioned else "evergreen")]

    def interval(hits, n, z):
        p = hits / n
        centre, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        return max(0, (centre - half) / (1 + z * z / n)), min(1, (centre + half) / (1 + z * z / n))

    cells = defaultdict(list)
    for path, indexed in pages:
        for k in keys(path):
            cells[k].append((path, indexed))
    n, bad = len(pages), sum(not i for _, i in pages)
    tested = {k: v for k, v in cells.items() if 12 <= len(v) < n}
    z = abs(NormalDist().inv_cdf(0.05 / max(1, len(tested)) / 2))
    found = []
    for k, v in tested.items():
        b, m = sum(not i for _, i in v), n - len(v)
        if m < 12:
            continue
        p, q = b / len(v), (bad - b) / m
        low, high = interval(b, len(v), z)
        if p - q - math.hypot(p - low, interval(bad - b, m, z)[1] - q) > 0:
            found.append((k, len(v), b, p, q, {path for path, i in v if not i}))
    found.sort(key=lambda f: (-round(f[3] - f[4], 12), -f[2], f[0]))
    claimed, out = set(), []
    for rank, (k, total, b, p, q, paths) in enumerate(found, 1):
        out.append((rank, *k, total, b, round(p, 9), round(q, 9), len(paths & claimed)))
        claimed |= paths
    return out


def test_outlier_cohorts_against_slow_version(spark):
    rng = random.Random(5)
    pages = []
    for i in range(600):
        section = rng.choice(["docs", "blog", "shop"])
        path = f"/{section}/{rng.choice(['a', 'b', 'v2'])}/{i}"
        bad = {"docs": 0.1, "blog": 0.15, "shop": 0.6}[section] + (0.3 if "/v2/" in path else 0)
        pages.append((path, rng.random() > bad))
    pages += [("/", True), ("/v3", True), ("/about", False)]
    got = cohorts.outlier_cohorts(spark.createDataFrame(pages, "path string, indexed boolean")).orderBy("rank").collect()
    want = slow_outliers(pages)
    assert len(want) >= 3 and any(w[-1] for w in want)
    assert [(r["rank"], r.dimension, r.key, r.total, r.not_indexed, round(r.rate, 9), round(r.other_rate, 9), r.overlap_not_indexed) for r in got] == want
    assert all(0 <= r.low <= r.rate <= r.high <= 1 for r in got)
    assert cohorts.outlier_cohorts(spark.createDataFrame(pages[:0], "path string, indexed boolean")).collect() == []
    assert cohorts.outlier_cohorts(spark.createDataFrame([(f"/a/{i}", True) for i in range(40)], "path string, indexed boolean")).collect() == []
    assert cohorts.in_cohort(spark.createDataFrame(pages, "path string, indexed boolean"), "section", "/shop").count() == sum(p.startswith("/shop/") for p, _ in pages)
    assert cohorts.critical_value(20) > cohorts.critical_value(1) and abs(cohorts.critical_value(1) - 1.959964) < 1e-5


def test_registered_cohorts_are_those_of_the_slow_version(spark):
    from tidewell.rollup_queries import QUERIES, crawled

    sf = "/root/testdata/sf0.001"
    want = slow_outliers([tuple(r) for r in crawled(spark, sf).collect()])
    got = QUERIES["cohort_outliers"](spark, sf).orderBy("rank").collect()
    assert want and [(r.dimension, r.key, r.not_indexed, r.overlap_not_indexed) for r in got] == [(w[1], w[2], w[4], w[-1]) for w in want]


def test_leads_bound_the_time_of_a_loss(spark):
    found = spark.createDataFrame([("section", "/docs"), ("section", "/blog"), ("lifecycle", "versioned")], "dimension string, key string")
    changes = [
        ("https://a.b/docs/x", "indexStatus", "PASS", "FAIL", 3, 9), ("https://a.b/docs/y?z", "indexStatus", "PASS", "NEUTRAL", 1, 5), ("https://a.b/docs/y?z", "indexStatus", "PASS", "FAIL", 6, 7),
        ("https://a.b/docsy", "indexStatus", "PASS", "FAIL", 0, 99), ("https://a.b/blog/x", "indexStatus", "FAIL", "PASS", 0, 1), ("https://a.b/blog/x", "verdict", "PASS", "FAIL", 0, 1),
        ("https://a.b/blog/x", "indexStatus", "PASS", "FAIL", 5, 1),
    ]
    df = spark.createDataFrame(changes, "url string, field string, from_value string, to_value string, changed_after int, changed_before int")
    assert [tuple(r) for r in cohorts.regression_leads(found, df).collect()] == [("/docs", 2, 1, 9)]


def test_collapse_states(spark):
    histories = {
        "one": [5], "two": [100, 1], "none": [100, 90, 95], "waiting": [100, 90, 10], "persisted": [100, 100, 10, 12], "blip": [100, 100, 10, 99], "small": [19, 19, 0], "grown": [4, 500, 1000],
        "long ago": [100, 5, 90, 95], "negative": [100, 100, -5], "gone": [100, 100, None, None],
    }
    rows = [(k, DAY + dt.timedelta(i), v) for k, h in histories.items() for i, v in enumerate(h)]
    got = {r.feed: r for r in I.sitemap_collapse(spark.createDataFrame(rows, "feed string, date date, urls int").repartition(3)).collect()}
    assert {k: r.state for k, r in got.items()} == {
        "one": "none", "two": "none", "none": "none", "waiting": "awaiting_confirmation", "persisted": "persisted", "blip": "recovered_blip", "small": "none", "grown": "none", "long ago": "none",
        "negative": "awaiting_confirmation", "gone": "persisted",
    }
    assert {k for k, r in got.items() if r.ever_collapsed} == {"two", "waiting", "persisted", "blip", "long ago", "negative", "gone"}
    assert {k for k, r in got.items() if r.now_collapsed} == {"two", "waiting", "persisted", "negative", "gone"} and got["one"].now_collapsed is None
    sync = {r.feed: r.state for r in I.sitemap_collapse(spark.createDataFrame(rows, "feed string, date date, urls int"), I.SYNC_COLLAPSE).collect()}
    assert sync["two"] == "awaiting_confirmation" and sync["none"] == "none" and sync["small"] == "awaiting_confirmation"


def test_error_deltas(spark):
    schema = "path string, errors int, warnings int"
    before = spark.createDataFrame([("/a", 1, 2), ("/b", None, 0), ("/c", 3, 3)], schema)
    now = spark.createDataFrame([("/a", 1, 5), ("/b", 2, 0), ("/c", 3, 3), ("/new", 9, 9)], schema)
    assert sorted(tuple(r) for r in I.sitemap_error_deltas(before, now).collect()) == [("/a", 0, 3, 1, 5), ("/b", 2, 0, 2, 0)]


def test_trust(spark):
    base = dict(connected=True, no_sitemaps=False, sitemaps_pending=False, sitemap_collapsed=False, live_status="reachable", live_code=200, inspected=10, total_urls=None, indexing_status="complete", downloaded_at="2024-01-09 00:00:00")
    cases = {
        "ok": {}, "not_connected": {"connected": False, "no_sitemaps": True}, "no_sitemap": {"no_sitemaps": True}, "no_sitemap 404": {"live_code": 404, "live_status": "error"},
        "pending": {"inspected": 0}, "pending sync": {"indexing_status": "pending"}, "ok partial": {"indexing_status": "partial"}, "ok unset": {"indexing_status": None, "inspected": None, "total_urls": 4},
        "blip": {"live_status": "timeout", "live_code": None}, "broken": {"live_status": "error", "live_code": 500, "sitemap_collapsed": True},
        "broken old": {"live_status": "error", "live_code": None, "downloaded_at": "2024-01-01 00:00:00"}, "unknown": {"live_status": None, "live_code": None, "sitemap_collapsed": True}, "ok unprobed": {"live_status": None, "live_code": None},
    }
    schema = "name string, connected boolean, no_sitemaps boolean, sitemaps_pending boolean, sitemap_collapsed boolean, live_status string, live_code int, inspected int, total_urls int, indexing_status string, downloaded_at string"
    df = spark.createDataFrame([(k, *(base | v).values()) for k, v in cases.items()], schema)
    got = {r.name: r.trust_state for r in I.trust_gate(df, F.lit("2024-01-10 00:00:00")).collect()}
    assert got == {k: k.split()[0] for k in cases}


def test_stack_keeps_a_single_other_series(spark):
    rows = [(f"s{i}", DAY + dt.timedelta(d), 10 * i + d) for i in range(1, 8) for d in (-40, 0, 3)] + [("zero", DAY, 0), ("late", DAY + dt.timedelta(2), 500)]
    df = spark.createDataFrame(rows, "series string, day date, value int")
    first, last = "2024-01-01", "2024-01-04"
    got = {(r.bucket_end.day, r.series): r.value for r in I.stacked(df, first, last, top=5).collect()}
    # Days with a reading: 1, 3 and 4; before its first reading a series holds that.
    assert {d for d, _ in got} == {1, 3, 4} and got[1, "late"] == 500 and got[3, "s7"] == 70 and got[4, "s7"] == 73
    assert {s for _, s in got} == {"late", "s7", "s6", "s5", "s4", "other"} and got[4, "other"] == 33 + 23 + 13
    six = I.stacked(df.where("series <> 's1' AND series <> 's2'"), first, last, top=5)
    assert {r.series for r in six.collect()} == {"late", "s7", "s6", "s5", "s4", "s3"}
    one = {r.series: (r.bucket_start.day, r.bucket_end.day) for r in I.stacked(df, first, last, most_buckets=1).collect()}
    assert set(one.values()) == {(1, 4)}


def test_changes_leave_updates_out(spark):
    rows = [("f", f"/{i}", f"2024-01-{1 + i % 28:02d} 10:00:00", ["added", "removed", "updated"][i % 3]) for i in range(900)] + [("only", "/u", "2024-01-05 00:00:00", "updated"), ("f", "/x", "2023-01-05 00:00:00", "added")]
    df = spark.createDataFrame(rows, "feed string, loc string, observed_at string, op string").withColumn("observed_at", F.to_timestamp("observed_at"))
    days = rollups.sitemap_change_days(df, "2024-01-28").collect()
    assert {r.feed for r in days} == {"f"} and sum(r.added for r in days) == 300 == sum(r.removed for r in days)
    latest = rollups.sitemap_latest_changes(df, "2024-01-28").collect()
    assert Counter(r.op for r in latest) == {"added": 200, "removed": 200}


def test_every_issue_has_a_label():
    from pyspark.sql import SparkSession

    assert SparkSession.getActiveSession() is not None
    assert set(I.ISSUES) == set(I.issue_conditions(F.lit("2024-01-01"))) and {s for _, s in I.ISSUES.values()} == {"info", "warning", "error"}
