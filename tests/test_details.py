"""Parts of analyzers, the trajectory and the query dimension against slow versions."""

import datetime as dt
import random
from statistics import median


from tidewell.functions.text import normalize_query
from tidewell.operators import details, series
from tidewell.plan_queries import QUERIES
from tidewell.sources import facts
from tidewell.sources.facts import Facts

DAY = dt.date(2024, 1, 1)
PAIRS = "url string, query string, date date, clicks int, impressions int, sum_position double"


def test_points_of_a_long_tail(spark):
    rows = [("/big", f"q{i:04d}", DAY, 1, 5000 - i, 0.0) for i in range(900)] + [("/small", f"q{i}", DAY, 1, 100 - i, 0.0) for i in range(80)] + [("/tiny", "q", DAY, 1, 100, 0.0)]
    got = details.long_tail_points(Facts(spark.createDataFrame(rows, PAIRS)), ("2024-01-01", "2024-01-31")).collect()
    shown, threshold = list(range(1, 11)), 1.15
    for rank in range(11, 901):
        if rank >= threshold:
            shown.append(rank)
            threshold *= 1.15
    assert sorted(r["rank"] for r in got if r.url == "/big") == shown and 40 < len(shown) < 80
    assert sum(r.url == "/small" for r in got) == 80 and not any(r.url == "/tiny" for r in got)


def test_pages_of_rows_take_only_allowed_columns(spark):
    df = spark.createDataFrame([(i, i % 3, -i) for i in range(30)], "a int, b int, c int")
    page = lambda **k: [r.a for r in details.sorted_page(df, ("a", "b"), ("a", "desc"), ties=("a",), **k).collect()]
    assert page(limit=3) == [29, 28, 27] and page(sort_by="c", sort_dir="up", limit=2) == [29, 28] and page(sort_by="b", sort_dir="asc", limit=2, offset=1) == [3, 6]
    assert len(page(limit=-4)) == 30 and page(limit=2, offset=-7) == [29, 28]


def slow_trajectory(record):
    """record: (date, clicks, impressions) with one row for each day."""
    n = len(record)
    weeks = {}
    for m in (1, 2):
        raw = [float(r[m]) for r in record]
        cut = [min(x, max(3 * median(raw[max(0, i - 7) : i + 8]), 3)) for i, x in enumerate(raw)]
        weeks[m] = {i: sum(cut[i - 6 : i + 1]) for i in range(6, n)}
    if n < 28:
        return "insufficient-data", None
    peak = {m: max(w.values()) for m, w in weeks.items()}
    enough_clicks, enough_seen = peak[1] >= 20, peak[2] >= 200
    if not enough_clicks and not enough_seen:
        return "insufficient-data", None
    at = {m: max(i for i, v in w.items() if v == peak[m]) for m, w in weeks.items()}
    last = {m: weeks[m][n - 1] for m in weeks}
    end = record[0][0] + dt.timedelta(at[2])
    doubtful = end - dt.timedelta(6) <= dt.date(2026, 4, 27) and end >= dt.date(2025, 5, 13)
    if not enough_clicks:
        m = 2
    elif not enough_seen or doubtful or abs(last[1] / peak[1] - last[2] / peak[2]) > 0.25:
        m = 1
    else:
        m = 2
    w, top, p, now = weeks[m], peak[m], at[m], last[m]
    basis = {1: "clicks", 2: "impressions"}[m]
    drop = min((i for i, v in w.items() if i > p and v <= 0.15 * top), default=None)
    cliff = False
    if drop is not None:
        since = max((i for i, v in w.items() if p < i < drop and v >= 0.7 * top), default=p)
        cliff = drop - since <= 21 and all(v <= 0.25 * top for i, v in w.items() if i >= drop)
    first = min(i for i, r in enumerate(record) if r[1] > 0 or r[2] > 0)
    start = first + 6
    if cliff and p - first <= 56 and start < p and w[start] <= 0.25 * top:
        return "launch-honeymoon-then-cliff", basis
    if cliff:
        return "sudden-drop", basis
    if now / top <= 0.7:
        return "gradual-decline", basis
    before = n - 1 - 56
    if now / top >= 0.9 and before >= 6 and w[before] <= 0.8 * now:
        return "growing", basis
    return "steady", basis


def test_trajectory_against_slow_version(spark):
    rng = random.Random(12)
    found = set()
    for k in range(36):
        n, base = rng.choice([20, 40, 90, 150]), rng.choice([0.2, 3, 30])
        start = rng.choice([DAY, dt.date(2025, 6, 1)])
        rise, fall, lag = rng.choice([0, 1, 4]), rng.choice([0, 0, 0.95, 0.6]), rng.choice([1, 1, 0.3])
        at = rng.randrange(n // 2, n)
        record = []
        for i in range(n):
            level = base * (1 + rise * min(i, at) / n) * (1 - fall if i >= at else 1) * (0.05 if k % 5 == 0 and i < 9 else 1)
            spike = 20 if rng.random() < 0.03 else 1
            record.append((start + dt.timedelta(i), float(round(level * spike * rng.uniform(0.9, 1.1))), float(round(level * 20 * spike * rng.uniform(0.9, 1.1) * (lag if i >= at else 1)))))
        got = series.trajectory(spark.createDataFrame(record, "date date, clicks double, impressions double")).first()
        if not any(r[1] > 0 or r[2] > 0 for r in record):
            continue
        assert (got["shape"], got.basis) == slow_trajectory(record), (k, record)
        found.add(got["shape"])
    assert len(found) >= 4


def test_query_dimension_against_slow_version(spark):
    sf = "/root/testdata/sf0.001"
    distinct = {r["query"] for r in facts.long(spark, sf).queries.select("query").collect()}
    got = QUERIES["query_dimension"](spark, sf).collect()
    assert len(got) == len(distinct) and {r["query"]: r.query_canonical for r in got} == {q: normalize_query(q) or q for q in distinct}
    for r in got:
        assert r.intent_code == (5 if r["query"].startswith("how to ") else 2 if r["query"].startswith("best ") else 0)


def test_sides_hold_both_signs(spark):
    rows = [("/a", f"q{i}", DAY, i if i % 2 else 0, 100, 100.0) for i in range(80)]
    got = details.ctr_sides(Facts(spark.createDataFrame(rows, PAIRS)), ("2024-01-01", "2024-01-31")).collect()
    assert {r.side for r in got} == {"over", "under"} and max(r["rank"] for r in got) <= 25 and all((r.ctr_diff > 0) == (r.side == "over") for r in got)
