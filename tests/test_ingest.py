import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions.text import intent_code, normalize_query, query_dim, singular
from tidewell.operators import indexing as I
from tidewell.operators import series
from tidewell.schemas import FACTS
from tidewell.sources.ingest import FactStore, append_identity, compacted, dates_row, end_of, from_api, live_files, overlay, partitions_of, rendered, start_of, to_path
from tidewell.streaming import ingest as streaming

DAY = dt.date(2024, 1, 1)


def test_paths(spark):
    cases = {"https://a.b/c?d#e": "/c", "http://a.b": "/", "/x/y#z": "/x/y", "": "/", "a/b": "/a/b", "https://a.b?x": "/", "HTTPS://A/": "/"}
    df = spark.createDataFrame(list(cases.items()), "u string, want string")
    assert [r for r in df.select("u", to_path(F.col("u")).alias("got"), "want").collect() if r.got != r.want] == []


def test_api_rows_become_facts(spark):
    rows = spark.createDataFrame([(["https://a/p?x", "q", "2024-01-01"], 3, 10, 0.5), (["https://a/p", "q", "2024-01-01"], 1, 10, 3.0)], "keys array<string>, clicks int, impressions int, position double")
    got = from_api(rows, "page_queries").collect()
    assert [(r.url, r["query"], r.date, r.sum_position) for r in got] == [("/p", "q", DAY, 0.0), ("/p", "q", DAY, 20.0)]


FACT = "url string, date date, clicks int, impressions int, sum_position double"
HOUR = "url string, hour int, date date, clicks int, impressions int, sum_position double"


def clicks_of(df):
    return sorted((r.url, r.date.isoformat(), r.clicks) for r in df.collect())


def test_days_are_replaced_hours_merged(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    assert store.read("pages").collect() == [] and set(store.read("pages").columns) == {"url", "date", "clicks", "impressions", "sum_position", "site_id", "search_type"}
    next_day = DAY + dt.timedelta(1)
    store.write_days("pages", spark.createDataFrame([("/a", DAY, 1, 10, 5.0), ("/a", DAY, 2, 10, 5.0), ("/b", next_day, 7, 70, 0.0)], FACT), "s")
    assert clicks_of(store.read("pages")) == [("/a", "2024-01-01", 3), ("/b", "2024-01-02", 7)]
    store.write_days("pages", spark.createDataFrame([("/c", DAY, 9, 90, 0.0)], FACT), "s")
    assert clicks_of(store.read("pages")) == [("/b", "2024-01-02", 7), ("/c", "2024-01-01", 9)]
    store.merge_hours(spark.createDataFrame([("/a", 1, DAY, 1, 1, 0.0), ("/a", 2, DAY, 5, 5, 0.0)], HOUR), "s")
    store.merge_hours(spark.createDataFrame([("/a", 1, DAY, 4, 4, 0.0)], HOUR), "s")
    assert sorted((r.hour, r.clicks) for r in store.read("hourly_pages").collect()) == [(1, 4), (2, 5)]
    assert store.drop_old_hours(dt.date(2024, 3, 1)) == 1 and store.read("hourly_pages").count() == 0
    assert store.empty("dates").columns[0] == "date" and len(FACTS) == 10


def test_purge_leaves_no_purged_row(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    next_day = DAY + dt.timedelta(1)
    store.write_days("pages", spark.createDataFrame([("/a", DAY, 1, 10, 0.0), ("/a", next_day, 2, 10, 0.0), ("/b", next_day, 3, 10, 0.0)], FACT), "s")
    store.write_days("pages", spark.createDataFrame([("/a", DAY, 5, 10, 0.0)], FACT), "other")
    store.write_days("pages", spark.createDataFrame([("/a", DAY, 6, 10, 0.0)], FACT), "s", "image")
    urls = spark.createDataFrame([("/a",), ("/a",)], "url string")
    store.purge_urls("pages", urls, "s")
    # A day on which only purged urls stood is gone; other sites and search types stay.
    assert clicks_of(store.read("pages", site="s", search_type="web")) == [("/b", "2024-01-02", 3)]
    assert [p[3] for p in store.partitions("pages", "s") if p[1] == "web"] == [next_day]
    assert len(clicks_of(store.read("pages"))) == 3
    store.purge_urls("pages", spark.createDataFrame([("/none",)], "url string"), "s")
    assert len(clicks_of(store.read("pages"))) == 3


def test_reads_open_only_partitions_of_the_period(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    days = [DAY + dt.timedelta(i) for i in range(40)]
    store.write_days("pages", spark.createDataFrame([("/a", d, i, 10, 0.0) for i, d in enumerate(days)], FACT), "s")
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    read = store.read("pages", "2024-01-10", "2024-01-12", "s", "web")
    plan = read._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert all(c in filters for c in ("site_id", "search_type", "first_day", "tier"))
    assert len(read.inputFiles()) == 40 and [c for *_, c in clicks_of(read)] == [9, 10, 11]
    assert read.select(F.input_file_name().alias("f")).distinct().count() == 3


def test_compaction_by_tier(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    days = [DAY + dt.timedelta(i) for i in range(130)]
    rows = [("/a", d, i, 10, 0.0) for i, d in enumerate(days)]
    store.write_days("pages", spark.createDataFrame(rows, FACT), "s")
    store.write_days("pages", spark.createDataFrame(rows[:3], FACT), "s", "image")
    before = clicks_of(store.read("pages"))
    assert store.compact("pages", dt.date(2024, 5, 20)) > 5
    found = {(k, t, d.isoformat()) for _, k, t, d in store.partitions("pages")}
    # January is in a month; its quarter is not old enough; late weeks are weeks or days.
    assert ("web", "d30", "2024-01-01") in found and ("image", "d30", "2024-01-01") in found
    assert not any(t in ("raw", "d7") and d < "2024-04-01" for _, t, d in found)
    assert clicks_of(store.read("pages")) == before
    # A day in a merged month is replaced where it lies, and the others stay.
    store.write_days("pages", spark.createDataFrame([("/new", dt.date(2024, 1, 17), 500, 500, 0.0)], FACT), "s")
    assert clicks_of(store.read("pages", "2024-01-16", "2024-01-18", "s", "web")) == [("/a", "2024-01-16", 15), ("/a", "2024-01-18", 17), ("/new", "2024-01-17", 500)]
    assert not any(t == "raw" and d < "2024-04-01" for _, _, t, d in store.partitions("pages") for d in [d.isoformat()])
    store.compact("pages", dt.date(2025, 1, 1))
    assert {(t, d.isoformat()) for _, k, t, d in store.partitions("pages") if k == "web"} == {("d90", "2024-01-01"), ("d90", "2024-04-01")}
    assert len(clicks_of(store.read("pages"))) == len(before) and store.compact("pages", dt.date(2025, 1, 1)) == 0
    marks = {(r.site_id, r.search_type): (r.oldest_date, r.newest_date) for r in store.watermarks("pages").collect()}
    assert marks["s", "web"] == (DAY, days[-1]) and marks["s", "image"] == (DAY, days[2])


def test_weeks_nest_in_months():
    d = dt.date
    assert start_of(d(2024, 2, 2), "d7") == d(2024, 2, 1) and start_of(d(2024, 1, 31), "d7") == d(2024, 1, 29)
    assert end_of(d(2024, 1, 29), "d7") == d(2024, 1, 31) and end_of(d(2024, 2, 1), "d7") == d(2024, 2, 4)
    assert end_of(d(2024, 2, 1), "d30") == d(2024, 2, 29) and end_of(d(2024, 4, 1), "d90") == d(2024, 6, 30)


def test_identity_of_appended_rows(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    rows = [("/a", DAY, 1, 10, 0.5), ("/b", DAY, 2, 20, None), ("/b", DAY, 2, 20, None)]
    df = spark.createDataFrame(rows, FACT)
    mixed = spark.createDataFrame(rows[::-1], FACT).select(*df.columns[::-1]).repartition(3)
    one = store.append_once("log", df)
    assert one == store.append_once("log", mixed) and spark.read.parquet(f"{store.root}/log").count() == 3
    assert append_identity(df.distinct()) != one != append_identity(spark.createDataFrame(rows[:2] + [rows[0]], FACT))
    assert store.append_once("log", df.limit(1)) != one and spark.read.parquet(f"{store.root}/log").count() == 4


def test_sync_states(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    row = lambda day, state, at: ("s", "pages", "web", day, state, at)
    schema = "site_id string, table string, search_type string, date string, state string, at int"
    store.note_sync(spark.createDataFrame([row("2024-01-01", "pending", 1), row("2024-01-02", "pending", 1)], schema))
    store.note_sync(spark.createDataFrame([row("2024-01-01", "done", 2)], schema))
    assert {r.date: r.state for r in store.sync_state().collect()} == {"2024-01-01": "done", "2024-01-02": "pending"}
    with pytest.raises(Exception, match="no sync state"):
        store.note_sync(spark.createDataFrame([row("2024-01-01", "lost", 2)], schema))


def test_views_over_sites(spark, tmp_path):
    for label, clicks in (("one", 1), ("two", 2)):
        FactStore(spark, str(tmp_path / label)).write_days("pages", spark.createDataFrame([("/a", DAY, clicks, 10, 0.0)], FACT), label)
    FactStore(spark, "").views({label: str(tmp_path / label) for label in ("one", "two", "none")} )
    assert sorted((r.site, r.clicks) for r in spark.table("pages").collect()) == [("one", 1), ("two", 2)]


def test_rendered_pages(spark):
    df = spark.createDataFrame([("a,b", 1, None), (None, 2, 0.5)], "x string, n int, y double").orderBy("n")
    assert json.loads(rendered(df, "json")) == [{"x": "a,b", "n": 1, "y": None}, {"x": None, "n": 2, "y": 0.5}]
    assert rendered(df, "csv").split("\n")[0] == "x,n,y" and '"a,b",1' in rendered(df, "csv")
    assert "a,b" in rendered(df, "table")
    with pytest.raises(ValueError):
        rendered(df, "xml")


def test_overlay_compaction_and_tiers(spark):
    schema = "url string, date date, clicks int, impressions int, sum_position double, written int"
    old = spark.createDataFrame([("/a", DAY, 1, 1, 0.0, 1)], schema)
    new = spark.createDataFrame([("/a", DAY, 5, 5, 0.0, 2), ("/a", DAY + dt.timedelta(1), 6, 6, 0.0, 2)], schema)
    assert sorted(r.clicks for r in overlay(old, new).collect()) == [1, 6]
    assert sorted(r.clicks for r in compacted(old.unionAll(new), "pages", "written").collect()) == [5, 6]
    assert live_files([("week", "2024-01-01", "2024-01-07", 1), ("d1", "2024-01-01", "2024-01-01", 0), ("d1b", "2024-01-01", "2024-01-01", 2)]) == ["d1b", "week"]
    assert live_files([("week", "2024-01-01", "2024-01-02", 5), ("a", "2024-01-01", "2024-01-01", 0), ("b", "2024-01-02", "2024-01-02", 0)]) == ["a", "b"]
    assert partitions_of("2023-12-30", "2024-01-02", "week") == ["2023-12-25", "2024-01-01"] and partitions_of("2023-12-30", "2024-01-02", "quarter") == ["2023-Q4", "2024-Q1"]


def test_dates_row(spark):
    total = spark.createDataFrame([(DAY, 10, 100, 50.0)], "date date, clicks int, impressions int, sum_position double")
    dev = spark.createDataFrame([(DAY, "MOBILE", 4, 60, 20.0), (DAY, "desktop", 6, 40, 30.0)], "date date, device string, clicks int, impressions int, sum_position double")
    q = spark.createDataFrame([(DAY, 30), (DAY, 90)], "date date, impressions int")
    row = dates_row(total, dev, q).first()
    assert (row.clicks_mobile, row.clicks_desktop, row.clicks_tablet, row.anonymized_impressions_pct) == (4, 6, 0, 0.0)


def test_stream_of_hours_and_days(spark, tmp_path):
    schema = "ts timestamp, url string, clicks long, impressions long, sum_position double"
    at = dt.datetime(2024, 1, 1, 0, 30)
    rows = [(at + dt.timedelta(hours=i), "/a", 1, 10, 0.0) for i in range(60)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streaming.hourly_facts(stream()).writeStream.format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("hours").collect()
    assert {(r.date.isoformat(), r.hour) for r in got} >= {("2024-01-01", h) for h in range(24)} and all(r.clicks == 1 for r in got)
    store = FactStore(spark, str(tmp_path / "out"))
    q = streaming.write_days(streaming.daily_facts(stream(), "1 hour"), store, "pages", "s", str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {(r.date.isoformat(), r.clicks) for r in store.read("pages").collect()} == {("2024-01-01", 24), ("2024-01-02", 24)}
    # Hours that a later batch of the same day does not hold stay.
    store.merge_hours(spark.createDataFrame([("/a", 23, DAY, 9, 9, 0.0), ("/old", 23, DAY, 1, 1, 0.0)], HOUR), "s")
    q = streaming.write_days(streaming.hourly_facts(stream()), store, "hourly_pages", "s", str(tmp_path / "ck2"))
    q.awaitTermination(120)
    hours = {(r.url, r.hour): r.clicks for r in store.read("hourly_pages", "2024-01-01", "2024-01-01").collect()}
    assert len(hours) == 25 and hours["/a", 23] == 1 and hours["/old", 23] == 1


def test_normalizer():
    same = lambda *q: len({normalize_query(x) for x in q}) == 1
    assert same("Keyword Checker", "checkers keyword".replace("checkers", "checker"), "keyword-validator", '"keyword checker')
    assert same("café menus", "menu cafe", "Cafe Menu?")
    assert normalize_query("png to jpg") == "png to jpg" != normalize_query("jpg to png")
    assert same("how to tie knots", "to how tie knot")
    assert normalize_query("free online") == "free online" and normalize_query(" ?! ") == ""
    assert [singular(w) for w in ("boxes", "cities", "redis", "css", "oasis", "news", "pages", "people", "classes", "日本語")] == ["box", "city", "redis", "css", "oasis", "news", "page", "person", "class", "日本語"]
    for q in ("how to build websites", "Free SEO tools", "b to a converters", "don't stop"):
        assert normalize_query(normalize_query(q)) == normalize_query(q)


def test_intent_and_dimension(spark):
    cases = {"buy shoes": 3, "best shoes": 2, "what is seo": 1, "how to buy shoes": 7, "how to run": 5, "shoe": 0, "plumber near me": 3, "best price": 3, "how much is it": 3}
    df = spark.createDataFrame(list(cases.items()), "query string, want int")
    assert [r for r in df.select("query", intent_code(F.col("query")).alias("got"), "want").collect() if r.got != r.want] == []
    dim = query_dim(spark.createDataFrame([("Free",), ("b a",), ("b a",), (" ",), (None,)], "query string")).collect()
    assert {r["query"]: r.query_canonical for r in dim} == {"Free": "free", "b a": "a b"}


def test_canonical_kinds_and_coverage(spark):
    cases = [
        ("https://a.b/x", "https://www.A.b/x/", "formatting"), ("https://a.b/x", "https://a.b/y", "path"), ("https://a.b/x", "https://c.d/x", "cross_domain"),
        ("https://a.b/x", "https://a.b/x", "none"), (None, "https://a.b", "none"), ("nonsense", "https://a.b", "path"), ("http://a.b/x", "https://a.b/x", "formatting"),
    ]
    df = spark.createDataFrame(cases, "u string, g string, want string")
    assert [r for r in df.select("*", I.canonical_kind(F.col("u"), F.col("g")).alias("got")).collect() if r.got != r.want] == []
    states = spark.createDataFrame([(" Soft 404 ",), (None,), ("??",)], "coverage_state string")
    assert {r.tag: r.n for r in I.coverage_counts(states).collect() if r.n} == {"soft_404": 1, "not_reported": 1, "unrecognized": 1}


def record(spark, clicks):
    return spark.createDataFrame([(DAY + dt.timedelta(i), float(c), float(10 * c)) for i, c in enumerate(clicks)], "date date, clicks double, impressions double")


@pytest.mark.parametrize(
    ("clicks", "shape"), [
        ([10] * 20, "insufficient-data"), ([0.1] * 60, "insufficient-data"), ([20] * 120, "steady"), ([20] * 60 + [1] * 60, "sudden-drop"),
        ([0] * 10 + [1] * 7 + list(range(1, 31)) + [40] * 14 + [1] * 40, "launch-honeymoon-then-cliff"), ([100 - i * 0.5 for i in range(120)], "gradual-decline"),
        ([10 + i for i in range(120)], "growing"),
    ],
)
def test_trajectory_shapes(spark, clicks, shape):
    assert series.trajectory(record(spark, clicks)).first()["shape"] == shape
