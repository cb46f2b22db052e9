import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewell.plans import archetypes as A
from tidewell.plans import compare as C
from tidewell.plans import planner as P
from tidewell.plans.periods import Period, default_period, gaps, islands, preset, routes_to_live, spans
from tidewell.plans.spec import Group, QueryError, and_, between, eq, gt, gte, in_array, leaves, like, lt, lte, not_, or_, period_of, regex, select, top_level

ROWS = [
    ("/a", "red shoe", "2024-01-01", 5, 100, 300.0), ("/a", "red shoe", "2024-01-02", 1, 50, 0.0), ("/b", "blue shoe", "2024-01-01", 0, 0, 0.0),
    ("https://x.example/c/d", "Red hat", "2024-01-03", 9, 10, 10.0), ("https://x.example", "hat", "2024-01-03", 2, 10, 90.0), ("/old", "gone", "2023-12-31", 4, 8, 8.0),
]


@pytest.fixture()
def lake(spark):
    pq = spark.createDataFrame(ROWS, "url string, query string, date string, clicks long, impressions long, sum_position double").withColumn("date", F.to_date("date"))
    sums = lambda *k: pq.groupBy(*k, "date").agg(*[F.sum(m).alias(m) for m in ("clicks", "impressions", "sum_position")])
    dim = spark.createDataFrame([("red shoe", "shoe"), ("blue shoe", "shoe")], "query string, query_canonical string")
    return P.Lake({"page_queries": pq, "pages": sums("url"), "queries": sums("query"), "dates": sums()}, dim)


JAN = between("date", "2024-01-01", "2024-01-31")


def test_metrics_come_from_sums(lake):
    row = P.run(lake, select("query").where(JAN, eq("query", "red shoe")).spec).first()
    assert (row.clicks, row.impressions, row.ctr, row.position) == (6, 150, 6 / 150, 3.0)
    empty = P.run(lake, select("query").where(JAN, eq("query", "blue shoe")).spec).first()
    assert empty.ctr is None and empty.position is None
    assert P.run(lake, select().where(eq("query", "nobody")).spec).first().clicks is None


def test_pages_are_paths_for_equality_and_raw_for_patterns(lake):
    got = {r.page for r in P.run(lake, select("page").where(JAN).spec).collect()}
    assert got == {"/a", "/b", "/c/d", "/"}
    assert P.run(lake, select("page").where(eq("page", "/c/d")).spec).count() == 1
    assert P.run(lake, select("page").where(regex("page", "^https")).spec).count() == 2
    assert {r.page for r in P.run(lake, select("page").where(JAN, top_level()).spec).collect()} == {"/a", "/b", "/"}


def test_filters_keep_their_tree_and_having_applies_to_groups(lake):
    spec = select("query").where(JAN, or_(eq("query", "hat"), eq("query", "red shoe")), gte("clicks", 3)).spec
    assert [r["query"] for r in P.run(lake, spec).collect()] == ["red shoe"]
    pre = select("query").where(JAN).prefilter(gte("clicks", 2), gte("ctr", 5)).spec
    assert {r["query"]: r.clicks for r in P.run(lake, pre).collect()} == {"Red hat": 9, "red shoe": 5, "hat": 2}
    total = P.totals(lake, spec).first()
    assert (total.total_clicks, total.total_count) == (6, 1)


def test_order_by_unselected_metric_and_paging(lake):
    first = P.run(lake, select("query", "clicks").where(JAN).order_by("impressions").limit(2).spec)
    assert first.columns == ["query", "clicks"]
    rest = P.run(lake, select("query", "clicks").where(JAN).order_by("impressions").limit(2).offset(2).spec)
    assert [r["query"] for r in first.collect()] + [r["query"] for r in rest.collect()] == ["red shoe", "Red hat", "hat", "blue shoe"]


def test_comparison_keeps_lost_rows_and_drops_thresholds_before(lake):
    now = select("query").where(JAN, gte("clicks", 3)).spec
    before = select("query").where(between("date", "2023-12-01", "2023-12-31")).spec
    rows = {r["query"]: r for r in C.compared(lake, now, before).collect()}
    assert set(rows) == {"red shoe", "Red hat", "gone"} and rows["gone"].clicks == 0 and rows["gone"].prevClicks == 4
    assert [r["query"] for r in C.comparison(lake, now, before, "lost").collect()] == ["gone"]
    assert [r["query"] for r in C.comparison(lake, now, before, by_change="asc").collect()] == ["gone", "red shoe", "Red hat"]
    assert C.comparison_count(lake, now, before, "new").first().total == 2
    t = C.comparison_totals(lake, now, before).first()
    assert (t.totalClicks, t.prevTotalClicks) == (17, 4)
    with pytest.raises(QueryError):
        C.comparison(lake, now, before, "sideways")


def test_canonical_reads(lake):
    rows = {r.queryCanonical: r.clicks for r in P.run(lake, select("queryCanonical").where(JAN).spec).collect()}
    assert rows == {"shoe": 6, "Red hat": 9, "hat": 2}
    v = {r.queryCanonical: r for r in P.canonical_variants(lake, select("queryCanonical").where(JAN).spec).collect()}
    assert v["shoe"].variant_count == 2 and v["shoe"].canonical_name == "red shoe" and v["shoe"].variants.startswith("red shoe:::6:::150:::3.0||blue shoe")


def test_detail_fills_days_with_zero(lake):
    rows = P.detail(lake, select().where(between("date", "2024-01-01", "2024-01-04")).spec).orderBy("date").collect()
    assert [r.clicks for r in rows] == [5, 1, 11, 0] and rows[3].ctr == 0


@pytest.mark.parametrize(
    "make", [
        lambda: select("color").spec.checked(), lambda: select("page").order_by("fame").spec.checked(), lambda: select("page").limit(0).spec.checked(),
        lambda: select("page").where(gte("date", "2024-02-30")).spec.checked(), lambda: select("page").where(gte("clicks", float("nan"))).spec.checked(),
        lambda: P.plan(select("country", "page").spec), lambda: P.plan(select("device").spec), lambda: P.plan(select("hour", "query").spec),
        lambda: in_array("page", []), lambda: or_(eq("page", "/a"), gte("date", "2024-01-01")), lambda: not_(gte("clicks", 3)), lambda: or_(and_(eq("page", "/a"))),
        lambda: or_(eq("page", "/a"), gte("clicks", 5)), lambda: select("page").where(Group("or", (eq("page", "/a"), gte("clicks", 5)))).spec.checked(),
        lambda: select("page").where(eq("searchType", "maps")).spec.checked(), lambda: select("page").where(not_(eq("searchType", "web"))).spec.checked(),
        lambda: select("page").prefilter(gte("clicks", "many")).spec.checked(), lambda: select("page").prefilter(eq("page", "/a")).spec.checked(),
        lambda: select("page").prefilter(gte("fame", 1)).spec.checked(),
    ],
)
def test_wrong_specifications_are_refused(make):
    with pytest.raises(QueryError):
        make()


def test_dates_and_shapes_of_filters():
    assert period_of(and_(gt("date", "2024-01-01"), lt("date", "2024-01-10"))) == ("2024-01-02", "2024-01-09")
    assert period_of(and_(gte("date", "2024-01-05"), and_(lte("date", "2024-02-01")))) == ("2024-01-05", "2024-02-01")
    assert like("page", "a%b_").value == "a.*b." and like("page", "x.y").op == "contains" and not_(eq("page", "/a")).op == "notEquals"
    assert len(leaves(and_(eq("page", "/a"), and_(eq("page", "/b"), or_(eq("page", "/c"), eq("page", "/d")))))) == 4


def test_tables_by_dimension():
    pick = P.dataset_for
    assert [pick(set(x)) for x in ([], ["date"], ["page"], ["queryCanonical"], ["page", "query"], ["country"], ["searchAppearance", "page"], ["hour", "page"])] == [
        "dates", "dates", "pages", "queries", "page_queries", "countries", "search_appearance_pages", "hourly_pages",
    ]


def test_archetypes_refuse_what_they_cant_answer(lake):
    p = ("2024-01-01", "2024-01-31")
    for bad in (
        lambda: A.site_daily_timeseries(lake, p, facets=(A.Facet("device", "eq", "x"),)), lambda: A.entity_daily_timeseries(lake, p, "page", "/a", facets=(A.Facet("country", "eq", "x"),)),
        lambda: A.entity_daily_sparkline(lake, p, "page", [], "clicks"), lambda: A.top_n_breakdown(lake, p, "page", movers="up", compare=p), lambda: A.aux_cloud_only(lake),
    ):
        with pytest.raises(QueryError):
            bad()
    assert {r.page: r.ctr for r in A.top_n_breakdown(lake, p, "page").collect()}["/b"] == 0


def test_periods(spark):
    d = dt.date
    assert preset("last-7d", d(2024, 3, 10)) == Period(d(2024, 3, 3), d(2024, 3, 9))
    assert preset("last-quarter", d(2024, 2, 1)) == Period(d(2023, 10, 1), d(2023, 12, 31))
    assert preset("mtd", d(2024, 3, 10)) == Period(d(2024, 3, 1), d(2024, 3, 9)) and preset("last-month", d(2024, 3, 1)).first == d(2024, 2, 1)
    assert default_period(d(2024, 3, 31)) == Period(d(2024, 2, 29), d(2024, 3, 28))
    p = Period(d(2024, 1, 8), d(2024, 1, 14))
    assert p.previous() == Period(d(2024, 1, 1), d(2024, 1, 7)) and p.year_before().first.weekday() == p.first.weekday()
    assert spans([d(2024, 1, 1), d(2024, 1, 2), d(2024, 1, 4)], 30) == [Period(d(2024, 1, 1), d(2024, 1, 2)), Period(d(2024, 1, 4), d(2024, 1, 4))]
    assert [s.days for s in spans([d(2024, 1, 1) + dt.timedelta(i) for i in range(7)], 3)] == [3, 3, 1]
    assert gaps(p, [Period(d(2024, 1, 9), d(2024, 1, 10))]) == [Period(d(2024, 1, 8), d(2024, 1, 8)), Period(d(2024, 1, 11), d(2024, 1, 14))]
    assert routes_to_live(p, []) and not routes_to_live(p, [Period(d(2024, 1, 1), d(2024, 1, 31))])
    df = spark.createDataFrame([("x", d(2024, 1, i)) for i in (1, 2, 2, 3, 7)], "k string, date date")
    assert sorted((r.first_day.day, r.last_day.day, r.days) for r in islands(df, "k").collect()) == [(1, 3, 3), (7, 7, 1)]


def test_canonical_variants_collect_only_the_first(lake):
    found = P.canonical_variants(lake, select("queryCanonical").where(JAN).spec, most=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
    whole = {r.queryCanonical: r for r in P.canonical_variants(lake, select("queryCanonical").where(JAN).spec, most=1000).collect()}
    got = found.collect()
    assert got and all(r.variants == "||".join(whole[r.queryCanonical].variants.split("||")[:2]) and r.variant_count == whole[r.queryCanonical].variant_count for r in got)


def test_search_type_of_a_filter_reaches_the_rows(spark, lake):
    both = P.Lake({k: v.withColumn("search_type", F.lit("web")).unionByName(v.withColumn("search_type", F.lit("image")).withColumn("clicks", F.col("clicks") * 10)) for k, v in lake.tables.items()}, lake.query_dim)
    clicks = lambda *f, **k: {r.page: r.clicks for r in P.run(both, replace(select("page").where(JAN, *f).spec, **k)).collect()}
    assert clicks()["/a"] == 66 and clicks(eq("searchType", "image"))["/a"] == 60 and clicks(eq("searchType", "web"))["/a"] == 6
    assert clicks(eq("searchType", "image"), search_type="web")["/a"] == 6  # the specification's own comes first
    assert clicks(and_(eq("searchType", "image"), or_(eq("page", "/a"), eq("page", "/b"))))  == {"/a": 60, "/b": 0}
    v = {r.queryCanonical: r for r in P.canonical_variants(both, select("queryCanonical").where(JAN, eq("searchType", "image")).spec).collect()}
    assert v["shoe"].variants.startswith("red shoe:::60:::150:::3.0||")
    with pytest.raises(QueryError, match="search types"):
        P.run(lake, select("page").where(JAN, eq("searchType", "image")).spec)


def test_an_or_over_groups_is_answered_after_grouping(lake):
    spec = select("query").where(JAN, or_(gte("clicks", 9), lte("position", 2))).spec
    assert {r["query"] for r in P.run(lake, spec).collect()} == {"Red hat"}
    assert {r["query"] for r in P.run(lake, select("query").where(JAN, or_(gte("clicks", 9), lte("position", 3))).spec).collect()} == {"Red hat", "red shoe"}


def test_canonical_variants_round_to_one_decimal(spark, lake):
    pq = spark.createDataFrame([("/a", "red shoe", "2024-01-01", 5, 7, 3.0)], "url string, query string, date string, clicks long, impressions long, sum_position double").withColumn("date", F.to_date("date"))
    small = P.Lake({"queries": pq.drop("url")}, lake.query_dim)
    assert P.canonical_variants(small, select("queryCanonical").where(JAN).spec).first().variants == "red shoe:::5:::7:::1.4"
