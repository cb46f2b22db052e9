import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.plans.periods import Period
from tidewell.plans.planner import Lake
from tidewell.plans.spec import QueryError, between, contains, eq, gte, select
from tidewell.sources import routing as R

D = dt.date
ROWS = [("/a", "red shoe", D(2024, 1, 1), 5, 100, 300.0), ("/a", "blue shoe", D(2024, 1, 2), 1, 50, 0.0)]
SCHEMA = "url string, query string, date date, clicks long, impressions long, sum_position double"
JAN = between("date", "2024-01-01", "2024-01-31")


@pytest.fixture()
def lake(spark):
    pq = spark.createDataFrame(ROWS, SCHEMA)
    dim = spark.createDataFrame([("red shoe", "shoe"), ("blue shoe", "shoe")], "query string, query_canonical string")
    return Lake({"page_queries": pq, "pages": pq.drop("query"), "queries": pq.drop("url")}, dim)


def test_lists_of_files_and_attached_tables(spark, tmp_path):
    day = spark.createDataFrame([("/a", D(2024, 1, 1), 1, 2)], "url string, date date, clicks int, impressions int")
    day.write.parquet(str(tmp_path / "old"))
    day.withColumn("sum_position", F.lit(4.0)).write.parquet(str(tmp_path / "new"))
    files = R.lake_of_files(spark, {"pages": [str(tmp_path / "old"), str(tmp_path / "new")], "queries": []})
    assert sorted(str(r.sum_position) for r in files.tables["pages"].collect()) == ["4.0", "None"] and files.tables["queries"].collect() == []
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    try:
        day.withColumn("sum_position", F.lit(0.0)).write.mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable("shop.pages")
        assert R.SqlSource("x", R.attached(spark, "shop", ["pages"])).query(select("page").where(JAN).spec).first().clicks == 1
        with pytest.raises(R.MissingTables) as err:
            R.attached(spark, "shop", ["pages", "queries", "dates"])
        assert err.value.tables == ["queries", "dates"]
    finally:
        spark.sql("DROP DATABASE shop CASCADE")


def test_sql_sees_every_table_and_column(lake):
    source = R.SqlSource("store", lake)
    assert source.sql("SELECT count(*) AS n FROM hourly_pages").first().n == 0
    assert source.sql("SELECT sum(clicks) AS n FROM queries WHERE date >= :since", since="2024-01-02").first().n == 1
    seen = []
    R.SqlSource("other", lake, lambda text, args: seen.append((text, args))).sql("SELECT 1", a=2)
    assert seen == [("SELECT 1", {"a": 2})]


def test_routes(lake):
    days = R.Coverage(D(2024, 1, 1), D(2024, 2, 28), (Period(D(2024, 1, 1), D(2024, 1, 20)), Period(D(2024, 1, 22), D(2024, 2, 28))))
    why = lambda *f, dims=("page",), c=days: R.why_live(select(*dims).where(*f).spec, c)
    assert why(JAN) == "gap" and why(between("date", "2024-01-22", "2024-02-01")) is None and why(between("date", "2023-12-31", "2024-01-02")) == "outside"
    assert why(JAN, c=R.Coverage()) == "nothing-stored" and why(JAN, c=R.Coverage(D(2024, 1, 1), D(2024, 2, 28))) is None
    assert why(JAN, eq("country", "x")) == "cross-dimension" and why(contains("page", "a")) is None
    # What the live source can't answer stays with the store.
    assert R.why_live(select("page").where(JAN).prefilter(gte("clicks", 2)).spec, days) is None and why(JAN, dims=("queryCanonical",)) is None and why(JAN, gte("clicks", 2)) == "gap"
    asked = []
    both = R.Composite(R.SqlSource("store", lake), lambda s: asked.append(s), days)
    assert both.query(select("page").where(between("date", "2024-01-01", "2024-01-05")).spec).first().clicks == 6
    both.query(select("page").where(JAN).spec)
    assert len(asked) == 1 and both.sql("SELECT 1 AS x").first().x == 1


def test_decisions(lake):
    page, canon = select("page").where(JAN).spec, select("queryCanonical").where(JAN).spec
    rows = lake.tables["pages"].where("clicks > 1")
    assert R.decide(page, R.Rollup(rows)) == R.Decision("primary")
    for rollup, why in ((None, "primary-missing"), (R.Rollup(None), "primary-empty"), (R.Rollup(rows, "2024-01-02"), "primary-missing-coverage"), (R.Rollup(rows, None, "2024-01-30"), "primary-stale-coverage")):
        assert R.decide(page, rollup, raw_allowed=True) == R.Decision("raw", (why,))
        with pytest.raises(QueryError, match=why):
            R.decide(page, rollup)
    assert R.decide(canon, None, R.Rollup(rows, None, "2024-01-31")) == R.Decision("canonical-rollup")
    assert R.decide(canon, None, R.Rollup(rows, None, "2024-01-30")).passed == ("canonical-stale-coverage",)
    assert R.decide(select("queryCanonical").where(JAN, contains("query", "x")).spec, None, R.Rollup(rows)).passed == ("canonical-not-coverable",)
    got, made = R.run(lake, page, R.Rollup(rows))
    assert made.source == "primary" and got.first().clicks == 5 and R.run(lake, page)[0].first().clicks == 6
    daily = lake.tables["queries"].withColumn("query_canonical", F.lit("rolled")).drop("query")
    assert R.run(lake, canon, canonical=R.Rollup(daily))[0].first().queryCanonical == "rolled" and R.run(lake, canon)[0].first().queryCanonical == "shoe"


def test_sql_knows_the_position_of_sums(lake):
    sql = "SELECT url, gsc_position(SUM(sum_position), SUM(impressions)) AS p, gsc_position(SUM(sum_position), SUM(impressions - impressions)) AS none FROM pages GROUP BY url"
    for _ in range(2):
        assert [(r.url, r.p, r.none) for r in R.SqlSource("s", lake).sql(sql).collect()] == [("/a", 3.0, None)]
