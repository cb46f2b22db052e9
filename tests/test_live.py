import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewell.sources import live
from tidewell.sources.live import live_facts, live_format, with_gaps

D = dt.date
PUSH = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture
def asked(spark, tmp_path):
    """The format over a fake API that notes each request in a file; what it gives, and the requests."""
    log = str(tmp_path / "requests")

    def client(request):
        with open(log, "a") as f:
            f.write(json.dumps(request) + "\n")
        dims = request["dimensions"]
        day = int(request["day"][-2:])
        rows = []
        for i in range(7):
            keys = {"url": f"https://a.example/{i}?x=1", "query": f"q{i % 3}"}
            if all((keys[d] == v) if op == "equals" else (v in keys[d]) for d, op, v in request["filters"]):
                rows.append({"keys": [keys[d] for d in dims], "clicks": i, "impressions": 10 * day, "position": 3.0})
        return rows[request["start_row"] : request["start_row"] + request["row_limit"]]

    spark.dataSource.register(live_format(client))
    before = spark.conf.get(PUSH)
    spark.conf.set(PUSH, "true")

    def requests():
        try:
            with open(log) as f:
                return [json.loads(x) for x in f]
        except FileNotFoundError:
            return []

    yield requests
    spark.conf.set(PUSH, before)


def test_pages_of_each_day_become_facts(spark, asked):
    got = live_facts(spark, "page_queries", "s", "2024-01-01", "2024-01-03", page_rows=3)
    assert got.rdd.getNumPartitions() == 3
    rows = got.collect()
    assert len(rows) == 21 and {(r.url, r["query"], r.sum_position) for r in rows if r.date == D(2024, 1, 2)} == {(f"/{i}", f"q{i % 3}", 40.0) for i in range(7)}
    # Seven rows are three pages of up to three.
    assert sorted((r["day"], r["start_row"]) for r in asked()) == [(f"2024-01-0{d}", s) for d in (1, 2, 3) for s in (0, 3, 6)]


def test_filters_reach_the_source(spark, asked):
    facts = live_facts(spark, "page_queries", "s", "2024-01-01", "2024-01-31")
    few = facts.where((F.col("date") >= D(2024, 1, 5)) & (F.col("date") < D(2024, 1, 7)) & (F.col("query") == "q1") & (F.col("clicks") > 1))
    assert {(r.date.day, r["query"], r.clicks) for r in few.collect()} == {(d, "q1", 4) for d in (5, 6)}
    assert {r["day"] for r in asked()} == {"2024-01-05", "2024-01-06"} and all(r["filters"] == [["query", "equals", "q1"]] for r in asked())
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "q1" not in plan.split("BatchScan")[0] and "clicks" in plan.split("BatchScan")[0]
    assert facts.where(F.col("date") > D(2024, 2, 1)).collect() == []
    assert facts.where((F.col("url") == "/3") & (F.col("date") == D(2024, 1, 9))).count() == 1


def test_without_pushdown_spark_says_what_to_set(spark, asked):
    spark.conf.set(PUSH, "false")
    with pytest.raises(AnalysisException, match="filterPushdown"):
        live_facts(spark, "queries", "s", "2024-01-01", "2024-01-04").count()


def test_only_days_that_lack_are_asked_for(spark, asked):
    stored = spark.createDataFrame([("/kept", D(2024, 1, d), 1, 1, 0.0) for d in (1, 2, 5, 9)], "url string, date date, clicks int, impressions int, sum_position double")
    covered = [(D(2023, 12, 1), D(2024, 1, 2)), (D(2024, 1, 5), D(2024, 1, 5))]
    both = with_gaps(stored, lambda a, b: live_facts(spark, "pages", "s", a, b), covered, "2024-01-01", "2024-01-07")
    days = {r.date.day: r.n for r in both.groupBy("date").agg(F.count("*").alias("n")).collect()}
    assert days == {1: 1, 2: 1, 3: 7, 4: 7, 5: 1, 6: 7, 7: 7}
    assert {r["day"][-2:] for r in asked()} == {"03", "04", "06", "07"}


def test_several_values_stay_with_spark():
    reader = live.Reader(lambda request: [], live.Asked("s", "web", ("query",), D(2024, 1, 1), D(2024, 1, 2)))
    several = live.In(("query",), ("a", "b"))
    assert list(reader.pushFilters([several, live.In(("query",), ("a",)), live.StringContains(("query",), "b")])) == [several]
    assert reader.asked.filters == (("query", "equals", "a"), ("query", "contains", "b"))
