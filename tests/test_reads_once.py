"""Facts are made of joins, whose tables go through the driver, so a query makes them once."""

import pytest
from pyspark.sql import functions as F

from tidewell import report_queries, rollup_queries
from tidewell.analyzer_queries import BEFORE, NOW
from tidewell.operators import movement
from tidewell.plans.planner import Lake
from tidewell.sources import facts, rebuild as rollup_module
from tidewell.sources.facts import Facts
from tidewell.sources.rebuild import CanonicalRollup
from tidewell.sources.staging import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture
def counted(spark):
    """Facts, how many rows they have, and how many have been read."""
    rows = staged(facts.sparse(spark, SF).page_queries)
    read = spark.sparkContext.accumulator(0)

    def seen(n):
        read.add(1)
        return n

    return Facts(rows.withColumn("impressions", F.udf(seen, "long").asNondeterministic()("impressions"))), rows.count(), read


def test_canonical_rollup(spark, counted, monkeypatch):
    f, n, read = counted
    dim = f.page_queries.select("query").distinct().withColumn("query_canonical", F.substring("query", 1, 2))
    monkeypatch.setattr(rollup_queries, "lake", lambda *a: Lake({"queries": f.queries}, dim))
    assert rollup_queries.canonical_in_steps(spark, SF).count() and read.value == n


def test_parts_of_the_canonical_rollup_send_no_names_to_the_driver(spark, counted, tmp_path, monkeypatch):
    plans = []
    real = rollup_module.canonical_daily
    monkeypatch.setattr(rollup_module, "canonical_daily", lambda *a: plans.append(real(*a)) or plans[-1])
    queries = staged(counted[0].queries)
    CanonicalRollup(spark, str(tmp_path), 900, 2).build(queries, staged(queries.select("query").distinct().withColumn("query_canonical", F.col("query"))), 1)
    assert len(plans) == 6 and not any("Broadcast" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_query_migration(counted):
    f, n, read = counted
    assert movement.query_migration(f, NOW, BEFORE).collect() and read.value == n


def test_query_migration_of_periods_that_overlap(spark):
    day = F.to_date(F.lit("2024-01-01"))
    rows = spark.createDataFrame([("q", "/a", 30, 0), ("q", "/b", 40, 5), ("r", "/c", 30, 2), ("", "/a", 50, 0), ("q", None, 50, 9), ("s", "/d", 25, 0)], "query string, url string, impressions long, d int")
    f = Facts(rows.select("query", "url", "impressions", F.lit(0).alias("clicks"), F.lit(0.0).alias("sum_position"), F.date_add(day, F.col("d")).alias("date")))
    got = movement.query_migration(f, ("2024-01-02", "2024-01-06"), ("2024-01-01", "2024-01-03")).collect()
    # /c is seen in both, so it hasn't moved; s and q have one letter each, as good as equal.
    assert sorted(map(tuple, got)) == [("/a", "/b", 30.0, 1, 1), ("/d", "/b", 25.0, 1, 0)]


@pytest.mark.parametrize("name", ["opportunities", "growth"])
def test_reports(spark, counted, monkeypatch, name):
    f, n, read = counted
    monkeypatch.setitem(report_queries.FACTS, name, lambda *a: f)
    assert report_queries.query(name)(spark, SF).collect() and read.value == n


def test_many_parts_do_not_go_through_the_driver(spark, monkeypatch):
    plan = lambda: facts.long(spark, SF).page_queries._jdf.queryExecution().executedPlan().toString()
    few = sorted(map(tuple, facts.long(spark, SF).page_queries.collect()))
    monkeypatch.setattr(facts, "BROADCAST_PARTS", 10, raising=False)
    assert "Broadcast" not in plan()
    assert sorted(map(tuple, facts.long(spark, SF).page_queries.collect())) == few
