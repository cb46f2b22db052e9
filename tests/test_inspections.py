import datetime as dt
import random

import duckdb
from pyspark.sql import types as T

from tidewell import rollup_queries
from tidewell.operators.indexing import latest, transitions
from tidewell.sources.inspections import InspectionStore

SCHEMA = T.StructType().add("url", "string").add("inspected_at", "timestamp").add("verdict", "string").add("page_fetch_state", "string")
FIELDS = ("verdict", "page_fetch_state")


def rows(seed, n=200):
    rng = random.Random(seed)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))
    return [(f"/{rng.randrange(12)}", at(), rng.choice(["PASS", "FAIL", None]), rng.choice(["OK", None])) for _ in range(n)]


def told(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_batches_in_any_order_end_in_the_same_tables(spark, tmp_path):
    whole = rows(1) + [(None, dt.datetime(2024, 1, 1), "PASS", None), ("/x", None, "PASS", None)]
    once = InspectionStore(spark, str(tmp_path / "once"), SCHEMA, FIELDS, 8)
    once.add(spark.createDataFrame(whole, SCHEMA))
    parts = [whole[i::4] for i in range(4)]
    parts = [parts[2], parts[0], parts[3], parts[0], parts[1]]
    by_part = InspectionStore(spark, str(tmp_path / "parts"), SCHEMA, FIELDS, 8)
    for part in parts:
        by_part.add(spark.createDataFrame(part, SCHEMA))
    log = once.table("log", SCHEMA).drop("bucket")
    assert log.count() == len({r[:2] for r in whole if r[0] and r[1]})
    for store in (once, by_part):
        assert told(store.latest()) == told(latest(log)) and told(store.changes()) == told(transitions(log, FIELDS))
    assert once.changes().count() > 20


def test_a_batch_touches_its_own_buckets_and_broken_runs_are_mended(spark, tmp_path, monkeypatch):
    store = InspectionStore(spark, str(tmp_path / "s"), SCHEMA, FIELDS, 16)
    assert store.latest().collect() == [] and store.changes().collect() == [] and store.add(spark.createDataFrame([], SCHEMA)) == []
    store.add(spark.createDataFrame(rows(2), SCHEMA))
    one = spark.createDataFrame([("/3", dt.datetime(2025, 1, 1), "NEUTRAL", "x")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(InspectionStore, "derive", lambda *a: None)
        touched = store.add(one)
    assert len(touched) == 1 and store.latest().where("verdict = 'NEUTRAL'").count() == 0
    assert store.add(one) == touched and [r.url for r in store.latest().where("verdict = 'NEUTRAL'").collect()] == ["/3"]
    assert told(store.changes()) == told(transitions(store.table("log", SCHEMA).drop("bucket"), FIELDS))


def test_a_change_that_is_taken_back_goes(spark, tmp_path):
    store = InspectionStore(spark, str(tmp_path / "s"), SCHEMA, FIELDS, 4)
    first = [("/a", dt.datetime(2024, 1, d), "PASS", "OK") for d in (1, 2)]
    for other in ("FAIL", "NEUTRAL", "PARTIAL", "x", "y", "z"):
        store = InspectionStore(spark, str(tmp_path / other), SCHEMA, FIELDS, 4)
        store.add(spark.createDataFrame([first[0], ("/a", first[1][1], other, "OK")], SCHEMA))
        assert store.changes().count() == 1
        store.add(spark.createDataFrame([first[1]], SCHEMA))
        assert store.changes().count() == (0 if store.latest().first().verdict == "PASS" else 1)


def test_inspections_of_one_moment_all_count(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    # Each moment holds two states, so it is left by a change, the last one too.
    whole = [(f"/{k % 3}", at(d), state, "OK") for k in range(6) for d in (1, 2, 3) for state in ("PASS", "FAIL")]
    store = InspectionStore(spark, str(tmp_path / "s"), SCHEMA, FIELDS, 4, tuple(SCHEMA.names))
    for part in (whole[::2], whole[1::2], whole[::2]):
        store.add(spark.createDataFrame(part, SCHEMA))
    assert store.table("log", SCHEMA).count() == len(set(whole))
    assert {r.url: r["count"] for r in store.changes().groupBy("url").count().collect()} == {f"/{k}": 3 for k in range(3)}


def test_events_of_one_moment_as_in_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        events.withColumn("event_id", events.event_id + 100_000 * k).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = rollup_queries.QUERIES["inspection_store_changes"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(rollup_queries.SQL["inspection_store_changes"]).fetchall()
    assert len(want) > 10 and sorted(got[["url", "n"]].itertuples(index=False, name=None)) == sorted(want)
