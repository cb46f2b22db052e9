"""A stream of API rows against the batch path."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewell.sources.ingest import FactStore, from_api, last_of_each, summed_by_key
from tidewell.streaming.ingest import latest_rows, write_days

RAW = "keys array<string>, clicks int, impressions int, position double, arrived timestamp"
T0 = dt.datetime(2024, 1, 10)


def raw_rows(seed=3):
    """Four batches: tuples that come again with other metrics, addresses that fold together, dates up to two days late."""
    rng = random.Random(seed)
    batches = []
    for k in range(4):
        rows = []
        for i in range(200):
            date = dt.date(2024, 1, 1 + 2 * k + rng.randrange(3))
            url = f"https://{rng.choice(['', 'www.'])}a.example/{rng.randrange(4)}{rng.choice(['', '?x=1'])}"
            rows.append(([url, date.isoformat()], rng.randrange(50), 100, 1.0 + rng.randrange(5), T0 + dt.timedelta(seconds=1000 * k + i)))
        batches.append([*rows, rows[0], (["https://a.example/", None], 1, 1, 1.0, T0), (["https://a.example/", "no date"], 1, 1, 1.0, T0), (None, 1, 1, 1.0, T0)])
    return batches


def facts(df):
    return sorted((r.url, r.date.isoformat(), r.clicks, r.impressions, r.sum_position) for r in df.collect())


def batch_path(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] and r[0][1] and r[0][1] != "no date"], RAW)
    return facts(summed_by_key(from_api(last_of_each(df, ["keys"], "arrived"), "pages"), "pages"))


def test_a_table_gives_the_batch_rows(spark):
    rows = [r for b in raw_rows() for r in b]
    got = facts(summed_by_key(latest_rows(spark.createDataFrame(rows, RAW), "pages"), "pages"))
    assert got == batch_path(spark, rows) and len(got) > 20
    assert latest_rows(spark.createDataFrame([], RAW), "pages").collect() == []


def test_repeats_and_late_rows_over_batches_and_a_restart(spark, tmp_path):
    batches, store = raw_rows(), FactStore(spark, str(tmp_path / "facts"))
    done = []
    for k, rows in enumerate(batches):
        # A part of the rows in a file of its own; each run starts again from the checkpoint.
        for half in (rows[::2], rows[1::2]):
            spark.createDataFrame(half, RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = write_days(latest_rows(stream, "pages", "3 days"), store, "pages", "s", str(tmp_path / "ck"))
        query.awaitTermination(180)
        done += rows
        newest = dt.date(2024, 1, 3 + 2 * k)
        flushed = [r for r in facts(store.read("pages")) if r]
        want = [r for r in batch_path(spark, done) if dt.date.fromisoformat(r[1]) < newest - dt.timedelta(3)]
        assert flushed == want
    assert {r[1] for r in flushed} == {f"2024-01-0{d}" for d in range(1, 6)}
    # What the stream still holds is read from its rows as a table.
    rest = latest_rows(spark.createDataFrame(done, RAW), "pages").where(F.col("date") > "2024-01-05")
    store.write_days("pages", rest, "s")
    assert facts(store.read("pages")) == batch_path(spark, done)


def test_windows_do_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        rows = [r for b in raw_rows(5) for r in b]
        got = latest_rows(spark.createDataFrame(rows, RAW), "pages")
        assert facts(summed_by_key(got, "pages")) == batch_path(spark, rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
