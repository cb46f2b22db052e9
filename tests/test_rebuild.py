import datetime as dt
import os
import random

import pytest

from tidewell.operators.rollups import canonical_daily
from tidewell.sources.published import Superseded
from tidewell.sources.rebuild import CANONICAL, CANONICAL_ROLLUPS, DEFAULT_ROLLUPS, CanonicalRollup, RollupFiles, top_keywords

FACTS = "query string, date date, clicks int, impressions int, sum_position double"


def facts(spark, seed=1, n=400):
    rng = random.Random(seed)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(70))
    return spark.createDataFrame([(f"q{rng.randrange(30)}", day(), rng.randrange(5), rng.randrange(50), float(rng.randrange(90))) for _ in range(n)], FACTS)


def dim(spark):
    return spark.createDataFrame([(f"q{i}", f"c{i % 7}") for i in range(25)], "query string, query_canonical string")


def told(df):
    return sorted((r.query_canonical, r.date, r.clicks, r.impressions, r.sum_position) for r in df.collect())


@pytest.mark.parametrize("shards", [1, 3])
def test_a_build_in_steps_gives_the_rows_of_one_shot(spark, tmp_path, shards):
    rows, names = facts(spark), dim(spark)
    rollup = CanonicalRollup(spark, str(tmp_path / "r"), window_days=28, shards=shards)
    total = 3 * shards
    for left in range(total - 1, 0, -1):
        assert rollup.build(rows, names, 100, most=1) == left
        with pytest.raises(LookupError):
            rollup.read()
    # A step with other settings goes on by the plan that was written.
    assert CanonicalRollup(spark, rollup.root, 7, 9).build(rows, names, 100, seconds=600) == 0
    assert told(rollup.read()) == told(canonical_daily(rows, names))
    one = CanonicalRollup(spark, str(tmp_path / "one"), window_days=1000)
    assert one.build(rows, names, 1) == 0 and told(one.read()) == told(rollup.read())
    within = lambda a, z: [r for r in told(canonical_daily(rows, names)) if a <= r[1].isoformat() <= z]
    for a, z in (("2024-01-20", "2024-02-03"), ("2024-03-01", "2024-03-01"), ("2020-01-01", "2020-02-01")):
        assert told(rollup.read(a, z)) == within(a, z)
    assert rollup.build(rows, names, 100) == 0
    with pytest.raises(Superseded):
        rollup.build(rows, names, 99)


def test_a_part_that_broke_off_is_built_again_and_reads_stay_with_the_last_version(spark, tmp_path, monkeypatch):
    rows, more, names = facts(spark), facts(spark, 2, 900), dim(spark)
    rollup = CanonicalRollup(spark, str(tmp_path / "r"), window_days=40, shards=2)
    assert rollup.build(rows, names, 1) == 0
    assert rollup.build(more, names, 2, most=1) == 3
    from tidewell.sources.published import Published

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Published, "mark", lost)
        with pytest.raises(OSError):
            rollup.build(more, names, 2)
    written = [f for f in os.listdir(tmp_path / "r/parts/2") if f.startswith("window=")]
    assert written and told(rollup.read()) == told(canonical_daily(rows, names))
    assert rollup.build(more, names, 2) == 0
    assert told(rollup.read()) == told(canonical_daily(more, names))


def test_an_empty_table_and_queries_without_a_canonical_form(spark, tmp_path):
    none = CanonicalRollup(spark, str(tmp_path / "none"))
    assert none.build(spark.createDataFrame([], FACTS), dim(spark), 1) == 0
    assert none.read().collect() == [] and none.read().schema == CANONICAL
    rows = spark.createDataFrame([("alone", dt.date(2024, 1, 1), 1, 2, 3.0)], FACTS)
    own = CanonicalRollup(spark, str(tmp_path / "own"))
    assert own.build(rows, dim(spark), 1) == 0 and told(own.read()) == [("alone", dt.date(2024, 1, 1), 1, 2, 3.0)]


def test_top_keywords_are_files_that_can_be_filtered(spark, tmp_path):
    rows = facts(spark)
    files = RollupFiles(spark, str(tmp_path / "f"))
    with pytest.raises(LookupError):
        files.read("top_keywords_28d_parquet")
    for built_at, most in ((5, 10), (6, 12)):
        files.write("top_keywords_28d_parquet", top_keywords(rows, "2024-03-10", most=most), built_at)
    got = files.read("top_keywords_28d_parquet")
    assert got.columns == ["query", "clicks", "impressions", "sum_position"] and got.count() == 12
    sums = {}
    for r in rows.where("date >= '2024-02-11'").collect():
        sums[r.query] = sums.get(r.query, 0) + r.clicks
    best = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:12]
    assert {r.query: r.clicks for r in got.collect()} == dict(best)
    with pytest.raises(Superseded):
        files.write("top_keywords_28d_parquet", top_keywords(rows, "2024-03-10"), 6)


def test_a_set_is_written_and_what_it_lacks_is_told(spark, tmp_path):
    files = RollupFiles(spark, str(tmp_path / "f"))
    made = {"daily_totals": spark.range(3), "query_canonical_daily": spark.range(2)}
    assert files.write_set(DEFAULT_ROLLUPS, made, 1) == [i for i in DEFAULT_ROLLUPS if i != "daily_totals"]
    assert files.write_set(CANONICAL_ROLLUPS, made, 1) == ["query_canonical_variants"]
    assert files.read("daily_totals").count() == 3
