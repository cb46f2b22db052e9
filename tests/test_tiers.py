import datetime as dt
import os
import random
import time

import pytest

from tidewell.sources import ingest
from tidewell.sources.ingest import TIERS, FactStore, end_of, start_of
from tidewell.sources.tiers import shadowed, spans

D = dt.date
FACT = "url string, date date, clicks int, impressions int, sum_position double"


def at(tier, day, kind="web"):
    return ("s", kind, tier, D.fromisoformat(day))


def dropped(parts, first=None, last=None):
    hidden = shadowed(parts, TIERS, end_of, *[D.fromisoformat(x) if x else None for x in (first, last)])
    return sorted(p[2:] for p, days in hidden.items() if spans(p, days, end_of))


WEEKS = [at("d7", d) for d in ("2026-04-01", "2026-04-06", "2026-04-13", "2026-04-20", "2026-04-27")]


def test_covered_partitions_supply_nothing():
    month = at("d30", "2026-04-01")
    assert dropped([month, *WEEKS]) == [("d30", D(2026, 4, 1))]
    # Only half of April is covered: the rest is read from the month.
    half = shadowed([month, *WEEKS[2:]], TIERS, end_of)
    assert half == {month: [(D(2026, 4, 13), D(2026, 4, 30))]}
    quarter = [at("d30", f"2025-{m}-01") for m in (10, 11, 12)]
    assert dropped([at("d90", "2025-10-01"), *quarter]) == [("d90", D(2025, 10, 1))]
    assert shadowed([at("d30", "2026-01-01"), at("d30", "2026-02-01"), at("raw", "2026-05-18")], TIERS, end_of) == {}
    assert shadowed([at("d30", "2026-03-01"), at("raw", "2026-03-10", "image"), at("hourly", "2026-03-10")], TIERS, end_of) == {}


def test_a_period_decides_what_is_covered():
    parts = [at("d30", "2026-04-01"), *WEEKS[:4]]
    assert dropped(parts) == [] and dropped(parts, "2026-02-21", "2026-04-23") == [("d30", D(2026, 4, 1))]
    assert dropped([at("d30", "2026-01-01"), at("raw", "2026-05-10")], "2026-05-01", "2026-05-31") == [("d30", D(2026, 1, 1))]


def test_each_day_is_supplied_by_its_finest_partition():
    rng = random.Random(2)
    for _ in range(60):
        days = [D(2025, 1, 1) + dt.timedelta(i) for i in range(200)]
        parts = {("s", "web", t, start_of(rng.choice(days), t)) for t in TIERS for _ in range(rng.randrange(12))}
        hidden = shadowed(parts, TIERS, end_of)
        for day in days:
            holders = [p for p in parts if start_of(day, p[2]) == p[3]]
            giving = [p for p in holders if not any(a <= day <= b for a, b in hidden.get(p, []))]
            assert giving == sorted(holders, key=lambda p: TIERS.index(p[2]))[:1]


def clicks(store, *period):
    return sorted((r.date, r.clicks) for r in store.read("pages", *period).collect())


@pytest.fixture
def store(spark, tmp_path):
    made = FactStore(spark, str(tmp_path / "facts"))
    rows = [("/a", D(2024, 1, 1) + dt.timedelta(i), i + 1, 10, 0.0) for i in range(31) if i != 8]
    made.write_days("pages", spark.createDataFrame(rows, FACT), "s")
    return made


@pytest.mark.parametrize("stop", ["marked", "written", "one part deleted"])
def test_reads_and_merges_around_a_broken_step(store, spark, monkeypatch, stop):
    before = clicks(store)

    class Stopped(Exception):
        pass

    def broken(self, table, site, kind, tier, firsts):
        if stop == "one part deleted":
            self.delete(self.path(table, site, kind, tier, firsts[0].isoformat()))
        raise Stopped

    with monkeypatch.context() as m:
        m.setattr(FactStore, "delete_all", broken)
        if stop == "written":
            m.setattr(FactStore, "set_mark", broken_mark := lambda self, *p: broken(self, "pages", "s", "web", "raw", [p[4]]))
            assert broken_mark
        with pytest.raises(Stopped):
            store.compact("pages", D(2024, 1, 20))
    assert {t for _, _, t, _ in store.partitions("pages")} == {"raw", "d7"}
    assert clicks(store) == before and clicks(store, "2024-01-03", "2024-01-04") == before[2:4]
    # A day that both hold is replaced where reads find it.
    store.write_days("pages", spark.createDataFrame([("/a", D(2024, 1, 3), 500, 1, 0.0)], FACT), "s")
    after = [(d, 500 if d == D(2024, 1, 3) else n) for d, n in before]
    assert clicks(store) == after
    store.compact("pages", D(2024, 3, 10))
    assert {t for _, _, t, _ in store.partitions("pages")} == {"d30"} and clicks(store) == after
    assert store.compact("pages", D(2024, 3, 10)) == 0


def test_overlaps_do_not_open_covered_partitions(store, spark):
    rows = store.whole("pages").where("first_day <= '2024-01-07'")
    store.put("pages", ingest.staged(rows).selectExpr("* except (tier, first_day)", "'d7' AS tier", "date '2024-01-01' AS first_day"))
    read = store.read("pages")
    files = read.inputFiles()
    assert read.count() == 30 and any("tier=d7" in f for f in files)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "d7" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]


def test_sweep_keeps_young_and_needed_folders(store, spark, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(FactStore, "delete_all", lambda *a: None)
        store.compact("pages", D(2024, 1, 20))
    folder = store.path("pages") + "/.spark-staging-x"
    os.makedirs(folder)
    before, now = clicks(store), int(time.time() * 1000)
    assert store.sweep(now, 3_600_000) == 0 and os.path.isdir(folder)
    swept = store.sweep(now + 7_200_000, 3_600_000)
    assert swept > 7 and not os.path.isdir(folder) and clicks(store) == before
    assert not any(t == "raw" and d < D(2024, 1, 8) for _, _, t, d in store.partitions("pages"))
    # Parts of a partition without its mark are what is read, so they stay.
    store.put("pages", store.spark.createDataFrame([("/a", D(2024, 1, 31), 1, 1, 0.0, "s", "web", "d7", D(2024, 1, 29))], FACT + ", site_id string, search_type string, tier string, first_day date"))
    assert store.sweep(now + 7_200_000, 3_600_000) == 0 and clicks(store) == before


def test_locks_keep_others_out_until_they_are_lost(store, monkeypatch):
    with store.locked("s", "pages"), pytest.raises(TimeoutError), store.locked("s", "pages", wait=0.3):
        pass
    with store.locked("s", "pages"):
        monkeypatch.setattr(ingest, "LOST_LOCK_MS", -1)
        with store.locked("s", "pages", wait=0.3):
            pass
