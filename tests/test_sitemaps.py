import datetime as dt
import os
import random

import pytest

from tidewell.sources.published import Superseded
from tidewell.sources.sitemaps import Incomplete, SitemapStore

A, B, C = "https://s.example/a.xml", "https://s.example/b.xml", "https://s.example/c.xml"
DAY = 86_400_000
URLS = "loc string, lastmod string"


def put(store, spark, generation, at, feeds):
    for feed, urls in feeds.items():
        store.stage(generation, at, feed, spark.createDataFrame([(k, v) for k, v in urls.items()], URLS))
    return store.publish(generation, at, list(feeds))


def held(df):
    return {(r.feed, r.loc): r.lastmod for r in df.collect()}


def moment(ms):
    return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None)


def test_generations_follow_each_other_with_their_changes(spark, tmp_path):
    store = SitemapStore(spark, str(tmp_path / "s"))
    with pytest.raises(LookupError):
        store.entries()
    assert store.events().collect() == []
    rng = random.Random(4)
    was, seen, expected = {}, {}, []
    for k in range(3):
        feeds = [A, B, C][: 3 - (k == 2)]
        lists = {f: {f"/{rng.randrange(60)}": rng.choice([None, "2024-01-01", "2024-02-02"]) for _ in range(40)} for f in feeds}
        assert put(store, spark, f"g{k}", k * DAY, lists)
        now = {(f, loc): m for f, urls in lists.items() for loc, m in urls.items()}
        seen = {x: seen.get(x, k) for x in now}
        for x in now.keys() | was.keys():
            if x not in was:
                expected.append((k, "added", *x, now[x], None))
            elif x not in now:
                expected.append((k, "removed", *x, None, was[x]))
            elif now[x] != was[x]:
                expected.append((k, "updated", *x, now[x], was[x]))
        assert held(store.entries()) == now
        assert {(r.feed, r.loc): r.first_seen_at for r in store.entries().collect()} == {x: moment(j * DAY) for x, j in seen.items()}
        was = now
    told = lambda df: sorted(((r.observed_at - moment(0)).days, r.op, r.feed, r.loc, r.lastmod, r.previous_lastmod) for r in df.collect())
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(told(store.events()), key=key) == sorted(expected, key=key)
    assert {x[0] for x in told(store.events("1970-01-02", "1970-01-02"))} == {1}
    assert store.events("1971-01-01").collect() == []
    assert store.generation()["generation"] == "g2" and store.generation("g0")["feeds"] == [A, B, C]
    assert set(held(store.entries("g0", A))) == {x for x, j in [((r.feed, r.loc), 0) for r in store.entries("g0").collect()] if x[0] == A}


def test_only_whole_generations_are_published_and_in_order(spark, tmp_path):
    store = SitemapStore(spark, str(tmp_path / "s"))
    store.stage("g", DAY, A, spark.createDataFrame([("/x", None), ("/x", "2024"), (None, "y"), (" ", None)], URLS))
    with pytest.raises(Incomplete) as e:
        store.publish("g", DAY, [A, B])
    assert e.value.missing == [B] and store.found() is None
    store.stage("g", DAY, B, spark.createDataFrame([], URLS))
    assert store.publish("g", DAY, [A, B]) and not store.publish("g", DAY, [A, B])
    assert held(store.entries()) == {(A, "/x"): "2024"}
    for late in (("h", DAY), ("h", 0), ("g", 2 * DAY)):
        with pytest.raises(Superseded):
            store.stage(*late, A, spark.createDataFrame([], URLS))
    store.stage("h", 2 * DAY, A, spark.createDataFrame([("/y", None)], URLS))
    assert held(store.entries()) == {(A, "/x"): "2024"}
    store.abort("h", 2 * DAY)
    with pytest.raises(Incomplete):
        store.publish("h", 2 * DAY, [A])
    with pytest.raises(ValueError):
        store.abort("g", DAY)
    for bad in ("ftp://s.example/a", "https://u:p@s.example/a", "", "a.xml"):
        with pytest.raises(ValueError):
            store.stage("h", 2 * DAY, bad, spark.createDataFrame([], URLS))
    assert store.publish("none", 3 * DAY, []) and store.entries().count() == 0
    assert [(r.op, r.loc) for r in store.events("1970-01-04").collect()] == [("removed", "/x")]


def test_a_writer_that_was_overtaken_publishes_nothing(spark, tmp_path, monkeypatch):
    store = SitemapStore(spark, str(tmp_path / "s"))
    store.stage("slow", DAY, A, spark.createDataFrame([("/slow", None)], URLS))
    import tidewell.sources.sitemaps as module

    real = module.staged

    def overtaken(df):
        monkeypatch.setattr(module, "staged", real)
        put(store, spark, "fast", 2 * DAY, {A: {"/fast": None}})
        return real(df)

    monkeypatch.setattr(module, "staged", overtaken)
    with pytest.raises(Superseded):
        store.publish("slow", DAY, [A])
    assert held(store.entries()) == {(A, "/fast"): None}
    assert [r.loc for r in store.events().collect()] == ["/fast"]


def test_pages_give_the_generation_and_open_their_files_only(spark, tmp_path, monkeypatch):
    store = SitemapStore(spark, str(tmp_path / "s"), file_rows=10)
    lists = {f: {f"/{f[-5]}{i:03d}": None for i in range(n)} for f, n in ((A, 70), (B, 1), (C, 33))}
    put(store, spark, "g", DAY, lists)
    every = sorted((f, loc) for f, urls in lists.items() for loc in urls)
    assert store.page(limit=1000)[1] is None
    for feed, limit in ((None, 7), (None, 104), (C, 33), (A, 20), (B, 1)):
        got, cursor, pages = [], None, 0
        while pages == 0 or cursor:
            rows, cursor = store.page(limit, cursor, feed)
            got += [(r.feed, r.loc) for r in rows]
            pages += 1
            if pages == 1:
                put(store, spark, f"later{feed}{limit}", store.generation()["observed_at"] + 1, lists)
        wanted = [x for x in every if feed in (None, x[0])]
        assert got == wanted and pages == -(-len(wanted) // limit)
    assert store.page(5, feed="https://s.example/none.xml") == ([], None)
    _, cursor = store.page(5)
    for bad in (dict(limit=0), dict(limit=10_001), dict(cursor="x"), dict(cursor=cursor, feed=A), dict(cursor=cursor, generation="g"), dict(cursor="[1]")):
        with pytest.raises(ValueError):
            store.page(**bad)
    with pytest.raises(LookupError):
        store.page(generation="never")
    # A page at the end reads neither the first files nor most of the others.
    files = os.listdir(f"{store.root}/entries/{store.folder(store.found())}")
    opened = []
    reader = type(spark.read)
    real = reader.parquet
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, **k: (opened.extend(paths), real(self, *paths, **k))[1])
    newest = store.generation()["generation"]
    import json

    rows, _ = store.page(5, json.dumps([newest, None, C, "/c020"]))
    assert [r.loc for r in rows] == [f"/c{i:03d}" for i in range(21, 26)]
    entries = [p for p in opened if "/entries/" in p]
    assert 1 <= len(entries) <= 3 < len([f for f in files if f.endswith(".parquet")])


def test_membership_names_the_first_feed_that_lists_a_url(spark, tmp_path):
    store = SitemapStore(spark, str(tmp_path / "s"))
    put(store, spark, "g", DAY, {B: {"/x": "2024", "/y": None}, A: {"/x": None}})
    asked = spark.createDataFrame([("/x",), ("/x",), ("/z",), (None,), ("/y",)], "url string")
    got = [(r.url, r.present, r.feed, r.lastmod) for r in store.membership(asked).collect()]
    assert sorted(got, key=str) == sorted([("/x", True, A, None)] * 2 + [("/z", False, None, None), (None, False, None, None), ("/y", True, B, None)], key=str)
