import random

import pytest

from tidewell.llm.shards import FANOUT, Conflict, Shard, ShardStore, shard_documents

SCHEMA = "doc_id long, text string, shard_id int, file string"


def rows(n, at=0):
    return [(at + i, f"text {i} " + "x" * (i % 300), i, "f") for i in range(n)]


def test_append_compact_and_read_give_the_rows_back(spark, tmp_path):
    data = rows(3000) + [(None, None, None, None), (5, "", 1, "f"), (5, "", 1, "f"), (9999, "long " * 100_000, 1, "f")]
    store = ShardStore(spark, f"file://{tmp_path}/a", target_bytes=60_000)
    df = spark.createDataFrame(data, SCHEMA)
    store.append(df.limit(0))
    assert store.read() is None
    for part in range(7):
        store.append(df.where(f"pmod(coalesce(doc_id, 0), 7) = {part}").repartition(5, "text"))
    before = store.manifest()
    assert len(before.shards) > 20
    after = store.compact()
    assert after.version > before.version and len(after.shards) < len(before.shards)
    tiers = {}
    for s in after.shards:
        if 2 * s.bytes <= store.target:
            tiers[store.tier(s.bytes)] = tiers.get(store.tier(s.bytes), 0) + 1
    assert all(n < FANOUT for n in tiers.values())
    store.vacuum()
    key = lambda r: str(tuple(r))
    got = store.read().select("row.*")
    assert got.columns == df.columns
    assert sorted(map(key, got.collect())) == sorted(map(key, df.collect()))


def test_commit_is_atomic_and_refuses_a_taken_version(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    one, two = ShardStore(spark, root), ShardStore(spark, root)
    base = two.manifest()
    one.append(spark.createDataFrame(rows(10), SCHEMA))
    with pytest.raises(Conflict):
        two.commit(base, [])
    assert two.manifest() == one.manifest() and two.manifest().version == 1
    orphan = two.written(spark.createDataFrame(rows(10), SCHEMA), 2)
    assert orphan and two.read().count() == 10
    two.vacuum()
    assert two.read().count() == 10 and not any(two.fs.exists(two.Path(f"{root}/{s.path}")) for s in orphan)


def test_every_row_gets_its_shard(spark):
    df = spark.createDataFrame(rows(2000) + [(None, None, None, None), (7, "again", 0, "f")], SCHEMA).repartition(8)
    got = shard_documents(df, target_bytes=4000).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in df.collect())
    assert len({r.shard_file for r in got}) == len({r.shard_id for r in got}) > 1
    assert shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_each_merged_shard_holds_one_group(spark, tmp_path):
    target = 60_000
    store = ShardStore(spark, f"file://{tmp_path}/c", target_bytes=target)
    noise = "array_join(transform(sequence(1, 20), j -> hex(xxhash64(id, j))), '')"
    store.append(spark.range(8000).selectExpr("id AS doc_id", f"{noise} AS text").repartition(64))
    before = store.manifest()
    groups = store.groups(before.shards)
    assert len(groups) > 8
    in_group = {s.path.rpartition("/")[2]: i for i, g in enumerate(groups) for s in g}
    of_doc = {r[0]: in_group.get(r[1]) for r in store.rows(before.shards).select("row.doc_id", "shard_file").collect()}
    after = store.compact()
    assert all(s.bytes <= target * 1.1 for s in after.shards)
    held = {}
    for r in store.rows([s for s in after.shards if s.run == before.version + 1]).select("row.doc_id", "shard_file").collect():
        held.setdefault(r[1], set()).add(of_doc[r[0]])
    assert len(held) == len(groups) and all(len(x) == 1 for x in held.values())


def test_two_writers_never_commit_the_same_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = ShardStore(spark, f"file://{tmp_path}/d")
    base = store.manifest()

    def attempt(i):
        try:
            return store.commit(base, [Shard(f"x/{i}", i, 1)])
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        made = [m for m in pool.map(attempt, range(24)) if m]
    assert len(made) == 1 and store.manifest() == made[0]
    assert [n for n, _ in store.files(".") if n.startswith(".aside") or n.endswith(".json")] == ["manifest-0000000001.json"]


def slow_compaction(sizes, target):
    """Sizes after merging runs of alike shards, one run at a time, until no tier is full."""
    tier = lambda s: next(t for t in range(21) if s * FANOUT ** (t + 1) > target or t == 20)
    while True:
        tiers = {}
        for s in sizes:
            if 2 * s <= target:
                tiers.setdefault(tier(s), []).append(s)
        runs = []
        for members in tiers.values():
            if len(members) >= FANOUT:
                run = []
                for s in members:
                    if run and sum(run) + s > target:
                        runs.append(run)
                        run = []
                    run.append(s)
                runs.append(run)
        runs = [r for r in runs if len(r) > 1]
        if not runs:
            return sizes
        for r in runs:
            for s in r:
                sizes.remove(s)
        sizes = sizes + [sum(r) for r in runs]


@pytest.mark.parametrize("n", [2, 8, 128])
def test_groups_against_a_slow_version(spark, tmp_path, monkeypatch, n):
    """The tiers and runs alone, with files whose size is the sum of what they merge."""
    rng = random.Random(n)
    target = 1000
    start = [rng.choice([1, 3, 40, 90, 200, 260, 499, 700]) for _ in range(5 * n)]
    store = ShardStore(spark, f"file://{tmp_path}/e{n}", target_bytes=target)
    live = [Shard(f"s{i}", size, 0) for i, size in enumerate(start)]
    while groups := store.groups(live):
        assert all(sum(s.bytes for s in g) <= target and len(g) > 1 for g in groups)
        gone = {s.path for g in groups for s in g}
        live = [s for s in live if s.path not in gone] + [Shard(f"{g[0].path}+", sum(s.bytes for s in g), 1) for g in groups]
    assert sorted(s.bytes for s in live) == sorted(slow_compaction(list(start), target))


@pytest.mark.parametrize("groups", [2, 8, 128])
def test_no_merged_shard_exceeds_the_target(spark, tmp_path, groups):
    noise = "array_join(transform(sequence(1, 6), j -> hex(xxhash64(id, j))), '')"
    store = ShardStore(spark, f"file://{tmp_path}/f{groups}", target_bytes=20_000)
    store.append(spark.range(groups * 120).selectExpr("id AS doc_id", f"{noise} AS text").repartition(groups * 3))
    assert len(store.groups(store.manifest().shards)) >= groups / 2
    after = store.compact()
    assert after.version > 1 and all(s.bytes <= store.target for s in after.shards)
    assert store.read().count() == groups * 120


def test_a_vacuum_between_write_and_commit_loses_no_committed_row(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/v")
    store.append(spark.createDataFrame(rows(10), SCHEMA))
    base = store.manifest()
    new = store.written(spark.createDataFrame(rows(5), SCHEMA), base.version + 1)
    store.vacuum(grace_ms=3_600_000)
    kept = store.commit(base, base.shards + new)
    assert store.read().count() == 15
    gone = store.written(spark.createDataFrame(rows(5), SCHEMA), kept.version + 1)
    store.vacuum()
    with pytest.raises(Conflict):
        store.commit(kept, kept.shards + gone)
    assert store.manifest() == kept and store.read().count() == 15


def test_an_append_goes_after_another_writer(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/w"
    one, two = ShardStore(spark, root), ShardStore(spark, root)
    written, first = ShardStore.written, []

    def interrupted(self, *args):
        shards = written(self, *args)
        if self is one and not first:
            first.append(two.append(spark.createDataFrame(rows(4), SCHEMA)))
            two.vacuum()  # deletes what the other has not committed
        return shards

    monkeypatch.setattr(ShardStore, "written", interrupted)
    assert one.append(spark.createDataFrame(rows(6), SCHEMA)).version == 2 and one.read().count() == 10
