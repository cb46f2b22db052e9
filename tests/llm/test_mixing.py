import random
import re
from collections import Counter, defaultdict

from tidewell.llm.mixing import fit, mix, mixed

SCHEMA = "doc_id long, text string, source string, size int"


def slow_targets(sizes):
    """sizes: by source, in order; weights 1, 2, 3 repeating; nobody above three times its size."""
    weight = {s: 1 + i % 3 for i, s in enumerate(sizes)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in sizes if s not in capped]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in sizes}
        capped |= above


def sample():
    rng = random.Random(12)
    rows = []
    for i in range(900):
        source = rng.choice(["b", "hot", "hot", "hot", "a", "ñ", "Z", None, "tiny"] if i > 20 else ["tiny"])
        if source == "tiny" and i > 40:
            source = "hot"
        n = 7 if source == "hot" and rng.random() < 0.5 else rng.choice([0, 1, 2, 3, 50, 333, 2000])
        rows.append((i, rng.choice([" ", "\n", "\t"]).join(["wörd"] * n), source, 0))
    rows += [(2000, None, "a", 1), (None, "x y", "a", 1), (None, "x y", "a", 1), (5, "x y", "a", 1), rows[7], (2001, "a\u00a0b c", "b", 1)]
    return rows


def test_targets_and_taken_words(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = mix(df).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies").collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = Counter()
    for _, t, s, _ in rows:
        sums[s] += size(t)
    order = sorted((s for s in sums if s is not None)) + [None]
    want = slow_targets({s: sums[s] for s in order})
    taken = Counter()
    for r in out:
        assert r.size == size(r.text) and r.source_size == sums[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    assert sum(want.values()) and any(abs(want[s] - 3 * sums[s]) < 1e-6 for s in order)
    for s in order:
        assert abs(taken[s] - want[s]) <= max(2, want[s] / 500), (s, taken[s], want[s])
    again = mix(spark.createDataFrame(rows[::-1], SCHEMA)).select("row.doc_id", "row.source", "row.text", "copies").collect()
    key = lambda r: (str(r.doc_id), str(r.source), str(r.text), r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again))
    kept = mixed(df)
    assert kept.columns == df.columns and kept.count() == sum(r.copies for r in out)


def test_fit_is_exact_where_a_subset_exists():
    rng = random.Random(3)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 8)))
        counts = [rng.randrange(1, 6) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts))
        budget = rng.randrange(total + 5)
        take = fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(n * t for n, t in zip(lengths, take)) <= budget or budget >= total
    assert sum(n * t for n, t in zip([3, 5], fit([3, 5], [10, 10], 47))) == 47


def test_hot_length_and_source_need_no_group_of_all_rows(spark):
    df = spark.createDataFrame([(i, "one two", "s" if i % 3 else "t", 0) for i in range(3000)], SCHEMA)
    got = mix(df).groupBy("row.source", "source_size").agg({"copies": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(2 * r["sum(copies)"] - r["max(target)"]) <= 2


def test_empty_tables(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = mix(spark.createDataFrame([(1, None, None, 0), (2, "", "a", 0)], SCHEMA)).collect()
    assert [(r.size, r.target, r.copies) for r in nothing] == [(0, 0.0, 0)] * 2
    assert defaultdict(int) == {}
