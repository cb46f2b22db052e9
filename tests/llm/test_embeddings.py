import numpy as np
from pyspark.sql import functions as F

from tidewell.llm.embeddings import cells_of, embedding_groups, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def slow(rows):
    usable = []
    for i, (v, e, label, _) in enumerate(rows):
        ok = v is not None and e and label is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)
        if ok:
            usable.append(i)
    unit = {i: np.asarray(rows[i][1], np.float32).astype(float) for i in usable}
    near = lambda i, j: rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] / np.sqrt((unit[i] @ unit[i]) * (unit[j] @ unit[j])) >= 0.98
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in usable:
        for j in usable:
            if i != j and near(i, j):
                links[i] += 1
                root[find(i)] = find(j)
    for i in usable:
        for j in usable:
            if rows[i][0] == rows[j][0]:
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        low = min([rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None], default=None)
        out.append((r[0], links[i], low, r[0] is not None and r[0] == low))
    return sorted(out, key=str)


def sample():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        rows.append((i, rng.normal(size=8).astype(np.float32).tolist(), int(rng.integers(3)), "x"))
    for i in range(400, 700):
        base = rows[int(rng.integers(400))]
        rows.append((i, (np.asarray(base[1]) + rng.normal(size=8) * 0.2).astype(np.float32).tolist(), base[2], "y"))
    rows += [(700 + i, rows[7][1], rows[7][2], "copy") for i in range(40)]
    rows += [(800, None, 1, "n"), (801, [0.0] * 8, 1, "z"), (802, [float("nan")] + [1.0] * 7, 1, "q"), (803, [None] + [1.0] * 7, 1, "q"), (804, rows[7][1], None, "l"), (None, rows[7][1], rows[7][2], "i"), (805, [], 1, "e"), (806, [float("inf")] * 8, 1, "f"), (807, [1.0, 2.0], 1, "short"), (808, [2.0, 4.0], 1, "short")]
    return rows


def test_against_brute_force(spark):
    rows = sample()
    want = slow(rows)
    # One cell level; a tree of several levels; cells dealt over pairs of chunks; doubles in place of floats.
    for pivots, side, kind in ((8, 10_000, "float"), (3, 40, "float"), (1, 50, "float"), (4, 60, "double")):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")).repartition(3)
        got = sorted([tuple(r) for r in embedding_groups(df, pivots=pivots, side=side).collect()], key=str)
        assert got == want


def test_tree_splits_large_cells(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(1500, 3))
    rows = [(i, e.astype(np.float32).tolist(), 1) for i, e in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    distinct = vectors(df).cache()
    cells = cells_of(distinct, 0.9999, 4, 100).cache()
    sizes = cells.groupBy("cell").count().collect()
    assert max(r["cell"].count("/") for r in sizes) > 1 and max(r["count"] for r in sizes) <= 250
    assert cells.where("home").count() == 1500 and cells.count() < 3000
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.9999).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_groups(df, 0.9999, 4, 100).collect()}
    assert [got[i] for i in range(1500)] == want.tolist() and want.sum() > 50


def test_empty_table(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).collect() == []
