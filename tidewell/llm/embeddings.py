"""Embedding near-duplicates as an exact metric range join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (gives pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import components
from .shared import cut, parts_for, unit_hash

COSINE = 0.98
#: Pivots that a cell is split by.
PIVOTS = 8
#: Vectors that one comparison takes from one side, and the bytes they may have as doubles; a cell with more is split again.
CELL_SIDE = 16_384
CELL_BYTES = 32 << 20
#: Vectors of one cell that a task holds against its pivots.
CHUNK = 8192


def unit(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one in double precision."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    m /= np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def stored_type(embeddings: DataFrame) -> str:
    """Floats are shipped as they are, half the size of doubles; all else as doubles."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    return kind if kind == "array<float>" else "array<double>"


def vectors(embeddings: DataFrame) -> DataFrame:
    """Distinct vectors that can link, with their smallest vec_id and number of rows; space is the label and the length."""
    e = F.col("embedding")
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    return (
        embeddings.select("vec_id", "label", e.cast(stored_type(embeddings)).alias("embedding"))
        .where(F.coalesce(sound, F.lit(False)))
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
        .withColumn("space", F.concat_ws(":", "label", F.size("embedding")))
    )


def sized(cells: DataFrame, side: int) -> DataFrame:
    """(cell, n, side): how many vectors a cell holds, and how many of them one comparison takes."""
    fits = F.greatest(F.lit(64), F.floor(F.lit(CELL_BYTES) / (8 * F.col("dim"))))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))
    return cut(sizes.select("cell", "n", F.least(F.lit(side), fits).cast("long").alias("side")))


def far_apart(m: np.ndarray, most: int, least: float) -> list[int]:
    """Up to ``most`` rows, each the furthest from those before it, and none nearer to them than ``least``."""
    chosen = [0]
    away = np.sqrt(np.maximum(2 - 2 * (m @ m[0]), 0))
    while len(chosen) < most and away.max() > least:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.sqrt(np.maximum(2 - 2 * (m @ m[chosen[-1]]), 0)))
    return chosen


def split(cells: DataFrame, sizes: DataFrame, cosine: float, most: int, level: int) -> DataFrame:
    """The vectors of the cells in ``sizes`` dealt to the cells of their pivots, with copies at the boundaries.

    Unit vectors with a cosine of at least c lie within r = sqrt(2 - 2c). Each
    vector belongs to the cell of its nearest pivot. Another vector within r of
    it lies at most 2r further from that pivot than from its own (triangle
    inequality): so a vector is also sent to every pivot p with d(v, p) <=
    d(v, own) + 2r, tightened by the distance from the plane between the two
    pivots, which may not exceed r. Of ``most`` times four home vectors, drawn by
    seeded hash, those furthest apart are the pivots. A large cell is dealt to
    tasks in chunks, each with the same vectors to choose from.
    """
    spark = cells.sparkSession
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    kind = cells.schema["embedding"].dataType.simpleString()
    hashed = unit_hash("node", "cell", seed=7 + level)
    homes = cells.where("home").join(sizes, "cell").withColumn("u", hashed).where(F.col("u") * F.col("n") < 8 * most)
    first = F.row_number().over(W.partitionBy("cell").orderBy("u", "node"))  # some 8 * most rows of a cell
    drawn = cut(homes.withColumn("k", first).where(F.col("k") <= 4 * most).select("cell", "k", "n", F.col("embedding").alias("pivot")))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    members = cells.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(5)), chunks).cast("int")).drop("n", "side")
    sent = drawn.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select("cell", "chunk", "k", "pivot")

    def place(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        rows = rows.select(["cell", "home", "node", "copies", "embedding"]).combine_chunks()
        if not len(rows):
            return rows
        if not len(pivots):  # none drawn: the cell stays as it is
            return rows.set_column(0, "cell", pa.array([f"{c}/0" for c in rows.column("cell").to_pylist()]))
        drawn = unit(pivots.sort_by("k").column("pivot").combine_chunks())
        p, v = drawn[far_apart(drawn, most, 2 * reach)], unit(rows.column("embedding").combine_chunks())
        dots = v @ p.T
        own = dots.argmax(axis=1)
        best = dots[np.arange(len(own)), own][:, None]
        apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[own]
        near = np.sqrt(np.maximum(2 - 2 * dots, 0)) <= np.sqrt(np.maximum(2 - 2 * best, 0)) + 2 * reach
        near &= (best - dots) <= reach * apart + 1e-9
        near[np.arange(len(own)), own] = True
        row, to = np.nonzero(near)
        out = rows.take(pa.array(row))
        names = pa.array([f"{rows.column('cell')[0].as_py()}/{k}" for k in range(len(p))])
        home = out.column("home").combine_chunks().to_numpy(zero_copy_only=False).astype(bool) & (to == own[row])
        return out.set_column(0, "cell", names.take(pa.array(to))).set_column(1, "home", pa.array(home))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(cells.count(), 100_000))
    fields = f"cell string, home boolean, node long, copies long, embedding {kind}"
    return cut(
        members.repartition(parts, "cell", "chunk").groupBy("cell", "chunk").cogroup(sent.repartition(parts, "cell", "chunk").groupBy("cell", "chunk")).applyInArrow(place, fields)
    )


def cells_of(distinct: DataFrame, cosine: float, pivots: int, side: int) -> DataFrame:
    """cell, home, node, copies and embedding of each vector in each cell it is held against, by a tree of pivots.

    Each space is split by its pivots, and so is each cell that is too large
    for one comparison, level by level, so that no vector is held against more
    than a few pivots at once. Where vectors lie so close to all boundaries
    that a split would send more rows than comparing the cell in chunks does,
    the cell is left whole: a choice by counts, without effect on the links.
    """
    now = distinct.select(F.col("space").alias("cell"), F.lit(True).alias("home"), "node", "copies", "embedding")
    level, done = 1, []
    now = split(now, sized(now, side), cosine, pivots, 0)
    while True:
        sizes = sized(now, side)
        large = cut(sizes.where("n > side"))
        if large.isEmpty():
            break
        finer = split(now, large, cosine, pivots, level)
        # Rows that comparing in chunks sends, of the cell and of all its parts.
        sends = F.col("n") * F.ceil(F.col("n") / F.col("side"))
        above = F.regexp_replace("cell", "/[0-9]+$", "")
        parts = sized(finer, side).groupBy(above.alias("cell")).agg(F.sum(F.col("n") + sends).alias("sent"))
        better = cut(large.join(parts, "cell").where(F.col("sent") < sends).select("cell"))
        done.append(now.join(better, "cell", "left_anti"))
        now = finer.withColumn("above", above).join(better.withColumnRenamed("cell", "above"), "above", "left_semi").drop("above")
        level += 1
    for part in done:
        now = now.unionByName(part)
    return now


def range_join(distinct: DataFrame, cosine: float, pivots: int, side: int) -> tuple[DataFrame, DataFrame]:
    """(node, linked) and (a, b): how many rows each distinct vector links with, and edges that span the groups.

    Cells are joined each by itself: a vector's links are counted in its home
    cell alone. A cell of more vectors than one comparison takes is dealt over
    pairs of chunks.
    """
    spark = distinct.sparkSession
    placed = cut(cells_of(distinct, cosine, pivots, side))
    dealt = (
        placed.join(sized(placed, side), "cell")
        .withColumn("g", F.ceil(F.col("n") / F.col("side")).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("g")).cast("int"))
    )
    # As a row (1) a home vector meets all chunks of its cell, as a column (2) each vector meets the rows of all chunks.
    own, other = F.col("own"), F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    spot = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    at = F.col("other")
    roles = F.when(at == own, F.array(F.when(F.col("home"), spot(own, own, 3)).otherwise(spot(own, own, 2)))).when(
        F.col("home"), F.array(spot(own, at, 1), spot(at, own, 2))
    ).otherwise(F.array(spot(at, own, 2)))
    sent = dealt.withColumn("other", other).withColumn("s", F.explode(roles)).select("cell", "s.i", "s.j", "s.role", "node", "copies", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        rows, cols = (table.take(pa.array(np.flatnonzero(role & bit))).combine_chunks() for bit in (1, 2))
        none = np.zeros(0, np.int64)
        if not len(rows) or not len(cols):
            return pa.table({"node": none, "linked": none, "to": none})
        cols = cols.sort_by("node").combine_chunks()
        u, v = (unit(x.column("embedding").combine_chunks()) for x in (rows, cols))
        node, copies, ids = rows.column("node").to_numpy(), cols.column("copies").to_numpy(), cols.column("node").to_numpy()
        linked, edges = np.zeros(len(u), np.int64), [np.zeros((0, 2), np.int64)]
        for at in range(0, len(u), 256):
            hit = u[at : at + 256] @ v.T >= cosine
            hit &= node[at : at + 256, None] != ids[None, :]
            r, c = np.nonzero(hit)
            if len(r):
                linked[at : at + 256] = np.bincount(r, copies[c], len(hit)).astype(np.int64)
                edges.append(forest(node[at + r], ids[c]))
        pairs = forest(*np.concatenate(edges).T)
        zero = np.zeros(len(pairs), np.int64)
        return pa.table({"node": np.r_[node, pairs[:, 0]], "linked": np.r_[linked, zero], "to": np.r_[node, pairs[:, 1]]})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(placed.count(), 50_000))
    found = cut(sent.repartition(parts, "cell", "i", "j").groupBy("cell", "i", "j").applyInArrow(compare, "node long, linked long, to long"))
    counts = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    return counts, found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b"))


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges from each node to the smallest it reaches, for links between ids a and b."""
    from .simhash import joined

    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = joined(len(ids), iter([(at[: len(a)], at[len(a) :])]))
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return np.c_[ids[label[moved]], ids[moved]]


def embedding_groups(embeddings: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS, side: int = CELL_SIDE) -> DataFrame:
    """Near-duplicates among vectors of one label: vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, their lengths are
    equal and their cosine, in double precision, is at least ``cosine``. A
    vector that is null, empty, zero or holds a null or non-finite component,
    and one whose vec_id or label is null, links with nothing: n_links 0,
    component_id its own vec_id, kept true (false for a null vec_id).

    One row per input row. n_links counts the other rows linked directly, so
    copies count each; component_id is the smallest vec_id reachable, itself
    included; kept says vec_id = component_id. Rows that share a vec_id share
    its component. Empty tables give no rows; other columns are ignored.
    """
    e = F.col("embedding").cast(stored_type(embeddings))
    distinct = cut(vectors(embeddings))
    counts, edges = range_join(distinct, cosine, pivots, side)
    labels = components(edges)
    per_vector = (
        distinct.join(counts, "node", "left")
        .join(labels, "node", "left")
        .select(
            F.col("label").alias("of_label"),
            F.col("embedding").alias("of"),
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    rows = embeddings.select("vec_id", "label", e.alias("embedding"))
    return rows.join(
        per_vector,
        (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of")) & F.col("vec_id").isNotNull(),
        "left",
    ).select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept"),
    )
