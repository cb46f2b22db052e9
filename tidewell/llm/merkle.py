"""A Merkle tree over a table's rows, with a proof for each row that it belongs to the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import cut, parts_for, small_enough

#: What goes into a leaf, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that become one.
GROUP = 2
#: Levels whose proofs are built at a time: a node is asked for by GROUP ** (TIER + 1) rows at most.
TIER = 8
#: Rows a task numbers.
ROWS_PER_TASK = 1 << 18


#: Of a step: the hashes of the run's other nodes before and after, none of either left out.
STEPS = "array<struct<before:binary,after:binary>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def text_of(hashes: Column) -> Column:
    """Bytes of hashes as lowercase hex, which is what digests are taken of."""
    return F.lower(F.hex(hashes))


def chained(hashes: Column) -> Column:
    return F.aggregate(hashes, F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x))


def leaf_hash(columns: list[Column]) -> Column:
    """Digest of the values in turn: `-` if null, else the length in bytes, a colon and the value."""
    cell = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return digest(*[cell(v) for v in columns])


def numbered(rows: DataFrame, within: str, order: list[str]) -> DataFrame:
    """``rows`` with their place, ``idx``, among those of equal ``within`` (null too) by ``order``, nulls first; equal rows in any order.

    Rows are dealt by ranges and sorted within tasks; a task's rows of one
    ``within`` start where those of the tasks before end. A column
    salt parts equal rows, so that no range has to hold them all.
    """
    salted = cut(rows.withColumn("salt", F.monotonically_increasing_id()))
    keys = [within, *order, "salt"]
    # Written, so that places stay whatever is computed again.
    dealt = salted.repartitionByRange(parts_for(salted.count(), ROWS_PER_TASK), *keys).sortWithinPartitions(*keys)
    placed = cut(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).drop("salt"))
    pieces = placed.groupBy(within, "part").agg(F.min("place").alias("first"), F.count("*").alias("n_here"))
    before = F.coalesce(F.sum("n_here").over(W.partitionBy(within).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.select(F.col(within).alias("of"), F.col("part").alias("in_part"), (before - F.col("first")).alias("shift"))
    return placed.join(starts, (F.col("part") == F.col("in_part")) & F.col(within).eqNullSafe(F.col("of"))).withColumn("idx", F.col("place") + F.col("shift")).drop("of", "in_part", "part", "place", "shift")


def tree_nodes(leaves: DataFrame, group: int) -> DataFrame:
    """tree, level, idx, hash, n (nodes of the tree on that level) of ``leaves`` (tree, idx, hash, n) and all nodes above.

    ``group`` consecutive nodes become the digest of their hashes, until one is left.
    """
    level = cut(leaves.select("tree", F.lit(0).alias("level"), "idx", "hash", "n"))
    found, depth = level, 0
    most = level.agg(F.max("n")).first()[0] or 0
    while most > 1:
        depth, most = depth + 1, parts_for(most, group)
        run = F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("run")
        parents = level.where("n > 1").groupBy("tree", F.floor(F.col("idx") / group).alias("idx")).agg(run, F.max("n").alias("n"))
        up = F.unhex(digest(text_of(chained(F.col("run.hash"))))).alias("hash")
        level = cut(parents.select("tree", F.lit(depth).alias("level"), "idx", up, F.ceil(F.col("n") / group).alias("n")))
        found = found.unionByName(level)
    return found


def proofs(nodes: DataFrame, tops: DataFrame, group: int, tier: int = TIER) -> DataFrame:
    """tree, idx, steps for each leaf of ``nodes``: what a fold needs on each level up to the root, in order.

    Each node of every ``tier``-th level explodes the coordinates of the
    siblings that it and its ancestors have below the next such level, which
    follow from its place and the size of the runs, joins them with the table of
    nodes, and takes over the steps of its ancestor there. ``tops`` (tree,
    steps) go on where a tree ends. So no node is asked for by more rows than a
    tier spans.
    """
    heights = small_enough(cut(nodes.groupBy("tree").agg(F.max("level").alias("height"))))
    roots = heights.join(tops, "tree", "left").withColumn("steps", F.coalesce("steps", F.array().cast(STEPS)))
    zero = F.lit(0).cast("long")
    known = cut(roots.select("tree", F.ceil(F.col("height") / tier).cast("int").alias("tier"), zero.alias("idx"), "steps"))
    highest = known.agg(F.max("tier")).first()[0] or 0
    for k in reversed(range(highest)):
        low = k * tier
        up_to = F.least(F.lit(low + tier), F.col("height")) - 1
        base = nodes.where(F.col("level") == low).join(heights, "tree").where(F.col("height") > low).select("tree", "idx", "height")
        own = F.floor(F.col("idx") / F.pow(F.lit(group), F.col("level") - low).cast("long"))
        first = F.col("own") - F.col("own") % group
        asked = (
            base.withColumn("level", F.explode(F.sequence(F.lit(low), up_to))).withColumn("own", own)
            .withColumn("sibling", F.explode(F.sequence(first, first + (group - 1)))).where("sibling <> own").drop("height")
        )
        given = nodes.where(F.col("level").between(low, low + tier - 1)).select("tree", "level", F.col("idx").alias("sibling"), "hash")
        met = F.sort_array(F.collect_list(F.struct("level", "sibling", "own", "hash"))).alias("met")
        siblings = asked.join(given, ["tree", "level", "sibling"]).groupBy("tree", "idx").agg(met)
        side = lambda level, on: chained(F.transform(F.filter("met", lambda x: (x["level"] == level) & on(x["sibling"], x["own"])), lambda x: x["hash"]))
        step = lambda level: F.struct(side(level, lambda s, o: s < o).alias("before"), side(level, lambda s, o: s > o).alias("after"))
        none = F.array().cast(siblings.schema["met"].dataType)
        steps = F.transform(F.sequence(F.lit(low), up_to), step)
        parent = F.when(F.col("height") <= low + tier, zero).otherwise(F.floor(F.col("idx") / group**tier))
        mine = base.join(siblings, ["tree", "idx"], "left").withColumn("met", F.coalesce("met", none)).select("tree", "idx", steps.alias("own_steps"), parent.alias("parent"))
        upper = known.where(F.col("tier") == k + 1).select("tree", F.col("idx").alias("parent"), "steps")
        built = mine.join(upper, ["tree", "parent"]).select("tree", F.lit(k).alias("tier"), "idx", F.concat("own_steps", "steps").alias("steps"))
        known = known.where(F.col("tier") <= k).unionByName(built)
        known = cut(known) if k else known
    return known.select("tree", "idx", "steps")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf, in hex, and its steps."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(text_of(s["before"]), acc, text_of(s["after"])))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return digest(text_of(chained(F.transform(steps, lambda s: F.concat(s["before"], s["after"])))))


def manifest(leaves: DataFrame, group: int = GROUP) -> DataFrame:
    """All columns of ``leaves`` (tree_key, row_key, leaf and others) with subroot, root and steps, the proof of each leaf.

    The leaves of a ``tree_key`` (a string; null is one) ascend by ``row_key``,
    nulls first, then by leaf. Every ``group`` consecutive nodes become the
    digest of their hashes in hex, the last ones fewer, until one is left, the
    subroot; subroots in the order of their keys, null first and by bytes, likewise give the
    root. Rows equal in key and leaf stand in any order, so each has one of
    their proofs. A single leaf is its subroot. An empty table gives no rows.
    """
    placed = cut(numbered(leaves, "tree_key", ["row_key", "leaf"]))
    counts = placed.groupBy("tree_key").agg(F.count("*").alias("n"))
    keys = cut(numbered(counts.withColumn("top", F.lit(0)), "top", ["tree_key"]).select("tree_key", "n", F.col("idx").alias("tree")))
    of_key = small_enough(keys.withColumnRenamed("tree_key", "of"))
    rows = placed.join(of_key, F.col("tree_key").eqNullSafe(F.col("of"))).drop("of")
    nodes = tree_nodes(rows.select("tree", "idx", F.unhex("leaf").alias("hash"), "n"), group)
    subroots = cut(nodes.where("n = 1").select("tree", "hash"))
    top = tree_nodes(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash", F.lit(keys.count()).alias("n")), group)
    tops = cut(proofs(top, subroots.sparkSession.createDataFrame([], f"tree long, steps {STEPS}"), group).select(F.col("idx").alias("tree"), "steps"))
    root = top.where("n = 1").select(text_of(F.col("hash")).alias("root"))  # one row
    ends = small_enough(cut(subroots.select("tree", text_of(F.col("hash")).alias("subroot")).join(F.broadcast(root))))
    return rows.join(ends, "tree").join(proofs(nodes, tops, group), ["tree", "idx"]).drop("tree", "idx", "n")


def verified(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """The manifest of ``docs`` (LEAF_COLUMNS), each proof checked against a copy that has been tampered with.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the copy
    has one more in n_chars where 7 divides crc32 of the doc_id as text (a null
    doc_id or n_chars stays as it is), and ``verified`` says whether its leaf and the
    siblings of the original give the root. Other columns are not looked at.
    """
    values = [F.col(c) for c in LEAF_COLUMNS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claim = leaf_hash([changed if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS])
    # What would be the same hash again is left out.
    leaves = docs.select(F.col("lang").cast("string").alias("tree_key"), F.col("doc_id").alias("row_key"), leaf_hash(values).alias("leaf"), F.when(changed != F.col("n_chars"), claim).alias("claim"))
    proved = manifest(leaves, group).withColumn("folded_root", folded(F.coalesce("claim", "leaf"), F.col("steps")))
    return proved.select(F.col("row_key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
