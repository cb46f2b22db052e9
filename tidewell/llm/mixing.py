"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .shared import WORD_PATTERN, cut, quoted

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = 8
#: Words of a remaining budget left to the dynamic program; it gets at most three times as many, or one longest document more.
FIT_WORDS = 4096
#: Leading bits of the hash by which the documents of one length are cut.
BIN_BITS = 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(sid, source, source_size, target) of each source in code point order, null last.

    Sources share the size of all documents by their weights; none exceeds
    MOST_EPOCHS times its own size, and what it can't take is shared by weight
    among the rest until nobody is above. Each round is one aggregation.
    """
    spark = sized.sparkSession
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    fields = T.StructType([T.StructField("sid", T.LongType()), T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType())])
    placed = sums.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda r: (r[1], r[0].source, r[0].source_size))
    ranked = cut(spark.createDataFrame(placed, fields))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    most = (F.col("source_size") * MOST_EPOCHS).cast("double")
    level, capped = 0.0, -1
    while True:
        above = weight * F.lit(level) > most
        total, full, left, n = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, weight)), F.lit(0.0)), F.count_if(above)
        ).first()
        if n == capped or not left:
            break
        capped, level = n, (total - full) / left
    return ranked.withColumn("target", F.least(weight * F.lit(level), most))


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as near below ``budget`` as can be found.

    All but FIT_WORDS of the budget is shared by all lengths alike, rounded
    down; while more than twice FIT_WORDS are left the longest that fit are
    taken; a bounded-knapsack dynamic program over reachable sums, with counts
    in powers of two, fits the rest.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * max(0, budget - FIT_WORDS) // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        more = min(counts[i] - take[i], max(0, left - 2 * FIT_WORDS) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    pieces: list[tuple[int, int]] = []
    for i in order:
        room, step = min(counts[i] - take[i], left // lengths[i]), 1
        while room > 0:
            step = min(step, room)
            pieces.append((i, step))
            room -= step
            step *= 2
    reach, mask, before = 1, (1 << (left + 1)) - 1, []
    for i, step in pieces:
        before.append(reach)
        reach |= (reach << (step * lengths[i])) & mask
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for (i, step), old in zip(reversed(pieces[: len(before)]), reversed(before), strict=True):
        if not old >> at & 1:
            take[i] += step
            at -= step * lengths[i]
    return take


def mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Copies of each document in a mix of sources: row (a struct of ``keep``, all columns if None), size, source_size, target, copies.

    Size is the number of words (null: none). A source's target is met by whole
    epochs of all its documents and a subset for the remaining budget: its
    documents are counted by exact length, ``fit`` says how many of each length
    to take, and those with the smallest seeded hash of doc_id and text are
    taken. So a document has at most MOST_EPOCHS copies, and the words of a
    source miss its target by what no subset found can fill.

    Only length counts reach one task, one source each. A length that very many
    documents share is cut by ranges of the hash before it is ordered, and what
    is taken of it comes down to one number, the largest hash that is. So the
    last join is with one row for each source and length, which Spark
    broadcasts where it is small: texts are not shuffled then. Null texts have
    size 0 and their documents no copies beyond whole epochs; a null source is
    a source, a null doc_id a value. Rows that repeat doc_id, text and source count
    each, but are taken or left together. One row per input row; an empty table
    gives none.
    """
    base = docs.select(
        F.struct(*map(quoted, keep or docs.columns)).alias("row"),
        F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"),
        F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")).alias("h"),
    )
    # Words are counted once where few columns are kept; whole rows are read and counted again at the end.
    marks = cut(base if keep else base.drop("row"))
    binned = F.shiftright("h", 64 - BIN_BITS)
    narrow = cut(marks.groupBy("source", "size", binned.alias("bin")).agg(F.count("*").alias("n")).withColumn("words", F.col("size") * F.col("n")))
    targets = cut(source_targets(narrow.select("source", F.col("words").alias("size"))))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(0)
    plan = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    )
    each = narrow.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    lengths = each.where("size > 0").groupBy("sid", "size").agg(F.sum("n").alias("n"), F.first("budget").alias("budget"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        took = fit(pdf["size"].tolist(), pdf["n"].tolist(), int(pdf["budget"].iloc[0]))
        return pd.DataFrame({"sid": pdf["sid"], "size": pdf["size"], "quota": took})

    quotas = lengths.groupBy("sid").applyInPandas(choose, "sid long, size long, quota long")
    # The bin in which the quota of a length is reached, and how many documents it takes of it.
    up_to = F.sum("n").over(W.partitionBy("sid", "size").orderBy("bin"))
    cells = each.withColumn("up_to", up_to).join(quotas, ["sid", "size"], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    met = F.when((F.col("quota") > 0) & F.col("quota").between(F.col("up_to") - F.col("n") + 1, F.col("up_to")), F.struct("bin", (F.col("quota") - F.col("up_to") + F.col("n")).alias("need")))
    lines = cut(
        cells.groupBy("source", "size").agg(F.max(met).alias("met"), *[F.first(c).alias(c) for c in ("source_size", "target", "epochs")])
        .select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "epochs", "met.bin", "met.need")
    )
    cell = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    # Only hashes are ordered, a bin at a time, and equal ones are counted before.
    inside = marks.join(lines.where("need IS NOT NULL"), cell & (binned == F.col("bin"))).groupBy("source", "size", "need", "h").agg(F.count("*").alias("n"))
    reached = F.sum("n").over(W.partitionBy("source", "size").orderBy("h"))
    last = inside.withColumn("reached", reached).where("reached >= need").groupBy(F.col("source").alias("ls"), F.col("size").alias("lz")).agg(F.min("h").alias("last"))
    limits = cut(lines.join(last, F.col("s").eqNullSafe(F.col("ls")) & (F.col("z") == F.col("lz")), "left").select("s", "z", "source_size", "target", "epochs", "last"))
    taken = F.coalesce(F.col("h") <= F.col("last"), F.lit(False))
    return (marks if keep else base).join(limits, cell).select("row", "size", "source_size", "target", (F.col("epochs") + taken.cast("long")).alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it has copies, columns as they came, whatever their names; nulls as ``mix`` takes them."""
    return mix(docs).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
