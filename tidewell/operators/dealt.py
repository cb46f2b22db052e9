"""Joins and running sums whose work is dealt over tasks however large a key or a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.staging import staged

#: Rows of a key that meet each other in one tile.
TILE_ROWS = 512


def pairs_within(rows: DataFrame, key: str, item: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Each two rows of a key with item below other: key, all columns of the one, and those of the other with ``other_`` before.

    A key's rows are dealt over tiles by a hash of the item, and each two tiles
    meet once, in a triangle, so what meets in one place is two tiles, whatever
    the key. Null keys and items pair with nothing; items of a key must differ.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > tile_rows).select(key, F.ceil(F.col("_n") / tile_rows).cast("int").alias("_tiles"))
    dealt = rows.join(sizes, key, "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_tiles")).cast("int"))
    met = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    met = met.withColumn("_low", F.least("_own", "_with")).withColumn("_high", F.greatest("_own", "_with")).drop("_tiles", "_with")
    keys = [key, "_low", "_high"]
    others = met.select(*keys, *[F.col(c).alias(f"other_{c}") for c in (*rows.columns, "_own") if c != key])
    # Two rows of one tile meet in each of its places, and count in its own.
    place = (F.least("_own", "other__own") == F.col("_low")) & (F.greatest("_own", "other__own") == F.col("_high"))
    return met.join(others, keys).where(place & (F.col(item) < F.col(f"other_{item}"))).drop("_low", "_high", "_own", "other__own")


def running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all rows before in ``order``, whose values must differ.

    Rows are dealt by ranges of ``order``; each range sums its own, and takes
    over the total of the ranges before it, of which there are as many as
    partitions. So no task orders more than its range.
    """
    # Written, so that ranges stay what they are in both reads.
    placed = staged(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("_part", start.alias("_start"))
    own = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_own") + F.col("_start")).drop("_part", "_own", "_start")
