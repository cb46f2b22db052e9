"""The log of url inspections, the newest of each url and the changes between them, kept up to date batch by batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.indexing import STATE_FIELDS, latest, transitions
from .ingest import last_of_each
from .staging import staged


@dataclass(frozen=True)
class InspectionStore:
    """Tables log, latest and changes under a root, each dealt over ``buckets`` folders by a hash of the url.

    A batch rewrites the folders of the urls it holds and no others. An
    inspection is its columns ``key``, as a rule its url and moment; of several, the
    one with the largest hash of its columns stays. Where a moment may hold several
    inspections, ``key`` has what tells them apart, all columns if need be. So a
    batch that is added again changes nothing, and batches
    in any order end in the same tables. The log is written first, and the
    other two follow from it: where a run broke off, ``add`` of the same batch,
    or ``derive`` of its buckets, mends them. One writer at a time.
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    fields: tuple[str, ...] = STATE_FIELDS
    buckets: int = 64
    key: tuple[str, ...] = ("url", "inspected_at")

    def bucket(self):
        return F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")

    def table(self, name: str, schema: T.StructType) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        whole = T.StructType([*schema, T.StructField("bucket", T.IntegerType())])
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.root}/{name}")

    def put(self, name: str, rows: DataFrame) -> None:
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "url", "inspected_at")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{name}")

    def add(self, batch: DataFrame) -> list[int]:
        """Add inspections (columns of ``schema``; others are left out, rows without url or moment too); the buckets that changed."""
        new = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).where("url IS NOT NULL AND inspected_at IS NOT NULL")
        new = staged(new.withColumn("bucket", self.bucket()))
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # ``buckets`` at most
        if touched:
            old = self.table("log", self.schema).where(F.col("bucket").isin(touched))
            columns = [f.name for f in self.schema]
            both = old.unionByName(new).withColumn("_same", F.lit(0))
            self.put("log", staged(last_of_each(both, list(self.key), "_same").select(*columns, "bucket")))
            self.derive(touched)
        return touched

    def derive(self, touched: list[int]) -> None:
        """Make latest and changes of some buckets anew from their part of the log."""
        rows = self.table("log", self.schema).where(F.col("bucket").isin(touched))
        self.put("latest", latest(rows))
        found = staged(self.changed(rows))
        self.put("changes", found)
        for empty in set(touched) - {r.bucket for r in found.select("bucket").distinct().collect()}:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/changes/bucket={empty}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def changed(self, rows: DataFrame) -> DataFrame:
        return transitions(rows, self.fields)

    def latest(self) -> DataFrame:
        return self.table("latest", self.schema).drop("bucket")

    def changes(self) -> DataFrame:
        """As ``transitions`` gives them over the whole log: inspections with previous_at and previous values of the state fields."""
        of = self.changed(self.spark.createDataFrame([], self.schema)).schema
        return self.table("changes", of).drop("bucket")
