"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder of this application below ``spark.checkpoint.dir``.

    Where that is missing, a session on one machine takes /tmp/checkpoints and
    a cluster raises, as its executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or '/tmp/checkpoints').rstrip('/')}/tidewell/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a shared folder and read it again, so that loops keep short plans and lost executors cost no replay."""
    spark = df.sparkSession
    path = shared_path(spark, "staged")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
