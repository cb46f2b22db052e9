"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, as a class for Java and RE2 patterns.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


class Cuts(threading.local):
    """Folders of the tables that this thread has written with ``cut`` and that still stand, the latest last."""

    def __init__(self) -> None:
        self.paths: list[str] = []


CUTS = Cuts()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a session on one machine (master local)
    takes /tmp/checkpoints; on a cluster that would lose data, so it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or '/tmp/checkpoints').rstrip('/')}/tidewell/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage so that loops stay cheap and a lost executor costs no
    recomputation of what lies before the cut. The files stay until
    ``clear_cuts``, as results that are not computed yet may read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    CUTS.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_cuts(spark: SparkSession, paths: list[str]) -> None:
    """Delete some of the tables in CUTS; nothing may need them still."""
    for path in list(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        CUTS.paths.remove(path)


#: Rows of a few numbers up to which a written table is broadcast: some 24 MB.
BROADCAST_ROWS = 500_000


def small_enough(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to broadcast if it is counted small; else as it is, for a join by key."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts_for(rows_or_bytes: int, each: int) -> int:
    """How many parts hold ``rows_or_bytes`` at ``each`` per part, at least one."""
    return max(1, -(-int(rows_or_bytes) // each))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def unit_hash(*cols, seed: int = 0):
    """A seeded number in (0, 1) that depends on nothing but the given columns."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def quoted(name: str) -> str:
    """A column's name as it is, dots and backticks included, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with up to ``most_bytes`` in a string or binary column, one row at least."""
    values = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(values):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to
