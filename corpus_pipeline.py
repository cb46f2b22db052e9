"""Quality classifier, near-copies, benchmark leaks, mixing and sharding, one after the other over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.decontaminate import drop_leaks
from tidewell.llm.mixing import mixed
from tidewell.llm.quality import keep_good
from tidewell.llm.shards import shard_documents
from tidewell.llm.shared import CUTS, clear_cuts, cut, read
from tidewell.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", source_mix),
    ("sharding", sharding),
]

#: Seeded sampling, hashed models and file sizes have no SQL form; tests hold the stages against slow versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``: one row of each copy in the mix, with its shard.

    Once a stage's documents are written, the tables that the stages wrote before them are deleted.
    """
    docs, since = read(spark, sf_dir, "documents"), len(CUTS.paths)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        clear_cuts(spark, CUTS.paths[since:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
