"""Index cohorts: sections and kinds of path whose pages are indexed worse than the rest of a site."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..metrics import over
from .dealt import running_sum
from .indexing import wilson

#: Fewest pages of a cell, and of all others, for a comparison.
LEAST_PAGES = 12
#: Chance of any false finding among all cells that are compared.
FAMILY_ALPHA = 0.05


def critical_value(tested: int) -> float:
    """The two-sided bound for ``tested`` comparisons at once (Bonferroni)."""
    return abs(NormalDist().inv_cdf(FAMILY_ALPHA / max(1, tested) / 2))


def memberships(pages: DataFrame) -> DataFrame:
    """path, indexed, dimension, key: the sections of a path at one and two levels, and whether it lies below a version."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    one, two = F.concat(F.lit("/"), F.get(parts, F.lit(0))), F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, 2), "/"))
    sections = F.when(F.size(parts) == 0, F.array(F.lit("/"))).when(F.size(parts) == 1, F.array(one)).otherwise(F.array(one, two))
    cycle = F.when(F.col("path").rlike(r"/v\d+/.+"), "versioned").otherwise("evergreen")
    cells = F.concat(F.transform(sections, lambda k: F.struct(F.lit("section").alias("dimension"), k.alias("key"))), F.array(F.struct(F.lit("lifecycle").alias("dimension"), cycle.alias("key"))))
    return pages.select("path", "indexed", F.explode(cells).alias("cell")).select("path", "indexed", "cell.*")


def in_cohort(pages: DataFrame, dimension: str, key: str) -> DataFrame:
    """The pages of one cohort."""
    return memberships(pages).where((F.col("dimension") == dimension) & (F.col("key") == key)).select("path", "indexed")


def compared_cells(pages: DataFrame) -> tuple[DataFrame, int]:
    """Each cell that is large enough with its pages and those not indexed, beside the whole; and how many there are."""
    whole = pages.agg(F.count("*").alias("all_total"), F.count_if(~F.col("indexed")).alias("all_not_indexed"))
    cells = memberships(pages).groupBy("dimension", "key").agg(F.count("*").alias("total"), F.count_if(~F.col("indexed")).alias("not_indexed"))
    found = cells.crossJoin(F.broadcast(whole)).where((F.col("total") >= LEAST_PAGES) & (F.col("total") < F.col("all_total")))
    return found, found.count()


def outlier_cohorts(pages: DataFrame) -> DataFrame:
    """Cells of (path, indexed) that are indexed worse than all other pages, the worst first.

    The difference of the shares not indexed is bounded from below by
    Newcombe's hybrid of both score intervals, at a level split over all cells
    compared; it must exceed zero. overlap_not_indexed counts the pages of a
    cell that a worse one has claimed. No pages, or no cell of LEAST_PAGES,
    give no rows. Columns: rank, dimension, key, total, not_indexed, rate,
    other_total, other_rate, low, high (the score interval of rate),
    overlap_not_indexed.
    """
    cells, tested = compared_cells(pages)
    z = critical_value(tested)
    rest, rest_bad = F.col("all_total") - F.col("total"), F.col("all_not_indexed") - F.col("not_indexed")
    (low, high), (_, rest_high) = wilson(F.col("not_indexed"), F.col("total"), z), wilson(rest_bad, rest, z)
    rate, rest_rate = over(F.col("not_indexed").cast("double"), F.col("total")), over(rest_bad.cast("double"), rest)
    gap = rate - rest_rate - F.sqrt((rate - low) * (rate - low) + (rest_high - rest_rate) * (rest_high - rest_rate))
    worse = cells.where((rest >= LEAST_PAGES) & (gap > 0)).select(
        "dimension", "key", "total", "not_indexed", rate.alias("rate"), rest.alias("other_total"), rest_rate.alias("other_rate"), low.alias("low"), high.alias("high")
    )
    place = F.struct(-F.round(F.col("rate") - F.col("other_rate"), 12), -F.col("not_indexed"), "dimension", "key")
    placed = running_sum(worse.withColumn("place", place).withColumn("one", F.lit(1)), "place", "one", "before")
    ranked = placed.withColumn("rank", (F.col("before") + 1).cast("int")).drop("place", "one", "before")
    # Two-level sections of a large site are many, so Spark's check of their size decides about a broadcast.
    bad = memberships(pages).where("NOT indexed").join(ranked.select("dimension", "key", "rank"), ["dimension", "key"])
    claims = bad.withColumn("claimed_by", F.min("rank").over(W.partitionBy("path")))
    twice = claims.where("claimed_by < rank").groupBy("rank").agg(F.count("*").alias("n"))
    return ranked.join(twice, "rank", "left").select(
        "rank", "dimension", "key", "total", "not_indexed", "rate", "other_total", "other_rate", "low", "high", F.coalesce("n", F.lit(0)).alias("overlap_not_indexed")
    )


def regression_leads(cohorts: DataFrame, transitions: DataFrame) -> DataFrame:
    """For each section among ``cohorts`` (dimension, key) the pages that lost PASS, from (url, field, from_value, to_value, changed_after, changed_before).

    Columns key, pages, first_after and last_before: the span in which they
    were lost. Sections without such a page, and cohorts without a path, give no row.
    """
    lost = transitions.where("field = 'indexStatus' AND from_value = 'PASS' AND to_value <> 'PASS' AND changed_before >= changed_after")
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
    # Cohorts are a list of findings; each change looks its sections up.
    below = memberships(lost.select(path.alias("path"), F.lit(False).alias("indexed")).distinct()).where("dimension = 'section'").select("path", "key")
    met = lost.withColumn("path", path).join(below.join(F.broadcast(cohorts.where("dimension = 'section'").select("key").distinct()), "key"), "path")
    return met.groupBy("key").agg(F.countDistinct("url").alias("pages"), F.min("changed_after").alias("first_after"), F.max("changed_before").alias("last_before"))
