"""Quality by importance resampling: hashed n-gram models of target and raw text, drawn by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (gives pa.compute)
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import CUTS, clear_cuts, cut, quoted, unit_hash
from .words import Tokens

#: Buckets of hashed one- and two-token grams; two more count three-token grams new to their text and seen in it before.
BUCKETS = 1 << 15
FEATURES = BUCKETS + 2
#: Most labelled documents that fit the target model (this share of them) and the number to keep (the others).
MOST_LABELLED = 20_000
MODEL_SHARE = 0.7
SMOOTHING = 1.0
#: A text's log weight is that of so many n-grams of its mean log ratio: the temperature of the draw.
#: A sum over all n-grams would grow with length and leave the Gumbel noise, of about one, without effect.
EVIDENCE = 8.0
SEED = 23
#: UTF-8 bytes of the texts that a task takes at once.
SLICE_BYTES = 1 << 20
#: Log ratios and draw keys are kept in fixed point, so that sums and order don't depend on how rows are batched.
FIXED = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashed_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all one- and two-token grams, where each text's begin, and its new and repeated three-token grams.

    Tokens are runs of letters, digits, underscores and bytes beyond ASCII, and
    runs of other signs; A-Z count as a-z. Null texts have none.
    """
    tokens = Tokens(texts)
    code, row, rows = tokens.code, tokens.row, len(texts)
    n = np.bincount(row, minlength=rows)
    offsets = np.r_[0, np.cumsum(2 * n - (n > 0))]
    # A text's grams alternate: token, the pair that starts with it, next token.
    at = offsets[row] + 2 * (np.arange(len(row)) - (np.cumsum(n) - n)[row])
    grams = np.empty(offsets[-1], np.int16)
    grams[at] = mixed(code) % np.uint64(BUCKETS)
    two = mixed(code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:])
    pair = row[1:] == row[:-1]
    grams[at[:-1][pair] + 1] = two[pair] % np.uint64(BUCKETS)
    triple = row[2:] == row[:-2]
    of = row[2:][triple]
    three = mixed(two[:-1] + code[2:] * np.uint64(0xD6E8FEB86659FD93))[triple]
    _, first = np.unique(mixed(three ^ (of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), return_index=True)
    fresh = np.bincount(of[first], minlength=rows)
    return grams, offsets, fresh, np.bincount(of, minlength=rows) - fresh


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about SLICE_BYTES of text, one row at least."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def draw_noise(seed: int) -> Column:
    """Gumbel noise of a row, by its doc_id and text."""
    return -F.log(-F.log(unit_hash("doc_id", "text", seed=seed)))


def draw_key() -> Column:
    return F.round((F.col("log_weight") + F.col("noise")) * F.lit(float(FIXED))).cast("long")


def with_grams(docs: DataFrame, seed: int) -> DataFrame:
    """id, noise, grams (16-bit buckets), fresh and again of each row, hashed once and written out for all that reads them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), draw_noise(seed).alias("noise"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                grams, offsets, fresh, again = hashed_grams(batch.column("text"))
                packed = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(2 * offsets), pa.py_buffer(grams)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("noise"), packed, pa.array(fresh, pa.int64()), pa.array(again, pa.int64())], ["id", "noise", "grams", "fresh", "again"]
                )

    return cut(rows.mapInArrow(run, "id long, noise double, grams binary, fresh long, again long"))


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all rows of a column, and where those of each row begin and the last ones end."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 2
    grams = np.frombuffer(data, np.int16) if data is not None else np.zeros(0, np.int16)
    return grams[at[0] : at[-1]], at - at[0]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(target, feature, n) of rows (grams, fresh, again, target boolean): all count as raw (false), target rows as target too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            grams, at = unpacked(batch.column("grams"))
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            wanted = grams[np.repeat(target, np.diff(at))]
            for k, (g, of) in enumerate(((grams, slice(None)), (wanted, target))):
                counts[k, :BUCKETS] += np.bincount(g, minlength=BUCKETS)
                for j, c in enumerate(("fresh", "again")):
                    counts[k, BUCKETS + j] += batch.column(c).to_numpy()[of].sum()
        for k in (0, 1):
            some = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), bool(k))), pa.array(some), pa.array(counts[k, some])], ["target", "feature", "n"]
            )

    part = rows.select("grams", "fresh", "again", "target").mapInArrow(run, "target boolean, feature long, n long")
    return part.groupBy("target", "feature").agg(F.sum("n").alias("n"))


def labelled_sample(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, good, for_model) of at most ``most`` labelled documents, by seeded hash; of repeated ids the lowest quality holds."""
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.min("quality") == 1).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return sample.withColumn("for_model", unit_hash("doc_id", seed=5) < MODEL_SHARE)


def log_ratio(grams: DataFrame, sample: DataFrame) -> np.ndarray:
    """log p(feature | target) - log p(feature | raw) for each of the FEATURES features."""
    known = F.broadcast(sample.where("good AND for_model").select("doc_id"))  # at most MOST_LABELLED rows
    marked = grams.join(known, F.col("id") == F.col("doc_id"), "left").withColumn("target", F.col("doc_id").isNotNull())
    counts = np.zeros((2, FEATURES))
    for r in gram_counts(marked).collect():  # at most 2 * FEATURES rows
        counts[int(r.target), r.feature] = r.n
    if not counts[1].sum():
        return np.zeros(FEATURES)
    p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def weights(found: np.ndarray, at: np.ndarray, fresh: np.ndarray, again: np.ndarray, ratio: np.ndarray, evidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams and log weight of each text."""
    sums = np.r_[0, np.cumsum(ratio[found])]
    total = sums[at[1:]] - sums[at[:-1]] + fresh * ratio[BUCKETS] + again * ratio[BUCKETS + 1]
    n = np.diff(at) + fresh + again
    return n, evidence * total / FIXED / np.maximum(n, 1)


def weigh(grams: DataFrame, ratio: Broadcast, evidence: float) -> DataFrame:
    """id, n_grams, log_weight and draw_key of each row of ``grams``, written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fresh, again = (batch.column(c).to_numpy() for c in ("fresh", "again"))
            n, weight = weights(*unpacked(batch.column("grams")), fresh, again, ratio.value, evidence)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("noise"), pa.array(n), pa.array(weight)], ["id", "noise", "n_grams", "log_weight"])

    weighed = grams.mapInArrow(run, "id long, noise double, n_grams long, log_weight double")
    return cut(weighed.select("id", "n_grams", "log_weight", draw_key().alias("draw_key")))


def fitted_curve(weight: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of good documents over their log weight, by Newton's steps with a small penalty."""
    x = np.c_[weight, np.ones(len(weight))]
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-4]) * len(weight)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (good - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
    return float(beta[0]), float(beta[1])


def target_count(weighed: DataFrame, sample: DataFrame) -> int:
    """How many documents are target text: the sum, over all of them, of the curve fitted to labelled ones that the model hasn't seen."""
    n = weighed.count()
    seen = weighed.join(F.broadcast(sample.where("NOT for_model")), F.col("id") == F.col("doc_id"))
    # One row for each labelled doc_id, at most MOST_LABELLED.
    pairs = seen.groupBy("id").agg(F.min("log_weight").alias("w"), F.first("good").alias("good")).collect()
    good = np.array([r.good for r in pairs], bool)
    if good.all() or not good.any():
        return n
    slope, start = fitted_curve(np.array([r.w for r in pairs]), good.astype(float))
    chance = 1 / (1 + F.exp(-(F.lit(slope) * F.col("log_weight") + F.lit(start))))
    return round(weighed.agg(F.sum(F.round(chance * F.lit(float(FIXED))).cast("long"))).first()[0] / FIXED)


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column by four counts of 65,536 bins each, so nothing is sorted or gathered."""
    low, known = -(1 << 63), 0
    for shift in (48, 32, 16, 0):
        bins = F.shiftright(F.col(column), shift)
        inside = rows if shift == 48 else rows.where(F.shiftright(F.col(column), shift + 16) == F.lit(low >> (shift + 16)))
        for r in sorted(inside.groupBy(bins.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
            if known + r["count"] >= k:
                low = r["bin"] << shift
                break
            known += r["count"]
    return low


def draw(docs: DataFrame, labels: DataFrame, most_labelled: int, evidence: float, seed: int, share: float | None) -> tuple[DataFrame, Broadcast, int]:
    """Weighed rows, the fixed-point log ratio of each feature, and the smallest draw key that is kept."""
    spark = docs.sparkSession
    sample = cut(labelled_sample(labels, most_labelled))
    since = len(CUTS.paths)
    grams = with_grams(docs, seed)
    ratio = spark.sparkContext.broadcast(np.round(log_ratio(grams, sample) * FIXED).astype(np.int64))
    weighed = weigh(grams, ratio, evidence)
    clear_cuts(spark, CUTS.paths[since:-1])
    k = target_count(weighed, sample) if share is None else round(share * weighed.count())
    return weighed, ratio, kth_largest(weighed, "draw_key", k) if k else (1 << 63) - 1


def resample(
    docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, evidence: float = EVIDENCE, seed: int = SEED, share: float | None = None
) -> DataFrame:
    """doc_id, n_grams, log_weight, draw_key and kept for each row of ``docs`` (doc_id, text).

    Target text is that of documents of quality 1 in a bounded sample of
    ``labels`` (doc_id, quality); raw text is all of ``docs``. A document's log
    importance weight is the mean log ratio of both models over all its
    n-grams, times ``evidence``. k is ``share`` of all documents or, if that is
    None, the expected number of documents of quality 1: a logistic curve over
    the log weight is fitted to the part of the sample that the model hasn't
    seen, and summed over all documents. The k documents with the largest
    weight plus seeded Gumbel noise are kept, which draws them without
    replacement in proportion to their weights. Another ``seed`` draws others.

    A null or empty text has no n-grams and weight 0, and is drawn as such.
    Without labels of both kinds everything is kept. Noise
    goes by doc_id and text: rows that repeat both are kept or left together,
    rows of one doc_id with different texts, and those without one, each by
    their own weight. One row per input row; other columns are ignored; an
    empty table gives none.
    """
    weighed, _, least = draw(docs, labels, most_labelled, evidence, seed, share)
    return weighed.select(F.col("id").alias("doc_id"), "n_grams", "log_weight", "draw_key", (F.col("draw_key") >= F.lit(least)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that resampling keeps, columns as they came. Each row is judged by its own text, whatever its doc_id.

    Texts are hashed and weighed a second time where they are read, which
    takes less than to shuffle them or to hold a second copy of them.
    """
    since, spark = len(CUTS.paths), docs.sparkSession
    _, ratio, least = draw(docs, labels, MOST_LABELLED, EVIDENCE, SEED, None)
    clear_cuts(spark, CUTS.paths[since:])
    rows = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)], draw_noise(SEED).alias("noise"))
    names, text = rows.columns, f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                _, weight = weights(*hashed_grams(batch.column(text)), ratio.value, EVIDENCE)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], [*names, "log_weight"])

    weighed = rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("log_weight", T.DoubleType())]))
    return weighed.where(draw_key() >= F.lit(least)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
