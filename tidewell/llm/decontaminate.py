"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, parts_for, quoted

WORD = re.compile(r"[^\W_]+")
SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Bytes of item texts searched for in one pass over the documents; more items take more passes.
PASS_BYTES = 16 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Index:
    """Sketches and words of one block of items, as arrays: about twice the bytes of their texts, and the vocabulary.

    Items are partitioned by the length of their shingles (below
    SHINGLE_WORDS only for items with fewer words) and the power of two of
    their number of shingles. A partition whose largest item has q shingles
    keeps of each item the floor((1 - t) q) + 1 shingles with the smallest
    MinHash values. A document with at least the share t of an item's shingles
    lacks too few of them to miss all of the sketch, so no match is lost.
    An item's shingles are made from its words when a document meets its sketch.
    """

    def __init__(self, items: list[tuple[int | None, str]], threshold: float) -> None:
        self.threshold = threshold
        self.vocabulary: dict[str, int] = {}
        rng = np.random.default_rng(97)
        self.mult = rng.integers(1, 1 << 62, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        coded = []
        self.names: list[int | None] = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                coded.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))
                self.names.append(item_id)
        #: The words of all items one after the other, and where each item's begin.
        self.words = np.concatenate([np.zeros(0, np.int32), *coded])
        self.begin = np.r_[0, np.cumsum([len(c) for c in coded])].astype(np.int64)
        sizes = [self.shingles(i) for i in range(len(coded))]
        largest: dict[tuple[int, int], int] = {}
        for rows in sizes:
            part = rows.shape[1], len(rows).bit_length()
            largest[part] = max(largest.get(part, 0), len(rows))
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for i, rows in enumerate(sizes):
            q = largest[rows.shape[1], len(rows).bit_length()]
            sketch = np.sort(self.minhash(rows))[: int((1 - threshold) * q + 1e-9) + 1]
            found[rows.shape[1]].append((sketch, np.full(len(sketch), i, np.int32)))
        self.sketches: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, parts in found.items():
            value, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(value, kind="stable")
            self.sketches[k] = value[order], owner[order]

    def shingles(self, item: int) -> np.ndarray:
        """The distinct shingles of an item, a row of word numbers each."""
        ids = self.words[self.begin[item] : self.begin[item + 1]]
        return np.unique(np.lib.stride_tricks.sliding_window_view(ids, min(SHINGLE_WORDS, len(ids))), axis=0)

    def minhash(self, rows: np.ndarray) -> np.ndarray:
        h = (rows.astype(np.uint64) * self.mult[: rows.shape[1]]).sum(axis=1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def search(self, text: str) -> Iterator[tuple[int | None, int, int]]:
        """(item, its shingles, those of them in the text) of every item of which the text holds enough."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        known = ids > 0
        for k, (values, owners) in self.sketches.items():
            if len(ids) < k:
                continue
            run = known[: len(ids) - k + 1].copy()
            for j in range(1, k):
                run &= known[j : len(ids) - k + 1 + j]
            at = np.flatnonzero(run)
            if not len(at):
                continue
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, k)[at])
            h = self.minhash(rows)
            lo, hi = np.searchsorted(values, h, "left"), np.searchsorted(values, h, "right")
            met = np.flatnonzero(hi > lo)
            if not len(met):
                continue
            held = {r.tobytes() for r in rows}
            for item in {int(o) for a, b in set(zip(lo[met].tolist(), hi[met].tolist(), strict=True)) for o in owners[a:b]}:
                mine = self.shingles(item)
                shared = sum(r.tobytes() in held for r in mine)
                if shared >= self.threshold * len(mine) - 1e-9:
                    yield self.names[item], len(mine), shared


def indexes(spark: SparkSession, benchmark: DataFrame, threshold: float, pass_bytes: int) -> Iterator[Broadcast]:
    """Broadcast indexes of the items in blocks of about ``pass_bytes`` of text, dealt by hash; one that is empty if there is no item."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").distinct()
    blocks = parts_for(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0, pass_bytes)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield spark.sparkContext.broadcast(Index(sorted(((r.item_id, r.text) for r in rows), key=str), threshold))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Pairs of a document and an item of which it holds the share ``threshold`` or more of the shingles.

    Returns doc_id, item_id, n_shingles (distinct ones of the item), n_shared
    and containment. Words are runs of letters and digits, lower-cased;
    shingles are five words, and an item with fewer words is one shingle of
    all of them. Items are searched for in blocks of about ``pass_bytes`` (by
    hash, so each block is bounded by its expected size), each broadcast to one
    pass over ``docs``; whole texts are read.

    Null texts and those without a word match nothing. Repeated document rows
    give their pairs each; items that repeat id and text count once; a null id
    comes back as null. Empty tables give no rows; other columns are ignored.
    """
    found = None
    for shared in indexes(docs.sparkSession, benchmark, threshold, pass_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                out = [
                    (doc, *hit)
                    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                    if text.is_valid
                    for hit in index.search(text.as_py())
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["doc_id", "item_id", "n_shingles", "n_shared"]
                )

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_shared long")
        found = part if found is None else found.unionAll(part)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as ``find_leaks`` says, columns as they came.

    Each row is judged where it is read, by its own text and whatever its
    doc_id, so nothing is shuffled. Between two blocks of items the rows that
    are left are written out, so that a task holds one index at a time.
    """
    kept = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index("text")
    for k, shared in enumerate(indexes(docs.sparkSession, benchmark, threshold, pass_bytes)):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                clean = [not text.is_valid or next(index.search(text.as_py()), None) is None for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = (cut(kept) if k else kept).mapInArrow(run, kept.schema)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
