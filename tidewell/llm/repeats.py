"""Removal of repeated passages with prefix-partitioned suffix trees."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (gives pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, parts_for, text_bytes
from .words import Words

WINDOW = 13
ANCHOR = 7
#: UTF-8 bytes of one block of documents; more text makes more blocks.
BLOCK_BYTES = 6 << 20
#: Suffixes up to which a prefix of ANCHOR words is one group; a commoner one is lengthened to WINDOW words.
GROUP_ROWS = 20_000
NO_ID = np.iinfo(np.int64).max


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n values."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def comes_after(doc: np.ndarray, unnamed: np.ndarray, first: np.ndarray, first_unnamed: np.ndarray) -> np.ndarray:
    """Which ids are larger than those of ``first``; null (whose number is NO_ID) is larger than any id, the largest included."""
    return (doc > first) | (unnamed & ~first_unnamed)


class Block:
    """The documents of one block in order of doc_id, as one sequence of words."""

    def __init__(self, ids: pa.Array, texts: pa.Array, rows: np.ndarray, copy: np.ndarray) -> None:
        """rows: a hash of each row, which orders rows of one doc_id; copy: which rows have the whole text of an earlier document, so that their windows stay out of all classes."""
        named, unnamed = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((rows, unnamed, named))
        self.doc_ids, self.unnamed, self.copy = named[order], unnamed[order], copy[order]
        self.words = words = Words(texts.take(pa.array(order)))
        self.sizes = np.bincount(words.row, minlength=len(order)).astype(np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        h, self.doc = words.code, words.row
        n = len(h) - WINDOW + 1
        starts = np.flatnonzero((self.doc[:n] == self.doc[WINDOW - 1 :]) & ~self.copy[self.doc[:n]]) if n > 0 else np.zeros(0, np.int64)
        self.starts = starts
        if not len(starts):
            self.representative = self.member = self.anchor = starts
            self.anchor_hash = np.zeros(0, np.uint64)
            return
        # Classes of equal windows, numbered as they first appear, so by their smallest document.
        self.member = pa.array(rolled(h, WINDOW)[starts]).dictionary_encode().indices.to_numpy().astype(np.int64)
        first = np.zeros(self.member.max() + 1, np.int64)
        first[self.member[::-1]] = np.arange(len(starts))[::-1]
        self.representative = starts[first]
        grams = rolled(h, ANCHOR)
        best, at = grams[self.representative], self.representative.copy()
        for j in range(1, WINDOW - ANCHOR + 1):
            g = grams[self.representative + j]
            lower = g < best
            best[lower], at[lower] = g[lower], self.representative[lower] + j
        #: Of each class of equal windows: where the smallest of its 7-grams starts, and that 7-gram's hash.
        self.anchor, self.anchor_hash = at, best

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and number of anchor places of each distinct anchor."""
        if not len(self.anchor):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, one = np.unique(self.anchor, return_index=True)
        h, n = np.unique(self.anchor_hash[one], return_counts=True)
        return h.view(np.int64), n.astype(np.int64)

    def suffixes(self, live: np.ndarray, common: np.ndarray) -> dict[str, list]:
        """The sampled suffixes that start with a live anchor, with what stands left of them; by whole windows for common ones."""
        out: dict[str, list] = {k: [] for k in ("prefix", "left", "right", "offsets", "doc", "pos")}
        if not len(self.anchor):
            return out
        h = self.anchor_hash.view(np.int64)
        often = np.isin(h, common)
        whole = self.representative[often]
        rest = np.flatnonzero(np.isin(h, live) & ~often)
        rest = rest[np.argsort(self.anchor[rest], kind="stable")]
        at = self.anchor[rest]
        off = at - self.representative[rest]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(rest) else rest
        masks, most, least = (f.reduceat(v, first) if len(rest) else rest for f, v in ((np.bitwise_or, 1 << off), (np.maximum, off), (np.minimum, off)))
        joined, m = self.words.joined, at[first]
        windows = [joined(s, s + WINDOW) for s in whole.tolist()]
        out["prefix"] = windows + [joined(i, i + ANCHOR) for i in m.tolist()]
        out["left"] = [b""] * len(windows) + [joined(i - k, i) for i, k in zip(m.tolist(), most.tolist(), strict=True)]
        out["right"] = windows + [joined(i, i + WINDOW - k) for i, k in zip(m.tolist(), least.tolist(), strict=True)]
        out["offsets"] = [1] * len(windows) + masks.tolist()
        out["pos"] = np.concatenate([whole, m])
        of = self.doc[out["pos"]]
        out["doc"] = pa.array(self.doc_ids[of], mask=self.unnamed[of])
        return out

    def removed(self, later: np.ndarray) -> np.ndarray:
        """Which words go: those of windows that an earlier document of the block has, or whose class is in ``later``."""
        gone = np.zeros(len(self.doc) + 1, np.int64)
        if len(self.starts):
            first, mine = self.doc[self.representative][self.member], self.doc[self.starts]
            hit = comes_after(self.doc_ids[mine], self.unnamed[mine], self.doc_ids[first], self.unnamed[first])
            hit |= np.isin(self.representative, later)[self.member]
            s = self.starts[hit]
            np.add.at(gone, s, 1)
            np.add.at(gone, s + WINDOW, -1)
        out = np.cumsum(gone)[:-1] > 0
        out[np.repeat(self.copy & (self.sizes >= WINDOW), self.sizes)] = True
        return out


def repeated_windows(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(block, place) of windows that also start in a document with a smaller doc_id, for whole prefix groups.

    Sorting the suffixes by their words and taking the common length of
    neighbours gives the suffix tree: a node of depth d is a run of suffixes in
    which neighbours share d words or more. A window that starts l words left
    of its anchor is repeated where suffixes meet in a node of depth 13 - l and
    agree in the l words before it.
    """
    def coded(column: str, width: int, from_end: bool) -> np.ndarray:
        words = Words(rows.column(column).combine_chunks())
        n = np.bincount(words.row, minlength=len(rows))
        place = np.arange(len(words.row)) - (np.cumsum(n) - n)[words.row]
        out = np.zeros((len(rows), width), np.uint64)
        out[words.row, n[words.row] - 1 - place if from_end else place] = words.code
        return out

    right, left = coded("right", WINDOW, False), coded("left", WINDOW - ANCHOR, True)
    offsets, ids = rows.column("offsets").to_numpy(), rows.column("doc").combine_chunks()
    doc, unnamed = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    block, pos = rows.column("block").to_numpy(), rows.column("pos").to_numpy()
    group = rows.column("prefix").combine_chunks().dictionary_encode()
    group = (group.chunk(0) if isinstance(group, pa.ChunkedArray) else group).indices.to_numpy().astype(np.int64)
    order = np.lexsort([*right.T[::-1], group])
    right, left, offsets, doc, unnamed, block, pos, group = (x[order] for x in (right, left, offsets, doc, unnamed, block, pos, group))
    common = np.r_[0, np.cumprod((right[1:] == right[:-1]) & (right[1:] > 0), axis=1).sum(axis=1)]
    common[1:][group[1:] != group[:-1]] = 0
    out_block, out_pos = [], []
    for back in range(WINDOW - ANCHOR + 1):
        depth = WINDOW - back
        rows_here = np.flatnonzero(offsets >> back & 1)
        if len(rows_here) < 2:
            continue
        node = np.cumsum(common < depth)[rows_here]
        for j in range(back):
            pair = np.lexsort((left[rows_here, j], node))
            a, b = node[pair], left[rows_here, j][pair]
            fresh = np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            node = np.empty_like(node)
            node[pair] = np.cumsum(fresh)
        node -= node.min()
        least, none_named = np.full(node.max() + 1, NO_ID), np.ones(node.max() + 1, bool)
        np.minimum.at(least, node, doc[rows_here])
        np.logical_and.at(none_named, node, unnamed[rows_here])
        later = rows_here[comes_after(doc[rows_here], unnamed[rows_here], least[node], none_named[node])]
        out_block.append(block[later])
        out_pos.append(pos[later] - back)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_block]), np.concatenate([none, *out_pos])


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of about ``rows`` rows from batches sorted by ``column``, none of which parts equal values.

    But a value with more than ``most`` rows comes in several tables of its
    own, so that a task never holds all of them; True marks those after the first.
    """
    held: list[pa.RecordBatch] = []
    n, begun = 0, None
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += len(batch)
            if n < rows:
                continue
        if not n:
            continue
        table = pa.Table.from_batches(held)
        if begun is not None:
            values = table.column(column)
            goes_on = bisect_left(range(n), True, key=lambda i: values[i] != begun)
            if goes_on:
                yield table.slice(0, goes_on), True
            table = table.slice(goes_on)
            begun = None if len(table) else begun
        values, n = table.column(column), len(table)
        to = n if batch is None else bisect_left(range(n), True, key=lambda i: values[i] == values[n - 1])
        if not to and n > most:
            to, begun = n, values[0]
        if to:
            yield table.slice(0, to), False
        held = table.slice(to).combine_chunks().to_batches()
        n -= to


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Remove words that earlier documents have: doc_id, text (kept words joined by one space), n_words, n_removed.

    A window is 13 consecutive words of one document. Each word is removed that
    is covered by a window whose word sequence also starts in a document with a
    smaller doc_id, as the texts stand in the input.

    1. Documents are dealt into blocks of bounded size by hash. A text that an
       earlier document has whole loses all words (if it has a window) and
       takes no further part. Equal windows of one block are one class; only
       its first, in the smallest document, goes on.
    2. The smallest of the seven 7-grams of a window is its anchor, the same in
       each copy. Anchors found in a single block repeat nowhere else; the
       rest are live (exact counts over all blocks).
    3. Suffixes that start with live anchors are partitioned by that prefix.
       Prefixes with more than ``group_rows`` suffixes are lengthened to the
       whole window, of which each block sends at most one.
    4. Each group's suffix tree gives the windows that repeat, and their
       places go back to their blocks.

    Null and empty texts have no words: text ''. A null doc_id counts as
    larger than any other, and rows that share a doc_id (or its lack) never
    remove each other's words. One row per input row; other columns are
    ignored; an empty table gives no rows.
    """
    spark, at_once = docs.sparkSession, min(20_000, group_rows)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = text_bytes(docs)
    blocks = max(least, parts_for(size, block_bytes))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    block_at = F.pmod(F.col("row"), F.lit(blocks)).cast("int")
    dealt = keyed.withColumn("block", block_at).repartition(blocks, "block")
    # Rows whose text an earlier document has: only ids and digests are shuffled.
    digests = keyed.where("text IS NOT NULL").select("doc_id", "row", F.sha2("text", 256).alias("digest"))
    # Written out, so that the join can be split where very many documents share a text.
    first = cut(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    later_copy = (F.col("doc_id") > F.col("first")) | (F.col("doc_id").isNull() & F.col("first").isNotNull())
    copies = cut(digests.join(first, "digest").where(later_copy).select(F.col("row").alias("h"), block_at.alias("block")))

    def block_of(table: pa.Table, marks: pa.Table) -> Block:
        """marks: h holds the rows of the block that are copies, where ``often`` is null."""
        table = table.combine_chunks()
        column = lambda c: pa.concat_arrays(table.column(c).chunks) if table.column(c).num_chunks else pa.array([], table.schema.field(c).type)
        copy = np.isin(table.column("row").to_numpy(), marks.filter(pa.compute.is_null(marks.column("often"))).column("h").to_numpy())
        return Block(column("doc_id"), column("text"), table.column("row").to_numpy(), copy)

    def marked(marks: DataFrame):
        return marks.repartition(blocks, "block").groupBy("block")

    copy_marks = copies.select("h", "block", F.lit(None).cast("boolean").alias("often"))

    def list_anchors(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"h": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        h, n = block_of(table, marks).anchors()
        return pa.table({"h": h, "block": np.full(len(h), table.column("block")[0].as_py(), np.int32), "n": n})

    anchors = dealt.groupBy("block").cogroup(marked(copy_marks)).applyInArrow(list_anchors, "h long, block int, n long")

    def keep_live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, more in whole_groups(batches, "h", at_once, group_rows):
            h, n = table.column("h").to_numpy(), table.column("n").to_numpy()
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            many = np.diff(np.r_[first, len(h)])
            # An anchor in more than ``group_rows`` blocks comes in several tables; each row of it counts one place or more.
            live = np.repeat(many > 1, many) | more
            often = np.repeat(np.add.reduceat(n, first) > group_rows, many) | more
            yield from pa.table({"h": h[live], "block": table.column("block").to_numpy()[live], "often": often[live]}).to_batches()

    anchor_parts = max(least, parts_for(size, 4 * block_bytes))
    live = (
        anchors.repartition(anchor_parts, "h").sortWithinPartitions("h").mapInArrow(keep_live, "h long, block int, often boolean")
    )

    def list_suffixes(table: pa.Table, marks: pa.Table) -> pa.Table:
        names = ["prefix", "left", "right", "offsets", "doc", "pos", "block"]
        kinds = [pa.binary()] * 3 + [pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        if not len(table) or not len(marks):
            return pa.table([pa.array([], k) for k in kinds], names)
        live_marks = marks.filter(pa.compute.is_valid(marks.column("often")))
        h, often = live_marks.column("h").to_numpy(), live_marks.column("often").to_numpy().astype(bool)
        out = block_of(table, marks).suffixes(h, h[often])
        out["block"] = [table.column("block")[0].as_py()] * len(out["pos"])
        return pa.table([out[k] if isinstance(out[k], pa.Array) else pa.array(out[k], t) for k, t in zip(names, kinds, strict=True)], names)

    suffixes = (
        dealt.groupBy("block")
        .cogroup(marked(live.unionByName(copy_marks)))
        .applyInArrow(list_suffixes, "prefix binary, left binary, right binary, offsets int, doc long, pos long, block int")
    )

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: tuple[np.ndarray, np.ndarray] | None = None
        for table, more in whole_groups(batches, "prefix", at_once, group_rows):
            ids = table.column("doc").combine_chunks()
            doc, unnamed = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            if more:  # only whole windows are as common as that, sorted by document
                later = comes_after(doc, unnamed, *least)
                block, pos = table.column("block").to_numpy()[later], table.column("pos").to_numpy()[later]
            else:
                least = doc[:1], unnamed[:1]
                block, pos = repeated_windows(table)
            yield from pa.table({"h": pos, "block": block.astype(np.int32), "often": np.zeros(len(pos), bool)}).to_batches()

    later = (
        suffixes.repartition(anchor_parts, "prefix").sortWithinPartitions("prefix", F.asc_nulls_last("doc")).mapInArrow(repeats, "h long, block int, often boolean")
    )

    def clean(table: pa.Table, marks: pa.Table) -> pa.Table:
        block = block_of(table, marks)
        gone = block.removed(marks.filter(pa.compute.is_valid(marks.column("often"))).column("h").to_numpy())
        texts, n_removed = [], []
        for b, n in zip(block.begin.tolist(), block.sizes.tolist(), strict=True):
            out = gone[b : b + n]
            n_removed.append(int(out.sum()))
            words = block.words.joined(b, b + n)
            if n_removed[-1]:
                each = words.split(b" ")
                words = b" ".join([each[i] for i in np.flatnonzero(~out).tolist()])
            texts.append(words)
        return pa.table(
            [pa.array(block.doc_ids, mask=block.unnamed), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(block.sizes), pa.array(n_removed, pa.int64())],
            ["doc_id", "text", "n_words", "n_removed"],
        )

    return (
        dealt.groupBy("block")
        .cogroup(marked(later.unionByName(copy_marks)))
        .applyInArrow(clean, "doc_id long, text string, n_words long, n_removed long")
    )
