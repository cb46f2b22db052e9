"""SimHash near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, with_least
from .shared import cut, parts_for, quoted, small_enough

SHINGLE_WORDS = 4
RADIUS = 4
HASH_SEED = 42
#: Fingerprints that one comparison cell takes from one side; larger buckets are dealt over several cells.
CELL_SIDE = 2048
#: Mean bucket size up to which a coarser set of band keys is taken.
BUCKET_MEAN = 128
#: The pipeline's stage: words of a shingle, least similarity of a link, keys by which texts meet, and the radius within which they are looked at.
STAGE_WORDS, SIMILARITY, KEYS, STAGE_RADIUS = 5, 0.8, 12, 18
#: Shingles that one cell takes from one side where whole sets are compared: 8 MB.
CELL_SHINGLES = 1_000_000
#: Edges of one text that are looked at in one task.
HUB_EDGES = 512
#: Bins of a sketch by which pairs are sorted out before their texts are fetched.
BINS = 128
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_digests(text: bytes, n_words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> tuple[bytes, bytes]:
    """The lower-cased words of one UTF-8 text, and the hashes of its shingles, repeats included, eight bytes each."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    n = len(words) - n_words + 1
    joined = b" ".join(words)
    if n <= 1:
        return joined, xxh64_digest(joined, seed) if words else b""
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[:n].tolist()
    return joined, b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(start, end[n_words - 1 :].tolist(), strict=True)])


def folded(digests: bytes) -> bytes:
    """The fingerprint, most significant bit first, of shingle hashes."""
    raw = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    if len(raw) == 1:
        return digests
    bits = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 16):
        bits += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(raw)).tobytes()


def fingerprint(text: bytes, n_words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> bytes:
    """Eight bytes, most significant bit first, of one UTF-8 text."""
    return folded(shingle_digests(text, n_words, seed)[1])


def fingerprints(rows: DataFrame) -> DataFrame:
    """``rows`` with fp, the fingerprint of every whole text as a signed 64-bit number, in place of text; null text counts as empty."""
    fields = [f for f in rows.schema if f.name != "text"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            out = b"".join(
                fingerprint(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in texts.cast(pa.large_binary())
            )
            fp = np.frombuffer(out, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(fp)], [*names, "fp"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("fp", T.LongType())]))


def band_masks(n: int, radius: int = RADIUS, mean: int = BUCKET_MEAN) -> list[int]:
    """Bit masks such that fingerprints within ``radius`` agree fully under one of them.

    64 bits are cut into radius + t blocks; at most ``radius`` of them can
    differ, so some t blocks agree. t grows with the number of fingerprints to
    hold the mean bucket near ``mean``; any t finds every link.
    """
    for t in range(1, 5):
        blocks = radius + t
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        block = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(blocks)]
        masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), t)]
        if n / 2 ** min(m.bit_count() for m in masks) <= mean or t == 4:
            return masks
    raise AssertionError


def close_pairs(cell: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one cell whose fingerprints differ in at most ``radius`` bits.

    ``cell`` is sorted. Each run of up to 64 rows of a cell is a block; plane b
    holds bit b of its rows, one row a lane. A row is compared with all lanes
    of a block at once: the mismatching lanes of each plane are added to
    bitwise counters with carry-save steps. The counters start so that the last
    carry comes out at radius + 1 mismatches; a (row, block) whose lanes have
    all carried is abandoned.
    """
    n = len(fps)
    fps = fps.view(np.uint64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, n])
    rank = np.arange(n) - np.repeat(first, size)
    lane = (rank % 64).astype(np.uint64)
    word_first = np.flatnonzero(rank % 64 == 0)
    word_of = np.cumsum(rank % 64 == 0) - 1
    valid = np.bitwise_or.reduceat(np.uint64(1) << lane, word_first)
    planes = [
        np.bitwise_or.reduceat(((fps >> np.uint64(b)) & np.uint64(1)) << lane, word_first) for b in range(64)
    ]
    last_word = np.repeat(word_of[np.r_[first[1:] - 1, n - 1]], size)
    many = last_word - word_of + 1  # blocks from the row's own to the last of its cell
    width = radius.bit_length()
    bounds = np.cumsum(many)
    at = 0
    while at < n:
        done = bounds[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(bounds, done + 400_000, "right")))
        q = np.repeat(np.arange(at, to), many[at:to])
        begin = np.repeat(bounds[at:to] - many[at:to] - done, many[at:to])
        w = word_of[q] + np.arange(len(q)) - begin
        at = to
        over = ~valid[w]
        start = (1 << width) - 1 - radius
        count = [np.full(len(q), ALL if start >> k & 1 else 0, np.uint64) for k in range(width)]
        row = fps[q]
        for b in range(64):
            carry = planes[b][w] ^ (np.uint64(0) - ((row >> np.uint64(b)) & np.uint64(1)))
            for k in range(width):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if b % 4 == 3 and b > 10:
                keep = over != ALL
                if keep.mean() < 0.75:
                    q, w, row, over = q[keep], w[keep], row[keep], over[keep]
                    count = [c[keep] for c in count]
                    if not len(q):
                        break
        for some in range(0, len(q), 16_384):
            hit = ~over[some : some + 16_384]
            bits = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(bits)
            a, z = q[some + r], word_first[w[some + r]] + c
            yes = a < z
            if yes.any():
                yield a[yes], z[yes]


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index each of n items reaches through ``pairs``."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            low = np.minimum(la, lb)
            np.minimum.at(label, np.maximum(la, lb), low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span all groups within ``radius`` bits.

    ``fps`` has one row per fingerprint (fp). Every linked pair meets in a
    bucket of some band; a bucket gives a spanning forest of its links, never
    all of them.
    """
    n = fps.count()
    masks = band_masks(n, radius)
    keyed = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias(
            "band", "bits"
        ),
    )
    spark = fps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(n * len(masks), 2_000_000))

    def forest(ids: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        label = joined(len(ids), pairs)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        yield ids[label[moved]], ids[moved]

    return compared(keyed.withColumn("id", F.col("fp")), radius, parts, forest)


def in_cells(keyed: DataFrame, bucket: tuple[str, ...], sides: Column) -> DataFrame:
    """``keyed`` with cell, in which its ids meet all others of their ``bucket``: one, or one for each two parts of a bucket whose ``sides``, an aggregate, is over one."""
    # Few buckets are so large; the others need no join.
    large = cut(keyed.groupBy(*bucket).agg(F.ceil(sides).cast("int").alias("sides")).where("sides > 1"))
    dealt = keyed.join(large, list(bucket), "left").withColumn("g", F.coalesce("sides", F.lit(1)))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("g")).cast("int")
    met = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return met.withColumn("cell", F.xxhash64(*bucket, F.least("own", "other"), F.greatest("own", "other")))


def compared(keyed: DataFrame, radius: int, parts: int, edges, *more: str) -> DataFrame:
    """Edges (a, b) between the ids of ``keyed`` (id, fp, band, bits) that meet in a bucket with fingerprints within ``radius``.

    ``edges`` makes them, piece by piece, from the ids of some cells, the pairs
    of their places that are close, and the columns ``more``. A bucket of more
    than CELL_SIDE fingerprints is dealt over pairs of cells.
    """
    cells = in_cells(keyed, ("band", "bits"), F.count("*") / CELL_SIDE).select("cell", "id", "fp", *more)
    placed = cells.repartition(parts, "cell").sortWithinPartitions("cell", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def compare(cell: np.ndarray, ids: np.ndarray, fp: np.ndarray, *others: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(fp) < 2:
                return
            for a, b in edges(ids, close_pairs(cell, fp, radius), *others):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(tuple(sketch_rows(batch.column(c)) if c == "sketch" else batch.column(c).to_numpy() for c in ("cell", "id", "fp", *more)))
            rows += len(held[-1][0])
            if rows >= 50_000:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                to = int(np.searchsorted(whole[0], whole[0][-1], "left"))  # the last cell may go on
                if to:
                    yield from compare(*(x[:to] for x in whole))
                held, rows = [tuple(x[to:] for x in whole)], len(whole[0]) - to
        if rows:
            yield from compare(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return placed.mapInArrow(run, "a long, b long")


def group_roots(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of the distinct fingerprints ``fps`` (fp) that link with another one."""
    return components(links(fps, radius)).select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    One row per input row. Fingerprints link at ``radius`` or fewer differing
    bits; component_id is the smallest doc_id reachable through links, itself
    included. A null or empty text, or one of white space alone, has fingerprint
    zero and links like any other. Rows with a null doc_id take part, but their
    null is no candidate for component_id (null if no other is reachable).
    Repeated rows come back as often as they came; an empty table gives none;
    other columns are ignored.
    """
    marked = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    least = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(group_roots(least.select("fp"), radius))
    low = with_least(roots.join(least, "fp"), "root", "least", "component_id").select("fp", "component_id")
    # Written out with one row per fingerprint, so that the join can be split where very many documents share one.
    labels = cut(least.join(low, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return marked.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def sketched(h: np.ndarray) -> bytes:
    """A byte for each of BINS bins of shingle hashes: of its smallest hash, or 0 if it is empty."""
    low = np.full(BINS, ALL, np.uint64)
    np.minimum.at(low, (h % np.uint64(BINS)).astype(np.int64), h // np.uint64(BINS))
    byte = (low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    return np.where(low == ALL, 0, byte).astype(np.uint8).tobytes()


def sketch_rows(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, BINS)


def by_sketches(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The similarity of each two sketches, and whether it is within four standard errors of ``least``, or more."""
    full = ((a > 0) | (b > 0)).sum(axis=1)
    share = ((a == b) & (a > 0)).sum(axis=1) / np.maximum(full, 1)
    return share, share >= least - 4 * np.sqrt(least * (1 - least) / np.maximum(full, 1))


def likely(edges: DataFrame, least: float) -> DataFrame:
    """(a, b, share) of those ``edges`` (a, b, sketch_a, sketch_b) whose similarity by their sketches, share, is within four standard errors of ``least``, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, yes = by_sketches(sketch_rows(batch.column("sketch_a")), sketch_rows(batch.column("sketch_b")), least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], ["a", "b", "share"]).filter(pa.array(yes))

    return edges.mapInArrow(run, "a long, b long, share double")


def text_sketches(rows: DataFrame) -> DataFrame:
    """``rows`` with t1 and t2 (128 bits of the words of a text), fp (of shingles of STAGE_WORDS words), keys and sketch in place of text.

    A key is three MinHash values of the shingles; texts of similarity s share
    a given key with chance s ** 3, and one of KEYS keys in all but
    (1 - s ** 3) ** KEYS of the cases: 3 in 10,000 at 0.8. A text without a
    word has fingerprint zero and no keys.
    """
    fields = [f for f in rows.schema if f.name != "text"]
    names = [f.name for f in fields]
    more = [T.StructField(c, T.LongType()) for c in ("t1", "t2", "fp")] + [T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        mult = np.random.default_rng(31).integers(1, 1 << 63, 3 * KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            t1, t2, fps, keys, sketches = [], [], [], [], []
            for v in batch.column("text").cast(pa.large_binary()):
                words, digests = shingle_digests(v.as_buffer().to_pybytes() if v.is_valid else b"", STAGE_WORDS)
                t1.append(xxh64_intdigest(words, 1))
                t2.append(xxh64_intdigest(words, 2))
                fps.append(folded(digests))
                h = np.frombuffer(digests, ">u8").astype(np.uint64)
                sketches.append(sketched(h))
                if not len(h):
                    keys.append([])
                    continue
                low = np.full(3 * KEYS, ALL, np.uint64)
                for at in range(0, len(h), 1 << 15):
                    np.minimum(low, (h[None, at : at + (1 << 15)] * mult[:, None]).min(axis=1), out=low)
                low = low.reshape(KEYS, 3)
                key = (low[:, 0] * mult[0] ^ low[:, 1]) * mult[1] ^ low[:, 2]
                keys.append(key.view(np.int64).tolist())
            number = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            fp = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], number(t1), number(t2), pa.array(fp), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                [*names, "t1", "t2", "fp", "keys", "sketch"],
            )

    return rows.mapInArrow(run, T.StructType([*fields, *more]))


def named(texts: DataFrame) -> DataFrame:
    """``texts`` (t1, t2, one row per pair) with id, a long of their own: t1, or, where several have that t1, a hash of both for all but one of them."""
    twice = cut(texts.groupBy("t1").agg(F.count("*").alias("n"), F.min("t2").alias("first")).where("n > 1").select("t1", "first"))
    if twice.isEmpty():
        return texts.withColumn("id", F.col("t1"))
    marked = texts.join(small_enough(twice), "t1", "left")
    other = F.col("first").isNotNull() & (F.col("first") != F.col("t2"))
    return marked.withColumn("id", F.when(other, F.xxhash64("t1", "t2")).otherwise(F.col("t1"))).drop("first")


def some_before(ids: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place the first and the last one before it that are close to it: with these most links are found, and ``rest_of`` looks at the others."""
    first, last = np.full(len(ids), len(ids)), np.full(len(ids), -1)
    for a, z in pairs:
        np.minimum.at(first, z, a)
        np.maximum.at(last, z, a)
    some = np.flatnonzero(last >= 0)
    more = some[first[some] != last[some]]
    yield np.r_[ids[first[some]], ids[last[more]]], np.r_[ids[some], ids[more]]


def unsettled(keyed: DataFrame, roots: DataFrame, sketches: DataFrame, least: float, radius: int, parts: int) -> DataFrame:
    """(id, bucket) of the texts of ``keyed`` that meet one in that bucket within ``radius`` bits which ``roots`` (node, root) doesn't join with them and which may be alike by its sketch.

    In a bucket of up to three texts ``some_before`` has given all pairs, and
    one whose texts are all joined has nothing to add; the others are compared
    again. Each text comes out once for a bucket, with however many it meets there.
    """

    def marked(ids: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], root: np.ndarray, sketch: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found = np.zeros(len(ids), bool)
        for a, z in pairs:
            for at in range(0, len(a), 8192):
                x, y = a[at : at + 8192], z[at : at + 8192]
                new = (root[x] != root[y]) & ~(found[x] & found[y])
                x, y = x[new], y[new]
                yes = by_sketches(sketch[x], sketch[y], least)[1]
                found[x[yes]] = found[y[yes]] = True
        yield ids[found], bucket[found]

    placed = keyed.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sums = placed.groupBy("band", "bits").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    open_ones = cut(sums.where("n > 3 AND low <> high").select("band", "bits"))
    # Two buckets that share a hash are one, in which more texts meet.
    again = placed.join(small_enough(open_ones), ["band", "bits"], "left_semi").join(sketches, "id").withColumn("bucket", F.xxhash64("band", "bits"))
    return compared(again, radius, parts, marked, "root", "sketch", "bucket").select(F.col("a").alias("id"), F.col("b").alias("bucket")).distinct()


def shingle_sets(bodies: DataFrame) -> DataFrame:
    """(id, size, shingles) of ``bodies`` (id, text): the ascending hashes of the different shingles of each, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            sets = [np.unique(np.frombuffer(shingle_digests(v.as_buffer().to_pybytes() if v.is_valid else b"", STAGE_WORDS)[1], ">u8").astype("<u8")) for v in texts]
            size = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "size", "shingles"])

    return bodies.mapInArrow(run, "id long, size long, shingles binary")


def forest_of_sets(ids: np.ndarray, fps: np.ndarray, roots: np.ndarray, sets: list[bytes], least: float, radius: int) -> Iterator[tuple[int, int]]:
    """Edges between the ``ids`` of one cell that join all ``roots`` whose texts are linked: within ``radius`` bits, and alike by their ``sets`` of shingles.

    The shingles of the cell are numbered; those of one text are marked, and
    counted in all texts that may be linked with it at once. There are fewer edges than ids.
    """
    size = np.array([len(x) // 8 for x in sets])
    end = np.cumsum(size)
    code = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)[1]
    held = np.zeros(len(code) + 1, bool)
    label = np.unique(roots, return_inverse=True)[1]
    for a, z in close_pairs(np.zeros(len(ids), np.int64), fps, radius):
        may = (label[a] != label[z]) & (np.minimum(size[a], size[z]) >= least * np.maximum(size[a], size[z]) - 1e-9)
        order = np.argsort(a[may], kind="stable")
        a, z = a[may][order], z[may][order]
        for hub, others in zip(*(np.split(x, np.flatnonzero(np.diff(a)) + 1) for x in (a, z)), strict=True) if len(a) else ():
            hub, others = hub[0], others[label[others] != label[hub[0]]]
            if not len(others):
                continue
            mine = code[end[hub] - size[hub] : end[hub]]
            held[mine] = True
            many = size[others]
            done = np.cumsum(many)
            at = np.arange(done[-1]) + np.repeat(end[others] - done, many)
            counted = np.r_[0, np.cumsum(held[code[at]])]
            held[mine] = False
            shared = counted[done] - counted[done - many]
            right = others[shared >= least * (size[hub] + many - shared) - 1e-9]
            new, first = np.unique(label[right], return_index=True)
            for other in right[first]:
                yield ids[hub], ids[other]
            label[np.isin(label, new)] = label[hub]


def settled(met: DataFrame, roots: DataFrame, fps: DataFrame, sets: DataFrame, least: float, radius: int) -> DataFrame:
    """Edges (a, b), written out, that join all ``roots`` (node, root) of which texts that ``met`` (id, bucket) in a bucket are linked, by their ``fps`` (id, fp) and whole ``sets`` (id, size, shingles).

    The sets meet in cells of up to two times CELL_SIDE texts and
    CELL_SHINGLES shingles. A task holds one cell and gives its spanning forest,
    so what comes out grows with the texts, not with their pairs.
    """
    spark = met.sparkSession
    sized = met.join(sets.select("id", "size"), "id")
    sides = F.greatest(F.count("*") / CELL_SIDE, F.sum("size") / CELL_SHINGLES)
    cells = cut(in_cells(sized, ("bucket",), sides).select("cell", "id", "size"))
    n, all_shingles = cells.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(n, 10_000), parts_for(all_shingles, 8_000_000))
    texts = sets.select("id", "shingles").join(fps, "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = cells.select("cell", "id").join(texts, "id").repartition(parts, "cell").sortWithinPartitions("cell", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, fp, root = (np.concatenate([x.column(c).to_numpy() for x in rows]) for c in ("id", "fp", "root"))
            found = list(forest_of_sets(ids, fp, root, [v for x in rows for v in x.column("shingles").to_pylist()], least, radius))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            first = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for at, to in zip(first, first[1:], strict=False):
                if held and held[0].column("cell")[0].as_py() != cell[at]:
                    yield from forest(held)
                    held = []
                if to > at:
                    held.append(batch.slice(at, to - at))
        if held:
            yield from forest(held)

    return cut(placed.mapInArrow(run, "a long, b long"))


def alike(edges: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """(a, b) of those ``edges`` (a, b) whose texts in ``bodies`` (id, text) have sets of shingles with a Jaccard similarity of ``least`` or more, written out.

    A text is sent once for each edge in which it is b, and as a once to each
    HUB_EDGES of its edges, which are compared in one task; the task holds the
    shingles of one a at a time.
    """
    spark = edges.sparkSession
    degree = edges.groupBy("a").agg(F.ceil(F.count("*") / HUB_EDGES).alias("splits"))
    dealt = edges.select("a", "b").join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("splits")).alias("split"), "b")
    hubs = dealt.select(F.col("a").alias("id"), "a", "split", F.lit(None).cast("long").alias("b")).distinct()
    sides = cut(dealt.select(F.col("b").alias("id"), "a", "split", "b").unionAll(hubs))
    sent = bodies.join(small_enough(sides), "id").select("a", "split", "b", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(sides.count(), 10_000))
    placed = sent.repartition(parts, "a", "split").sortWithinPartitions("a", "split", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingles(text: pa.Scalar) -> np.ndarray:
            return np.unique(np.frombuffer(shingle_digests(text.as_buffer().to_pybytes(), STAGE_WORDS)[1], ">u8").astype(np.uint64))

        hub = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, texts = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text").cast(pa.large_binary())
            found: list[tuple[int, int]] = []
            for i, other in enumerate(b):
                mine = shingles(texts[i])
                if other is None:
                    hub = mine
                    continue
                shared = len(np.intersect1d(hub, mine, assume_unique=True))
                if shared >= least * (len(hub) + len(mine) - shared) - 1e-9:
                    found.append((a[i], other))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return cut(placed.mapInArrow(run, "a long, b long"))


def linked(near: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """(node, root): the components of those edges ``near`` (a, b, share) that ``alike`` finds right.

    First each text is held against the one that its sketch is likest to; then
    only edges whose ends aren't linked by that are looked at. What is left out
    could not change a component.
    """
    best = near.groupBy("b").agg(F.max(F.struct("share", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    best = cut(best)
    first = alike(best, bodies, least)
    roots = components(first)
    end = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    more = near.select("a", "b").join(best, ["a", "b"], "left_anti").join(end("a"), "a", "left").join(end("b"), "b", "left")
    left = cut(more.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    if left.isEmpty():
        return roots
    return components(first.unionAll(alike(left, bodies, least)))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, radius: int = STAGE_RADIUS) -> DataFrame:
    """Keep one row of each group: that with the smallest doc_id (null last), then text hash; columns as they came.

    Texts link if the sets of their shingles of STAGE_WORDS words (lower-cased
    A-Z, parted by white space) have a Jaccard similarity of ``similarity`` or
    more. Texts of equal words are one text. Others meet in buckets by MinHash
    keys, in which fingerprints are compared by bit planes; those within
    ``radius`` bits are held against each other: by a sketch, which all but
    sorts out those far from alike, and then by their whole sets of shingles.
    Each text first meets the first and the last before it in each of its
    buckets, and then all others there that this hasn't joined it with. Those
    pairs are made and looked at within cells, and only what joins groups comes
    out of them (``settled``). So within a bucket no link is left out; one is missed only if its texts share
    no key or lie beyond ``radius`` bits, and none is wrong.

    Each row counts by itself: rows that share a doc_id, or have none, stand in
    the groups of their own texts. Null, empty and blank texts are one text.
    Rows that are equal in all columns are one row, of which one stays; rows
    with other columns of their own but the same doc_id and text go by a hash
    of all columns. So the result does not depend on the order of rows. Rows to drop
    are found by hashes of 128 bits of the whole row, and only those hashes
    are shuffled, with the texts that are held against each other (``alike``);
    they are broadcast if they are counted few, and joined by key if they aren't.
    """
    spark = docs.sparkSession
    # With their nulls marked, as hashes pass over nulls.
    has_map = lambda f: "map<" in f.dataType.simpleString()
    # Maps have no hash, so they go by their text.
    value = {f.name: F.to_json(F.struct(F.col(quoted(f.name)).alias("m"))) if has_map(f) else F.col(quoted(f.name)) for f in docs.schema}
    whole = F.struct(*[x for c in docs.columns for x in (value[c], F.col(quoted(c)).isNull())])
    keys = {"k1": F.xxhash64(F.lit(1), whole), "k2": F.xxhash64(F.lit(2), whole)}
    rows = docs.select(
        F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), *[k.alias(n) for n, k in keys.items()]).alias("place"), "text"
    )
    marked = cut(text_sketches(rows))
    # One row for each different text, by which rows are joined where very many share one.
    texts = cut(marked.groupBy("t1", "t2").agg(F.min("place").alias("least"), *[F.first(c).alias(c) for c in ("fp", "keys", "sketch")]))
    texts = named(texts)
    keyed = texts.select("id", "fp", F.posexplode("keys").alias("band", "bits"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(texts.count() * KEYS, 2_000_000))
    met = compared(keyed, radius, parts, some_before).distinct()
    sketch = lambda side: texts.select(F.col("id").alias(side), F.col("sketch").alias(f"sketch_{side}")).hint("merge")
    sorted_out = lambda edges: cut(likely(edges.join(sketch("a"), "a").join(sketch("b"), "b"), similarity))

    def bodies_of(ids: DataFrame) -> DataFrame:
        met = cut(ids.distinct().join(texts.select("id", "least.k1", "least.k2"), "id"))
        bodies = cut(docs.select(*[k.alias(n) for n, k in keys.items()], "text").join(small_enough(met), ["k1", "k2"]).select("id", "text"))
        if bodies.count() > met.count():  # rows that are equal in all columns
            bodies = cut(bodies.groupBy("id").agg(F.first("text").alias("text")))
        return bodies

    near = sorted_out(met)
    found = cut(linked(near, bodies_of(near.select(F.col("a").alias("id")).union(near.select("b"))), similarity))
    again = cut(unsettled(keyed, found, texts.select("id", "sketch").hint("merge"), similarity, radius, parts))
    if not again.isEmpty():
        sets = cut(shingle_sets(bodies_of(again.select("id"))))
        more = settled(again, found, texts.select("id", "fp"), sets, similarity, radius)
        found = cut(components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(more)))
    roots = found.select(F.col("node").alias("id"), "root")
    low = with_least(roots.join(texts.select("id", "least"), "id"), "root", "least", "winner").select("id", "winner")
    winners = cut(texts.join(low, "id", "left").select("t1", "t2", F.coalesce("winner", "least").alias("winner")))
    won = (F.col("place.k1") == F.col("winner.k1")) & (F.col("place.k2") == F.col("winner.k2"))
    placed = marked.select("place", "t1", "t2").join(winners, ["t1", "t2"]).select("place.k1", "place.k2", won.alias("won"))
    # A winner that stands in several equal rows is held apart and made one.
    judged = cut(placed.groupBy("k1", "k2").agg(F.max("won").alias("won"), F.count("*").alias("n")).where("NOT won OR n > 1"))
    keyed = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)], *[k.alias(n) for n, k in keys.items()])
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    single = keyed.join(small_enough(judged.select("k1", "k2")), ["k1", "k2"], "left_anti").select(*back)
    repeated = cut(judged.where("won").select("k1", "k2"))
    if repeated.isEmpty():
        return single
    return single.unionAll(keyed.join(small_enough(repeated), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(*back))
