"""How the sources of a language differ in their terms: exact integer scores over chunks of a dictionary of terms."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import cut, parts_for

#: Documents of a language that must hold a term.
LEAST_DOCS = 10
#: Ranks of terms that are reported.
TOP_TERMS = 10
#: Terms of a chunk, and sources that are held against others at a time: a task holds two dense blocks of one by the other.
CHUNK_TERMS, TILE_SOURCES = 4096, 64
#: Terms that a task counts before it passes them on.
HELD_TERMS = 400_000
#: Counts that a chunk holds before it ends, and counts that a task makes chunks of.
CHUNK_ROWS, ROWS_PER_TASK = 1 << 18, 1 << 20
#: What shares are scaled to.
SCALE = 1_000_000_000
TERM_BYTES = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Everything that parts terms becomes a space, so that a split finds them.
SPACED = bytes(LOWER[b] if TERM_BYTES[b] else 32 for b in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term of a group, added up within tasks as far as HELD_TERMS goes.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower
    case, of whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = defaultdict(dict)
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in held.items():
                terms = pa.array(list(found), pa.binary()).cast(pa.string())
                n, d = (pa.array([c[k] for c in found.values()], pa.int64()) for k in (0, 1))
                columns = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
                for at in range(0, len(terms), 20_000):
                    yield pa.RecordBatch.from_arrays([x.slice(at, 20_000) for x in (*columns, terms, n, d)], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
                counts = held[lang, source]
                n_held -= len(counts)
                for term, n in Counter(bytes(text.as_buffer()).translate(SPACED).split()).items():
                    if (c := counts.get(term)) is None:
                        counts[term] = [n, 1]
                    else:
                        c[0] += n
                        c[1] += 1
                n_held += len(counts)
                if n_held > HELD_TERMS:
                    yield from flush()
                    n_held = 0
        yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * count / total), exact for totals below 9e15: long division, three digits at a time."""
    found, rest = np.zeros(count.shape, np.int64), count
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + digits
    return found + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def chunks(kept: DataFrame) -> DataFrame:
    """Integer-encoded counts of ``kept`` (lang, term, source, tile, n): a row for each chunk of a language's terms and tile of sources.

    The terms are dealt by ranges, so a task has consecutive ones: it takes up to
    CHUNK_TERMS of a language into a sorted array, finds each row's id by
    searchsorted, and adds up counts by id with bincount. Rows without a tile
    hold the terms themselves and their counts in the whole language; the others
    the ids and counts of each source of the tile that has any.
    """
    parts = parts_for(kept.count(), ROWS_PER_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seq = TaskContext.get().partitionId() << 32, 0
        vector = pa.struct([("source", pa.string()), ("ids", pa.binary()), ("counts", pa.binary())])

        def chunk(rows: list[tuple]) -> pa.RecordBatch:
            words = np.array([r[1].encode() for r in rows], object)
            terms = np.unique(words)
            ids = np.searchsorted(terms, words).astype(np.int32)
            n = np.array([r[4] for r in rows], np.int64)
            # Sums of whole numbers below 2**53, which doubles hold exactly.
            whole = np.bincount(ids, n, len(terms)).astype(np.int64)
            of: dict[tuple[int, str], list[int]] = defaultdict(list)
            for i, r in enumerate(rows):
                of[r[3], r[2]].append(i)
            tiles: dict[int, list[dict]] = defaultdict(list)
            for (tile, source), at in of.items():
                tiles[tile].append({"source": source, "ids": ids[at].tobytes(), "counts": n[at].tobytes()})
            m = len(tiles)
            columns = [
                pa.array([rows[0][0]] * (m + 1)), pa.array([place + seq] * (m + 1)), pa.array([None, *tiles], pa.int32()),
                pa.array([[t.decode() for t in terms], *[None] * m], pa.list_(pa.string())), pa.array([whole.tobytes(), *[None] * m], pa.binary()),
                pa.array([None, *tiles.values()], pa.list_(vector)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "tile", "terms", "whole", "vectors"])

        held: list[tuple] = []
        n_terms = 0
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "source", "tile", "n")), strict=True))
        for (lang, _), same in groupby(rows, itemgetter(0, 1)):
            if held and (lang != held[0][0] or n_terms == CHUNK_TERMS or len(held) >= CHUNK_ROWS):
                yield chunk(held)
                held, n_terms, seq = [], 0, seq + 1
            held += same
            n_terms += 1
        if held:
            yield chunk(held)

    dealt = kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(run, "lang string, chunk long, tile int, terms array<string>, whole binary, vectors array<struct<source:string,ids:binary,counts:binary>>")


def scores(grid: DataFrame) -> DataFrame:
    """lang, source, part, item, value of each chunk and pair of tiles of ``grid``: sums over the chunk's terms for pairs, TOP_TERMS terms of each source."""

    def dense(members: list, vectors: list | None, width: int, v: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Shares of all terms in each source, and the ids that occur there."""
        found = {x["source"]: (np.frombuffer(x["ids"], np.int32), np.frombuffer(x["counts"], np.int64)) for x in vectors or []}
        block, present = np.empty((len(members), width), np.int64), []
        for i, m in enumerate(members):
            ids, n = found.get(m["source"], (np.zeros(0, np.int32), np.zeros(0, np.int64)))
            counts = np.zeros(width, np.int64)
            counts[ids] = n
            block[i] = share(counts + 2, m["n"] + 2 * v) if width else 0
            present.append(ids)
        return block, present

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                v, width, alone = r["v"], r["width"], r["ta"] == r["tb"]
                out: list[tuple[str, str, str, int]] = []
                a, present = dense(r["a"], r["vectors_a"], width, v)
                b = a if alone else dense(r["b"], r["vectors_b"], width, v)[0]
                for i, x in enumerate(r["a"]):
                    for j, y in list(enumerate(r["b"]))[i + 1 if alone else 0 :]:
                        value = int(gap(a[i], b[j]).sum())
                        out += [(x["source"], "pair", y["source"], value), (y["source"], "pair", x["source"], value)]
                if alone and width:
                    whole = share(np.frombuffer(r["whole"], np.int64) + 2, r["lang_n"] + 2 * v)
                    for i, x in enumerate(r["a"]):
                        ids = np.sort(present[i][a[i][present[i]] > whole[present[i]]])
                        values = gap(a[i][ids], whole[ids])
                        out += [(x["source"], "term", r["terms"][ids[o]], int(values[o])) for o in np.argsort(-values, kind="stable")[:TOP_TERMS]]
                source, part, item, value = zip(*out, strict=True) if out else ([], [], [], [])
                columns = [pa.array(c, pa.string()) for c in ([r["lang"]] * len(out), source, part, item)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

    return grid.mapInArrow(run, "lang string, source string, part string, item string, value long")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """How each source of a language differs from the others, and by which terms: lang, source, part, item, value, rank.

    Null text, lang and source count as ''. A language's kept terms are those in
    ``least_docs`` of its documents or more; p of a term in a group is
    1 + floor(SCALE * (count + 2) / (N + 2 V)) for N occurrences of V kept terms,
    and a gap is floor((p - q)^2 / (p + q)), all in whole numbers. Part ``pair``
    has a row for each other source of the language with the sum of gaps over
    all kept terms (0 if there are none), part ``term`` the TOP_TERMS terms with
    the largest gaps to the language among those more frequent in the group.
    Ranks go by value, then by item in UTF-8 order.

    Each document row counts, repeated ones too; other columns are not looked
    at; an empty table gives no rows. Occurrences are added up before and in
    the shuffle, so a frequent term or a large source is a row for each task.
    What one task holds is bounded by CHUNK_TERMS, CHUNK_ROWS and TILE_SOURCES;
    the number of pairs is that of the report.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = cut(named.groupBy("lang", "source").agg(F.count("*").alias("n_docs")))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tile = F.pmod(F.xxhash64("source"), F.lit(parts_for(most, TILE_SOURCES))).cast("int").alias("tile")
    summed = count_terms(named).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = F.sum("docs").over(W.partitionBy("lang", "term"))
    kept = cut(summed.withColumn("of_lang", of_lang).where(F.col("of_lang") >= least_docs).select("lang", "term", "source", tile, "n"))
    encoded = cut(chunks(kept))
    words = encoded.where("tile IS NULL").select("lang", "chunk", "terms", "whole")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = words.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    group_sizes = groups.join(own, ["lang", "source"], "left").select("lang", "source", tile, F.coalesce("n", F.lit(0)).alias("n"))
    members = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("members")  # some TILE_SOURCES
    tiles = group_sizes.groupBy("lang", "tile").agg(members, F.sum("n").alias("tile_n")).withColumn("lang_n", F.sum("tile_n").over(W.partitionBy("lang")))
    tiles = cut(tiles.join(sizes, "lang", "left").select("lang", "tile", "members", "lang_n", F.coalesce("v", F.lit(0)).alias("v")))
    a = tiles.select("lang", F.col("tile").alias("ta"), F.col("members").alias("a"), "lang_n", "v")
    b = tiles.select("lang", F.col("tile").alias("tb"), F.col("members").alias("b"))
    pairs = a.join(b, "lang").where("ta <= tb")
    # A language without kept terms has one chunk, an empty one, for its pairs.
    places = words.select("lang", "chunk", F.size("terms").alias("width"))
    grid = pairs.join(places, "lang", "left").withColumn("width", F.coalesce("width", F.lit(0)))
    vectors = encoded.where("tile IS NOT NULL")
    for side in ("a", "b"):
        of_side = vectors.select("lang", "chunk", F.col("tile").alias(f"t{side}"), F.col("vectors").alias(f"vectors_{side}"))
        grid = grid.join(of_side, ["lang", "chunk", f"t{side}"], "left")
    grid = grid.join(words.select("lang", "chunk", "terms", "whole"), ["lang", "chunk"], "left")
    found = cut(scores(grid.repartition("lang", "chunk", "ta", "tb")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    of_terms = found.where("part = 'term'").select("*", rank).where(F.col("rank") <= TOP_TERMS)
    return found.where("part = 'pair'").select("*", rank).unionByName(of_terms)
