"""Line deduplication by winnowing, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, cut

#: Lines of the shortest run that is found; also the winnowing window.
RUN_LINES = 3
#: Words of the shortest line that is found on its own: those of the shortest licence notice of the test data.
LINE_WORDS = 5


def window_at(hashes: Column, i: Column, run: Column) -> Column:
    """The line hashes of the window that starts at line i (from 0)."""
    return F.slice(hashes, i + 1, run)


def dedup_lines(docs: DataFrame, run_lines: int = RUN_LINES, line_words: int | None = LINE_WORDS) -> DataFrame:
    """Delete later copies of runs of lines: doc_id, text, n_lines and n_removed.

    A window is ``run_lines`` lines in a row of one text (parted by line
    feeds), or all lines of a text that has fewer, or one line of
    ``line_words`` words or more (never, if that is None). So what stays of
    repeats is runs of fewer than ``run_lines`` lines, each of fewer words than
    that. A line goes if a window that covers it has the same lines as a window that starts earlier: in a document
    with a smaller doc_id (null last), or further up in the same one. Windows
    are judged on the input. So a run of that length or more that came before
    loses all its lines, and its first copy stays whole, but for runs that
    overlap themselves.

    1. Each line is hashed; each window selects its smallest hash, the last of
       equal ones. Equal windows select the same line, so these fingerprints
       are guaranteed to catch each repeated run. A long line is a window of
       one line, and its own fingerprint.
    2. Fingerprints are joined with the places they occur in; those with one
       place are dropped.
    3. A place that is left is extended both ways to the windows that selected
       it, and each is joined with the first window of the same lines; there
       are never pairs of copies.
    4. The lines of later windows are deleted.

    Lines are compared by their 64-bit hashes, windows by all hashes of their
    lines. A null text gives a null text, no lines and nothing removed; an empty
    text is one empty line. Rows that repeat doc_id and text are one document
    and are cut alike. One row per input row; other columns are ignored; an
    empty table gives no rows.
    """
    lines = F.split("text", "\n", -1)
    long = [] if line_words is None else [F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD_PATTERN)) >= line_words).alias("long")]
    hashed = (
        docs.where("text IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), F.transform(lines, lambda x: F.xxhash64(x)).alias("h"), *long)
        .withColumn("run", F.least(F.lit(run_lines), F.size("h")))
    )
    # One entry for each window: where it starts, its smallest hash, and where that stands (the last of equal ones).
    selected = F.transform(
        F.sequence(F.lit(0), F.size("h") - F.col("run")),
        lambda i: F.aggregate(
            F.sequence(F.lit(1), F.col("run") - 1),
            F.struct(F.element_at("h", i + 1).alias("fp"), i.alias("at"), i.alias("start"), F.col("run").alias("n")),
            lambda best, j: F.when(
                F.element_at("h", i + j + 1) <= best["fp"],
                F.struct(F.element_at("h", i + j + 1).alias("fp"), (i + j).alias("at"), i.alias("start"), F.col("run").alias("n")),
            ).otherwise(best),
        ),
    )
    one_line = F.transform(F.col("h"), lambda x, i: F.struct(x.alias("fp"), i.alias("at"), i.alias("start"), F.lit(1).alias("n")))
    if line_words is not None:
        selected = F.concat(selected, F.filter(one_line, lambda w: F.element_at("long", w["at"] + 1)))
    windows = hashed.withColumn("w", F.explode(F.when(F.col("run") == 1, one_line).otherwise(selected))).select(
        "doc_id",
        "body",
        F.col("w.fp").alias("fp"),
        F.col("w.at").alias("at"),
        F.col("w.start").alias("start"),
        window_at(F.col("h"), F.col("w.start"), F.col("w.n")).alias("key"),
    )
    # Rows that repeat doc_id and text have the same places, and so count once.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body", "at")
    # Both tables below have one row per key and are written out, so that the joins with them can be split where a key is hot.
    live = cut(windows.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("fp"))
    extended = windows.join(live, "fp", "left_semi")
    start = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("body"), F.col("start"))
    firsts = cut(extended.groupBy("key").agg(F.min(start).alias("first")))
    later = extended.join(firsts, "key").where(start > F.col("first"))
    removed = (
        later.groupBy("doc_id", "body")
        .agg(F.collect_set(F.struct("start", F.size("key").alias("n"))).alias("runs"))
        .select(
            F.col("doc_id").alias("of_id"),
            F.col("body").alias("of_body"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))))).alias("gone"),
        )
    )
    # A sign for each line up to the last that goes, in one pass: - for those that stay, x for those that go.
    before = lambda i: F.when(i > 0, F.element_at("gone", F.greatest(i, F.lit(1)))).otherwise(-1)
    signs = F.array_join(F.transform("gone", lambda j, i: F.concat(F.repeat(F.lit("-"), j - before(i) - 1), F.lit("x"))), "")
    marks = removed.select("of_id", "of_body", F.size("gone").cast("long").alias("n_gone"), signs.alias("signs"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("body"))
    marked = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("body") == F.col("of_body")), "left")
    # Lines beyond the last sign stay; array_join passes over those that are null.
    kept = F.zip_with(lines, F.split("signs", ""), lambda x, sign: F.when(sign.isNull() | (sign == "-"), x))
    return marked.select(
        "doc_id",
        F.when(F.col("signs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_removed"),
    )
