"""Generations of a site's sitemaps: staged feed by feed, published as a whole, read in pages, with the changes between them."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .published import Published, Superseded
from .staging import staged

LISTED = T.StructType().add("feed", "string").add("loc", "string").add("lastmod", "string")
ENTRY = T.StructType([*LISTED, T.StructField("first_seen_at", T.TimestampType()), T.StructField("last_seen_at", T.TimestampType())])
EVENT = T.StructType().add("feed", "string").add("op", "string").add("loc", "string").add("lastmod", "string").add("previous_lastmod", "string").add("observed_at", "timestamp")
BOUNDS = T.StructType().add("file", "string").add("first_feed", "string").add("first_loc", "string").add("last_feed", "string").add("last_loc", "string").add("n", "long")
#: Rows of a file of entries; a page opens the files that hold its rows.
FILE_ROWS = 100_000
MOST_PER_PAGE = 10_000


class Incomplete(Exception):
    """A generation lacks feeds (``missing``) that were expected of it."""

    def __init__(self, missing: list[str]) -> None:
        super().__init__(f"not staged: {', '.join(missing)}")
        self.missing = missing


def digest(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()[:32]


def checked_feed(feed: str) -> str:
    """``feed`` without blanks around it, if it is an http address without credentials."""
    parts = urlsplit(feed.strip())
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username is not None or parts.password is not None:
        raise ValueError(f"no feed: {feed!r}")
    return feed.strip()


def later(feed: str, loc: str, of: str = "") -> Column:
    """Whether (feed, loc), or the columns with a prefix, come after the given ones; as comparisons that reach the files."""
    f, loc_ = F.col(f"{of}feed"), F.col(f"{of}loc")
    return (f >= feed) & ((f > feed) | (loc_ > loc))


@dataclass(frozen=True)
class SitemapStore:
    """A site's sitemap generations under a root.

    A generation has an id and a moment (milliseconds since 1970). Its feeds are
    staged one by one; ``publish`` joins them with the newest generation, writes entries
    and events to folders of its own, and then publishes a record that names
    them. So readers see a generation as a whole or not at all, and a
    run that broke off can be started again. Entries are sorted by feed and loc
    over their files, and the bounds of each file are kept beside them.
    """

    spark: SparkSession
    root: str
    file_rows: int = FILE_ROWS

    @property
    def records(self) -> Published:
        return Published(self.spark, self.root)

    def staging(self, generation: str, observed_at: int, feed: str | None = None) -> str:
        return f"staged/{digest(generation)}_{observed_at}" + (f"/{digest(feed)}" if feed else "")

    def check(self, generation: str, observed_at: int) -> bool:
        """Whether the generation is still to be published; False if it is the newest, raises if it comes too late or its id is taken."""
        if not generation or observed_at < 0:
            raise ValueError("a generation needs an id and a moment")
        newest = None
        for name in self.records.names():
            _, moment, key, _ = name.split("_")
            newest = (int(moment), key)
            if key == digest(generation) and int(moment) != observed_at:
                raise Superseded(f"generation {generation} was published with another moment")
        if newest == (observed_at, digest(generation)):
            return False
        if newest and newest[0] >= observed_at:
            raise Superseded(f"a generation as new as {generation} is published")
        return True

    def stage(self, generation: str, observed_at: int, feed: str, urls: DataFrame) -> None:
        """Put a feed's urls (loc, lastmod) by for a generation, in place of what it staged for that feed before.

        Rows without a loc, or with a blank one, are left out; of repeated locs the one with the largest
        lastmod stays. A feed without urls is a feed too.
        """
        feed = checked_feed(feed)
        if not self.check(generation, observed_at):
            raise Superseded(f"generation {generation} is published")
        where = self.staging(generation, observed_at, feed)
        rows = urls.where(F.trim("loc") != "").groupBy(F.col("loc").cast("string").alias("loc")).agg(F.max(F.col("lastmod").cast("string")).alias("lastmod"))
        rows.select(F.lit(feed).alias("feed"), "loc", "lastmod").write.mode("overwrite").parquet(f"{self.root}/{where}")
        self.records.mark(f"{where}/_whole")

    def abort(self, generation: str, observed_at: int) -> None:
        """Delete what a generation has staged; raises if it is published."""
        if any(n.split("_")[1:3] == [str(observed_at), digest(generation)] for n in self.records.names()):
            raise ValueError(f"generation {generation} is published")
        self.records.delete(self.staging(generation, observed_at))

    def publish(self, generation: str, observed_at: int, feeds: list[str]) -> bool:
        """Publish a generation of ``feeds``, which must all be staged; False if it is the newest already.

        Entries of feeds that are not among them are gone. Raises ``Incomplete``,
        or ``Superseded`` if another generation was published meanwhile.
        """
        if not self.check(generation, observed_at):
            return False
        feeds = sorted({checked_feed(f) for f in feeds})
        paths = [self.staging(generation, observed_at, f) for f in feeds]
        missing = [f for f, p in zip(feeds, paths, strict=True) if not self.records.exists(f"{p}/_whole")]
        if missing:
            raise Incomplete(missing)
        after = self.records.newest()
        at = F.timestamp_millis(F.lit(observed_at))
        now = self.spark.read.schema(LISTED).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], LISTED)
        was = self.rows(after).select("feed", "loc", F.col("lastmod").alias("previous_lastmod"), "first_seen_at", F.lit(True).alias("was"))
        both = staged(now.withColumn("is", F.lit(True)).join(was, ["feed", "loc"], "outer"))
        op = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("lastmod").eqNullSafe(F.col("previous_lastmod")), "updated")
        folder = f"{digest(generation)}_{uuid.uuid4().hex}"
        entries = both.where("is").select("feed", "loc", "lastmod", F.coalesce("first_seen_at", at).alias("first_seen_at"), at.alias("last_seen_at"))
        spread = entries.repartitionByRange("feed", "loc").sortWithinPartitions("feed", "loc")
        spread.write.option("maxRecordsPerFile", self.file_rows).parquet(f"{self.root}/entries/{folder}")
        ends = self.spark.read.schema(ENTRY).parquet(f"{self.root}/entries/{folder}").groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min(F.struct("feed", "loc")).alias("a"), F.max(F.struct("feed", "loc")).alias("z"), F.count("*").alias("n")
        )
        bounds = ends.select("file", F.col("a.feed").alias("first_feed"), F.col("a.loc").alias("first_loc"), F.col("z.feed").alias("last_feed"), F.col("z.loc").alias("last_loc"), "n")
        bounds.orderBy("first_feed", "first_loc").write.parquet(f"{self.root}/bounds/{folder}")
        events = both.select("feed", op.alias("op"), "loc", "lastmod", "previous_lastmod", at.alias("observed_at")).where("op IS NOT NULL")
        events.write.parquet(f"{self.root}/events/{folder}")
        record = {"generation": generation, "observed_at": observed_at, "feeds": feeds}
        self.records.commit(record, f"{observed_at}_{folder}", after)
        self.records.delete(self.staging(generation, observed_at))
        return True

    def found(self, generation: str | None = None) -> str | None:
        """The name of a published generation's record, the newest if none is given."""
        names = [n for n in self.records.names() if generation is None or n.split("_")[2] == digest(generation)]
        return (names or [None])[-1]

    def needed(self, generation: str | None) -> str:
        name = self.found(generation)
        if name is None:
            raise LookupError(f"no generation {generation}" if generation else "no generation")
        return name

    def generation(self, generation: str | None = None) -> dict:
        """generation, observed_at and feeds of a published generation, the newest if none is given."""
        return self.records.load(self.needed(generation))

    @staticmethod
    def folder(name: str) -> str:
        return name.removesuffix(".json").split("_", 2)[2]

    def rows(self, name: str | None) -> DataFrame:
        if name is None:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/entries/{self.folder(name)}")

    def entries(self, generation: str | None = None, feed: str | None = None) -> DataFrame:
        """feed, loc, lastmod, first_seen_at and last_seen_at of a generation, of one feed if it is given."""
        rows = self.rows(self.needed(generation))
        return rows if feed is None else rows.where(F.col("feed") == checked_feed(feed))

    def page(self, limit: int = 500, cursor: str | None = None, feed: str | None = None, generation: str | None = None) -> tuple[list[Row], str | None]:
        """At most ``limit`` entries by feed and loc after ``cursor``, and the cursor of the next page, None at the end.

        A cursor says where the page before ended and stays with its generation,
        whatever is published meanwhile. Only the files that hold the page are read.
        """
        if not 1 <= limit <= MOST_PER_PAGE:
            raise ValueError(f"no limit: {limit}")
        feed = feed and checked_feed(feed)
        after = None
        if cursor is not None:
            try:
                of, chosen, *after = json.loads(cursor)
                at_feed, at_loc = after
            except (ValueError, TypeError) as e:
                raise ValueError("no cursor of this store") from e
            if chosen != feed or generation not in (None, of):
                raise ValueError("a cursor of another list")
            generation = of
        name = self.needed(generation)
        files = self.spark.read.schema(BOUNDS).parquet(f"{self.root}/bounds/{self.folder(name)}")
        if feed:
            files = files.where((F.col("first_feed") <= feed) & (F.col("last_feed") >= feed))
        if after:
            files = files.where(later(at_feed, at_loc, "last_"))
        opened, behind = [], 0
        # Files follow each other, and all after the first are read from their beginning.
        for r in files.orderBy("first_feed", "first_loc").limit(limit + 2).collect():
            if behind > limit:
                break
            behind += r.n if opened else 0
            opened.append(f"{self.root}/entries/{self.folder(name)}/{r.file}")
        if not opened:
            return [], None
        rows = self.spark.read.schema(ENTRY).parquet(*opened)
        if feed:
            rows = rows.where(F.col("feed") == feed)
        if after:
            rows = rows.where(later(at_feed, at_loc))
        got = rows.orderBy("feed", "loc").limit(limit + 1).collect()
        more = len(got) > limit
        got = got[:limit]
        return got, json.dumps([generation or self.generation()["generation"], feed, got[-1].feed, got[-1].loc]) if more else None

    def membership(self, urls: DataFrame, generation: str | None = None) -> DataFrame:
        """A row for each of ``urls`` (url): url, present, and feed, lastmod, first_seen_at and last_seen_at in the first feed, by name, that lists it."""
        asked = urls.select("url")
        listed = self.entries(generation).join(asked.distinct(), F.col("loc") == F.col("url"), "left_semi")
        first = listed.groupBy(F.col("loc").alias("url")).agg(F.min(F.struct("feed", "lastmod", "first_seen_at", "last_seen_at")).alias("e"))
        return asked.join(first, "url", "left").select("url", F.col("e").isNotNull().alias("present"), "e.*")

    def events(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """feed, op (added, removed, updated), loc, lastmod, previous_lastmod and observed_at of the published generations of a period of days.

        Only folders of generations in the period are read.
        """
        day = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).date().isoformat()
        names = [n for n in self.records.names() if (first or "") <= day(int(n.split("_")[1])) <= (last or "9999")]
        if not names:
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).parquet(*[f"{self.root}/events/{self.folder(n)}" for n in names])
