"""A search API as a table that Spark plans: a partition for each day, filters sent along, pages read inside tasks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains

from ..metrics import to_sum_position
from ..plans.periods import Period, gaps
from ..schemas import FACTS
from .ingest import to_path

#: Rows that the API gives at a time.
PAGE_ROWS = 25_000
#: What asks the API for one page: a request (site, search_type, day, dimensions, filters, start_row, row_limit) to rows (keys, clicks, impressions, position).
Client = Callable[[dict], list[dict]]


@dataclass(frozen=True)
class Asked:
    """A read: the days it spans, and (dimension, operator, value) for what else the API is to filter by."""

    site: str
    search_type: str
    dimensions: tuple[str, ...]
    first: dt.date
    last: dt.date
    page_rows: int = PAGE_ROWS
    filters: tuple[tuple[str, str, str], ...] = field(default=())


@dataclass
class Day(InputPartition):
    day: dt.date


class Reader(DataSourceReader):
    def __init__(self, client: Client, asked: Asked) -> None:
        self.client, self.asked = client, asked

    def take(self, f: Filter) -> bool:
        """Whether the API answers a filter: bounds of the date, equal and contained strings of a dimension."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        a = self.asked
        if name == "date" and isinstance(getattr(f, "value", None), dt.date):
            one = dt.timedelta(1)
            low = {GreaterThanOrEqual: f.value, EqualTo: f.value, GreaterThan: f.value + one}.get(type(f), a.first)
            high = {LessThanOrEqual: f.value, EqualTo: f.value, LessThan: f.value - one}.get(type(f), a.last)
            self.asked = replace(a, first=max(a.first, low), last=min(a.last, high))
            return type(f) in (GreaterThanOrEqual, GreaterThan, LessThanOrEqual, LessThan, EqualTo)
        sent = {EqualTo: "equals", StringContains: "contains"}.get(type(f))
        if name in a.dimensions and sent and isinstance(f.value, str):
            self.asked = replace(a, filters=(*a.filters, (name, sent, f.value)))
            return True
        if name in a.dimensions and isinstance(f, In) and len(f.value) == 1:
            return self.take(EqualTo(f.attribute, f.value[0]))
        return False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters that Spark must apply itself."""
        return [f for f in filters if not self.take(f)]

    def partitions(self) -> list[InputPartition]:
        days = (self.asked.last - self.asked.first).days + 1
        # An empty list would mean one partition of everything.
        return [Day(self.asked.first + dt.timedelta(i)) for i in range(days)] or [Day(None)]

    def read(self, partition: Day) -> Iterator[tuple]:
        a, start = self.asked, 0
        while partition.day is not None:
            request = {"site": a.site, "search_type": a.search_type, "day": partition.day.isoformat(), "dimensions": list(a.dimensions), "filters": [list(f) for f in a.filters], "start_row": start, "row_limit": a.page_rows}
            page = self.client(request)
            for row in page:
                yield (*row["keys"][: len(a.dimensions)], partition.day, int(row["clicks"]), int(row["impressions"]), float(row["position"]))
            start += len(page)
            if len(page) < a.page_rows:
                return


def live_format(client: Client, name: str = "search_api") -> type[DataSource]:
    """A format to register with ``spark.dataSource.register``, over a client that is sent to the tasks.

    Spark reads it only with ``spark.sql.python.filterPushdown.enabled`` set to
    true, which is how bounds and filters reach the client.

    Options: site, dimensions (with commas), first and last (days), search_type
    (web), page_rows. Columns: the dimensions as strings, date, clicks,
    impressions, position.
    """

    class SearchApi(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def asked(self) -> Asked:
            o = self.options
            named = tuple(d for d in o.get("dimensions", "").split(",") if d)
            first, last = (dt.date.fromisoformat(o[k]) for k in ("first", "last"))
            return Asked(o["site"], o.get("search_type", "web"), named, first, last, int(o.get("page_rows", PAGE_ROWS)))

        def schema(self) -> T.StructType:
            dims = [T.StructField(d, T.StringType()) for d in self.asked().dimensions]
            numbers = [("clicks", T.LongType()), ("impressions", T.LongType()), ("position", T.DoubleType())]
            return T.StructType([*dims, T.StructField("date", T.DateType()), *[T.StructField(n, t) for n, t in numbers]])

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(client, self.asked())

    return SearchApi


def live_facts(spark: SparkSession, table: str, site: str, first: str, last: str, search_type: str = "web", name: str = "search_api", page_rows: int = PAGE_ROWS) -> DataFrame:
    """Facts of ``table`` from the registered format, as the store has them.

    Bounds of the date and filters on dimensions are planned into the source,
    but for those on url, which hold for the path alone and are applied by Spark.
    """
    t = FACTS[table]
    rows = spark.read.format(name).options(site=site, dimensions=",".join(t.dimensions), first=first, last=last, search_type=search_type, page_rows=page_rows).load()
    dims = [(to_path(F.col(d)) if d == "url" else F.col(d).cast("int") if d == "hour" else F.col(d)).alias(d) for d in t.dimensions]
    position = to_sum_position(F.col("position"), F.col("impressions").cast("double")).alias("sum_position")
    return rows.select(*dims, "date", *[F.col(m).cast("int").alias(m) for m in ("clicks", "impressions")], position)


def with_gaps(stored: DataFrame, live: Callable[[str, str], DataFrame], covered: list[tuple[dt.date, dt.date]], first: str, last: str) -> DataFrame:
    """Facts of a period: stored ones of the days in ``covered``, and live ones, asked by ``live(first, last)``, of the other days alone."""
    wanted = Period(dt.date.fromisoformat(first), dt.date.fromisoformat(last))
    missing = gaps(wanted, [Period(a, b) for a, b in covered])
    kept = stored.where(F.col("date").between(F.lit(wanted.first), F.lit(wanted.last)))
    for gap in missing:
        kept = kept.where(~F.col("date").between(F.lit(gap.first), F.lit(gap.last)))
    return reduce(lambda a, b: a.unionByName(b), [live(g.first.isoformat(), g.last.isoformat()).select(*stored.columns) for g in missing], kept)
