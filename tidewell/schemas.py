"""Fact tables: dimensions, dedupe key and the order rows are clustered by on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

METRIC_FIELDS = [
    T.StructField("clicks", T.IntegerType(), False),
    T.StructField("impressions", T.IntegerType(), False),
    T.StructField("sum_position", T.DoubleType(), False),
]
DEVICES = ("desktop", "mobile", "tablet")
SEARCH_TYPES = ("web", "image", "video", "news", "discover", "googleNews", "webMultimodal")


@dataclass(frozen=True)
class FactTable:
    name: str
    dimensions: tuple[str, ...]
    version: int = 1
    extra: tuple[str, ...] = ()

    @property
    def key(self) -> tuple[str, ...]:
        return ("date", *self.dimensions)

    @property
    def cluster(self) -> tuple[str, ...]:
        return (*self.dimensions, "date") if self.name != "hourly_pages" else ("url", "date", "hour")

    @property
    def additive(self) -> tuple[str, ...]:
        return ("clicks", "impressions", "sum_position", *(c for c in self.extra if c != "anonymized_impressions_pct"))

    def schema(self) -> T.StructType:
        dims = [T.StructField(d, T.IntegerType() if d == "hour" else T.StringType()) for d in self.dimensions]
        more = [T.StructField(c, T.DoubleType() if c.startswith(("sum_", "anonymized")) else T.IntegerType()) for c in self.extra]
        return T.StructType([*dims, T.StructField("date", T.DateType(), False), *METRIC_FIELDS, *more])


FACTS = {
    t.name: t
    for t in (
        FactTable("pages", ("url",)),
        FactTable("queries", ("query",), 3),
        FactTable("countries", ("country",)),
        FactTable("page_queries", ("url", "query"), 3),
        FactTable("dates", (), 1, ("anonymized_impressions_pct", *(f"{m}_{d}" for m in ("clicks", "impressions", "sum_position") for d in DEVICES))),
        FactTable("search_appearance", ("searchAppearance",)),
        FactTable("search_appearance_pages", ("searchAppearance", "url")),
        FactTable("search_appearance_queries", ("searchAppearance", "query"), 2),
        FactTable("search_appearance_page_queries", ("searchAppearance", "url", "query"), 2),
        FactTable("hourly_pages", ("url", "hour"), 2),
    )
}
