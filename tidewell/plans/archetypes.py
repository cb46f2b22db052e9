"""Canned dashboard reads. Their click rate is zero, not null, where nothing was seen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..metrics import METRICS, aggregates, sql_functions
from ..schemas import DEVICES
from ..sources.staging import staged
from .compare import PREVIOUS
from .planner import Lake, column_of, dataset_for
from .spec import QueryError

MOVERS = {
    "improving": lambda: (F.col("clicks") > F.col("prevClicks"), [F.desc(F.col("clicks") - F.col("prevClicks"))]),
    "declining": lambda: (F.col("clicks") < F.col("prevClicks"), [F.asc(F.col("clicks") - F.col("prevClicks"))]),
    "new": lambda: ((F.col("prevImpressions") == 0) & (F.col("impressions") > 0), [F.desc("clicks"), F.desc("impressions")]),
    "lost": lambda: ((F.col("impressions") == 0) & (F.col("prevImpressions") > 0), [F.desc("prevImpressions")]),
}


@dataclass(frozen=True)
class Facet:
    column: str
    op: str  # eq, regex, notRegex; patterns meet the lower-cased value
    value: str

    def condition(self) -> Column:
        c = column_of(self.column)
        made = {"eq": lambda: c == self.value, "regex": lambda: F.lower(c).rlike(self.value), "notRegex": lambda: ~F.lower(c).rlike(self.value)}
        if self.op not in made:
            raise QueryError("unknown-facet", f"no facet operator {self.op!r}")
        return made[self.op]()


Period = tuple[str, str]


def daily_table(dimension: str | None, facets: tuple[Facet, ...], otherwise: str) -> str:
    """The table for a daily read; what no table can answer is refused, never answered unfiltered."""
    if not facets:
        return otherwise
    dims = {f.column for f in facets} | ({dimension} if dimension else set())
    if odd := dims - {"page", "query", "queryCanonical", "country"}:
        raise QueryError("unresolvable-dataset", f"a daily read can't combine a facet with {', '.join(sorted(odd))}")
    if "country" in dims and len(dims) > 1:
        raise QueryError("unresolvable-dataset", "no table stores country with page or query")
    return dataset_for(dims)


def scan(lake: Lake, table: str, period: Period, facets: tuple[Facet, ...] = (), dims: tuple[str, ...] = ()) -> DataFrame:
    rows = lake.tables[table].where(F.col("date").between(*[F.lit(d).cast("date") for d in period]))
    if "queryCanonical" in {*dims, *(f.column for f in facets)}:
        rows = rows.join(lake.query_dim.select("query", "query_canonical"), "query", "left")
    for f in facets:
        rows = rows.where(f.condition())
    return rows


def measured(rows: DataFrame, keys: list[Column], metrics: tuple[str, ...], *more: Column) -> DataFrame:
    out = rows.groupBy(*keys).agg(*aggregates(*metrics), *more)
    return out.withColumn("ctr", F.coalesce("ctr", F.lit(0.0))) if "ctr" in metrics else out


def site_daily_timeseries(lake: Lake, period: Period, metrics=METRICS, facets: tuple[Facet, ...] = ()) -> DataFrame:
    return measured(scan(lake, daily_table(None, facets, "dates"), period, facets), [F.col("date")], metrics).orderBy("date")


def entity_daily_timeseries(lake: Lake, period: Period, dimension: str, value: str, metrics=METRICS, facets: tuple[Facet, ...] = ()) -> DataFrame:
    rows = scan(lake, daily_table(dimension, facets, dataset_for({dimension})), period, facets, (dimension,))
    return measured(rows.where(column_of(dimension) == value), [F.col("date")], metrics).orderBy("date")


def entity_daily_sparkline(lake: Lake, period: Period, dimension: str, entities: list[str], metric: str, facets: tuple[Facet, ...] = ()) -> DataFrame:
    if not entities:
        raise QueryError("invalid-filter", "a sparkline needs entities")
    rows = scan(lake, daily_table(dimension, facets, dataset_for({dimension})), period, facets, (dimension,)).where(column_of(dimension).isin(*entities))
    return measured(rows, [column_of(dimension).alias("entity"), F.col("date")], (metric,)).orderBy("entity", "date")


def by_device(rows: DataFrame) -> DataFrame:
    each = [F.struct(F.lit(d).alias("device"), *[F.coalesce(F.col(f"{m}_{d}").cast("double"), F.lit(0.0)).alias(m) for m in ("clicks", "impressions", "sum_position")]) for d in DEVICES]
    return rows.select("date", F.explode(F.array(*each)).alias("d")).select("date", "d.*")


def top_n_breakdown(
    lake: Lake, period: Period, dimension: str, order: tuple[str, str] = ("clicks", "desc"), limit=10, offset=0, metrics=METRICS,
    facets: tuple[Facet, ...] = (), compare: Period | None = None, movers: str | None = None, total=False,
) -> DataFrame:
    """Groups of one dimension by a metric, with the period before, movement, device columns and counts as asked for."""
    wanted = tuple(dict.fromkeys((*metrics, order[0])))
    if movers and movers not in MOVERS:
        raise QueryError("unknown-movers", f"no movers mode {movers!r}")
    if dimension == "device" and facets:
        raise QueryError("unresolvable-dataset", "devices are stored without other dimensions")
    table = "dates" if dimension == "device" else dataset_for({dimension, *(f.column for f in facets)})

    def side(p: Period) -> DataFrame:
        rows = scan(lake, table, p, facets, (dimension,))
        return by_device(rows) if dimension == "device" else rows

    key = [(F.col("device") if dimension == "device" else column_of(dimension)).alias(dimension)]
    variants = [F.countDistinct("query").alias("variantCount")] if dimension == "queryCanonical" else []
    out = measured(side(period), key, METRICS if compare else wanted, *variants)
    first = F.desc_nulls_last(order[0]) if order[1] == "desc" else F.asc_nulls_last(order[0])
    ranks = [first]
    if compare:
        before = measured(side(compare), key, METRICS).toDF(dimension, *PREVIOUS.values())
        shown = [F.coalesce(m, F.lit(0.0)).alias(m) for m in wanted] + [F.coalesce(m, F.lit(0.0)).alias(m) for m in ("impressions", "clicks") if m not in wanted]
        out = out.join(before, dimension, "outer").select(dimension, *shown, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in PREVIOUS.values()], *[c for c in ("variantCount",) if variants])
        if movers:
            where, ranks = MOVERS[movers]()
            out = out.where(where)
    if total:
        out = staged(out)  # computed once, for its rows and their number
        out = out.crossJoin(F.broadcast(out.agg(F.count("*").alias("total"))))
    page = out.orderBy(*ranks, F.asc_nulls_last(dimension))
    return (page.offset(offset) if offset else page).limit(limit)


def single_row_lookup(lake: Lake, period: Period, match: dict[str, str], metrics=METRICS) -> DataFrame:
    dims = tuple(match)
    rows = scan(lake, dataset_for(set(dims)), period, (), dims)
    for d, v in match.items():
        rows = rows.where(column_of(d) == v)
    return measured(rows, [], metrics)


def multi_series_stacked_daily(lake: Lake, period: Period, series: str, metric: str, facets: tuple[Facet, ...] = ()) -> DataFrame:
    if series == "device":
        if facets:
            raise QueryError("unresolvable-dataset", "devices are stored without other dimensions")
        return measured(by_device(scan(lake, "dates", period)), [F.col("date"), F.col("device").alias("series")], (metric,)).orderBy("date", "series")
    rows = scan(lake, daily_table(series, facets, dataset_for({series})), period, facets, (series,))
    return measured(rows, [F.col("date"), column_of(series).alias("series")], (metric,)).orderBy("date", "series")


def two_dimension_detail(lake: Lake, period: Period, page: str | None = None, query: str | None = None, metrics=METRICS, limit=1000) -> DataFrame:
    rows = scan(lake, "page_queries", period)
    for d, v in (("page", page), ("query", query)):
        rows = rows if v is None else rows.where(column_of(d) == v)
    out = measured(rows, [column_of("page").alias("page"), F.col("query")], metrics)
    return out.orderBy(F.desc_nulls_last(metrics[0]), "page", "query").limit(limit)


def arbitrary_sql(lake: Lake, sql: str, **args) -> DataFrame:
    """Spark SQL over views of the fact tables, with ``gsc_position`` of sums; pages also show as ``page``."""
    spark = next(iter(lake.tables.values())).sparkSession
    sql_functions(spark)
    for name, df in lake.tables.items():
        (df.withColumn("page", F.col("url")) if "url" in df.columns else df).createOrReplaceTempView(name)
    return spark.sql(sql, args=args or None)


def aux_cloud_only(*_args, **_options) -> DataFrame:
    raise QueryError("unsupported", "this read needs a hosted service")
