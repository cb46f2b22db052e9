"""From a query specification to DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..metrics import METRICS, aggregates
from .spec import TIME_DIMENSIONS, Filter, Leaf, QueryError, QuerySpec, leaves, period_of, search_type_of

FAMILIES = ({"page", "query", "queryCanonical"}, {"country"}, {"searchAppearance", "page", "query", "queryCanonical"})


def dataset_for(dimensions: set[str]) -> str:
    """The one table that stores these dimensions together, or QueryError."""
    need = {d for d in dimensions if d not in TIME_DIMENSIONS}
    if need and not any(need <= f for f in FAMILIES):
        raise QueryError("unresolvable-dataset", f"no table stores {', '.join(sorted(need))} together")
    if "hour" in dimensions:
        if need - {"page"}:
            raise QueryError("unresolvable-dataset", "hours are stored by page alone")
        return "hourly_pages"
    page, query = "page" in need, bool(need & {"query", "queryCanonical"})
    if "searchAppearance" in need:
        return "search_appearance" + ("_page_queries" if page and query else "_pages" if page else "_queries" if query else "")
    if page and query:
        return "page_queries"
    return "queries" if query else "pages" if page else "countries" if "country" in need else "dates"


def path_of(url: Column) -> Column:
    """Stored absolute addresses count as their path."""
    bare = F.nullif(F.regexp_replace(url, "^https?://[^/]+", ""), F.lit(""))
    return F.when(url.startswith("http"), F.coalesce(bare, F.lit("/"))).otherwise(url)


def column_of(dimension: str, raw: bool = False) -> Column:
    if dimension == "page":
        return F.col("url") if raw else path_of(F.col("url"))
    if dimension == "queryCanonical":
        return F.coalesce("query_canonical", "query")
    return F.col(dimension)


def compare(c: Column, leaf: Leaf) -> Column:
    v = leaf.value
    return {
        "equals": lambda: c == v, "notEquals": lambda: c != v, "gte": lambda: c >= v, "gt": lambda: c > v, "lte": lambda: c <= v, "lt": lambda: c < v,
        "between": lambda: c.between(v, leaf.upper), "contains": lambda: c.contains(v), "notContains": lambda: ~c.contains(v),
        "regex": lambda: c.rlike(v), "notRegex": lambda: ~c.rlike(v),
    }[leaf.op]()


def condition(leaf: Leaf) -> Column:
    if leaf.op == "topLevel":
        p = path_of(F.col("url"))
        return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))) <= 1
    return compare(column_of(leaf.column, raw=leaf.op not in ("equals", "notEquals")), leaf)


def tree(f: Filter | None, wanted) -> Column | None:
    """The part of a filter whose leaves are wanted, groups kept; None if nothing is left."""
    if f is None:
        return None
    if isinstance(f, Leaf):
        return condition(f) if wanted(f) else None
    parts = [c for p in f.parts if (c := tree(p, wanted)) is not None]
    if not parts:
        return None
    return reduce((lambda a, b: a | b) if f.kind == "or" else (lambda a, b: a & b), parts)


def metric_tree(f: Filter | None) -> Column | None:
    if f is None:
        return None
    if isinstance(f, Leaf):
        return compare(F.col(f.column), f) if f.column in METRICS else None
    parts = [c for p in f.parts if (c := metric_tree(p)) is not None]
    return reduce((lambda a, b: a | b) if f.kind == "or" else (lambda a, b: a & b), parts) if parts else None


def is_dimension(leaf: Leaf) -> bool:
    return leaf.column not in METRICS and leaf.column not in ("date", "searchType")


@dataclass(frozen=True)
class Plan:
    """A checked specification with its table and period."""

    spec: QuerySpec
    dataset: str
    first: str | None
    last: str | None


def plan(spec: QuerySpec) -> Plan:
    spec = spec.checked()
    spec = replace(spec, search_type=spec.search_type or search_type_of(spec.filter))
    used = {leaf.column for leaf in leaves(spec.filter) if is_dimension(leaf)}
    return Plan(spec, dataset_for({*spec.dimensions, *used}), *period_of(spec.filter))


@dataclass(frozen=True)
class Lake:
    """Fact tables by name, and the dimension (query, query_canonical) if there is one.

    ``canonical_daily`` may hold query_canonical, date and the sums of queries;
    reads that need no raw query use it instead of joining the dimension.
    """

    tables: dict[str, DataFrame]
    query_dim: DataFrame | None = None
    canonical_daily: DataFrame | None = None

    def scan(self, p: Plan) -> DataFrame:
        names = {*p.spec.dimensions, *(leaf.column for leaf in leaves(p.spec.filter))}
        if "queryCanonical" in names and p.dataset == "queries" and "query" not in names and self.canonical_daily is not None:
            return self.canonical_daily.withColumn("query", F.col("query_canonical"))
        if p.dataset not in self.tables:
            raise QueryError("unresolvable-dataset", f"there is no table {p.dataset}")
        rows = self.tables[p.dataset]
        if "queryCanonical" in names:
            if self.query_dim is None:
                raise QueryError("unresolvable-dataset", "there is no query dimension")
            rows = rows.join(self.query_dim.select("query", "query_canonical"), "query", "left")
        return rows


def of_search_type(rows: DataFrame, p: Plan) -> DataFrame:
    if p.spec.search_type is None:
        return rows
    if "search_type" not in rows.columns:
        raise QueryError("unresolvable-dataset", f"the table {p.dataset} does not tell search types apart")
    return rows.where(F.col("search_type") == p.spec.search_type)


def rows_of(lake: Lake, p: Plan, prefilter: bool = True, filters: Filter | None = None) -> DataFrame:
    """Rows of the plan's table and period under its dimension filters and, if wanted, its row-level metric filter."""
    rows = lake.scan(p)
    if p.first:
        rows = rows.where(F.col("date") >= F.lit(p.first).cast("date"))
    if p.last:
        rows = rows.where(F.col("date") <= F.lit(p.last).cast("date"))
    rows = of_search_type(rows, p)
    where = tree(filters if filters is not None else p.spec.filter, is_dimension)
    if where is not None:
        rows = rows.where(where)
    if prefilter:
        # Ratios aren't stored, so only sums can be filtered by row.
        raw = tree(p.spec.prefilter, lambda leaf: leaf.column in ("clicks", "impressions"))
        rows = rows if raw is None else rows.where(raw)
        if p.spec.minimum_impressions is not None:
            rows = rows.where(F.col("impressions") >= p.spec.minimum_impressions)
    return rows


def grouped(rows: DataFrame, p: Plan, having: bool = True) -> DataFrame:
    """All four metrics of each group."""
    keys = [column_of(d).alias(d) for d in p.spec.dimensions]
    out = rows.groupBy(*keys).agg(*aggregates()) if keys else rows.agg(*aggregates())
    left = metric_tree(p.spec.filter) if having else None
    return out if left is None else out.where(left)


def ordering(p: Plan, column: str | None = None, direction: str | None = None) -> list[Column]:
    """The wanted column first, then the dimensions, so that pages never overlap."""
    by, way = column or p.spec.order_by[0], direction or p.spec.order_by[1]
    first = F.desc_nulls_last(by) if way == "desc" else F.asc_nulls_last(by)
    return [first, *[F.asc_nulls_last(d) for d in dict.fromkeys(p.spec.dimensions) if d != by]]


def paged(df: DataFrame, p: Plan, order: list[Column] | None = None) -> DataFrame:
    out = df.orderBy(*(order or ordering(p)))
    return (out.offset(p.spec.offset) if p.spec.offset else out).limit(p.spec.limit)


def run(lake: Lake, spec: QuerySpec) -> DataFrame:
    """The page of groups that the specification asks for; it may order by a metric that it doesn't select."""
    p = plan(spec)
    return paged(grouped(rows_of(lake, p), p), p).select(*p.spec.dimensions, *p.spec.metrics)


def totals(lake: Lake, spec: QuerySpec) -> DataFrame:
    """One row: metrics over all groups that pass, before paging, and their number."""
    p = plan(spec)
    rows = rows_of(lake, p)
    keys = [column_of(d).alias(d) for d in p.spec.dimensions]
    sums = rows.groupBy(*keys).agg(*aggregates(), F.sum("sum_position").alias("sum_position"))
    left = metric_tree(p.spec.filter)
    sums = sums if left is None else sums.where(left)
    return sums.agg(*aggregates(), F.count("*").alias("total_count")).toDF(*(f"total_{m}" for m in METRICS), "total_count")


def with_totals(lake: Lake, spec: QuerySpec) -> DataFrame:
    """``run`` with the row of ``totals`` beside each row."""
    return run(lake, spec).crossJoin(F.broadcast(totals(lake, spec)))


def canonical_variants(lake: Lake, spec: QuerySpec, most: int = 10) -> DataFrame:
    """For each canonical query on the page: how many raw queries it has, the commonest one, and the first ``most``.

    Variants are query:::clicks:::impressions:::position (to one decimal), parted by ||.
    """
    p = plan(spec)
    page = run(lake, spec).select("queryCanonical")
    raw = lake.tables["queries"].join(lake.query_dim.select("query", "query_canonical"), "query", "left")
    raw = of_search_type(raw, p).where(F.col("date").between(F.lit(p.first).cast("date"), F.lit(p.last).cast("date"))).withColumn("queryCanonical", column_of("queryCanonical"))
    each = raw.join(page, "queryCanonical", "left_semi").groupBy("queryCanonical", "query").agg(*aggregates())
    order = (-F.col("clicks")).alias("o")
    counts = each.groupBy("queryCanonical").agg(F.count("*").cast("int").alias("variant_count"), F.min(F.struct(order, "query"))["query"].alias("canonical_name"))
    # Only the first of each canonical query are collected, however many it has.
    ranked = each.withColumn("n", F.row_number().over(W.partitionBy("queryCanonical").orderBy(order, "query"))).where(F.col("n") <= most)
    ordered = F.sort_array(F.collect_list(F.struct("n", "query", "clicks", "impressions", "position")))
    packed = F.transform("v", lambda v: F.concat_ws(":::", v["query"], v["clicks"].cast("long").cast("string"), v["impressions"].cast("long").cast("string"), F.round(v["position"], 1).cast("string")))
    firsts = ranked.groupBy("queryCanonical").agg(ordered.alias("v")).select("queryCanonical", F.array_join(packed, "||").alias("variants"))
    return counts.join(firsts, "queryCanonical", "left").select("queryCanonical", "variant_count", "canonical_name", F.coalesce("variants", F.lit("")).alias("variants"))


def padded_days(daily: DataFrame, first: str, last: str) -> DataFrame:
    """One row for each day of the period; metrics of missing days are zero."""
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    others = [c for c in daily.columns if c != "date"]
    return days.join(daily, "date", "left").select("date", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in others])


def detail(lake: Lake, spec: QuerySpec) -> DataFrame:
    """A daily series of the filtered rows over the whole period."""
    p = plan(QuerySpec(("date",), spec.metrics, spec.filter, spec.prefilter, ("date", "asc"), 100_000, 0, spec.search_type))
    daily = grouped(rows_of(lake, p), p).select("date", *p.spec.metrics)
    return padded_days(daily, p.first, p.last)
