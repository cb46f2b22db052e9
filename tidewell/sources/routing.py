"""Where a read is answered: attached tables, lists of files, stored facts or a live source, and rollups that cover it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..metrics import sql_functions
from ..plans import planner
from ..plans.periods import Period, gaps
from ..plans.planner import Lake, Plan
from ..plans.spec import METRICS, QueryError, QuerySpec, leaves, period_of
from ..schemas import FACTS


class MissingTables(QueryError):
    """Tables that a read needs are not attached."""

    def __init__(self, tables: list[str]) -> None:
        super().__init__("unresolvable-dataset", f"no attached table {', '.join(tables)}")
        self.tables = tables


def from_files(spark: SparkSession, table: str, paths: list[str]) -> DataFrame:
    """One fact table from a list of files by its schema: columns a file lacks are null, no file gives no rows."""
    schema = FACTS[table].schema()
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def lake_of_files(spark: SparkSession, sets: dict[str, list[str]], query_dim: DataFrame | None = None) -> Lake:
    """A lake from named lists of files, one for each table."""
    return Lake({table: from_files(spark, table, paths) for table, paths in sets.items()}, query_dim)


def attached(spark: SparkSession, schema: str, tables: list[str], query_dim: DataFrame | None = None) -> Lake:
    """A lake from tables of the session's catalog; all of ``tables`` must be there."""
    missing = [t for t in tables if not spark.catalog.tableExists(f"{schema}.{t}")]
    if missing:
        raise MissingTables(missing)
    return Lake({t: spark.table(f"{schema}.{t}") for t in tables}, query_dim)


def views(lake: Lake) -> None:
    """Temporary views of all tables, every fact table among them: what the lake lacks is an empty view, and missing columns are null; with ``sql_functions``."""
    spark = next(iter(lake.tables.values())).sparkSession
    sql_functions(spark)
    for name, table in FACTS.items():
        rows, schema = lake.tables.get(name), table.schema()
        if rows is None:
            rows = spark.createDataFrame([], schema)
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in rows.columns]
        rows.select("*", *more).createOrReplaceTempView(name)


@dataclass(frozen=True)
class SqlSource:
    """A source that answers SQL itself, and specifications by SQL over its views; ``execute`` runs it and can be any engine that gives DataFrames."""

    name: str
    lake: Lake
    execute: Callable[[str, dict], DataFrame] | None = None

    def query(self, spec: QuerySpec) -> DataFrame:
        return planner.run(self.lake, spec)

    def sql(self, text: str, **args) -> DataFrame:
        views(self.lake)
        if self.execute is not None:
            return self.execute(text, args)
        return next(iter(self.lake.tables.values())).sparkSession.sql(text, args=args or None)


#: Dimensions that only stored facts know.
STORED_ONLY = {"queryCanonical", "brandedClassification"}


def live_can(spec: QuerySpec) -> bool:
    """Whether a live source can answer: no condition on single rows, and no dimension that only stored facts know."""
    used = {*spec.dimensions, *(leaf.column for leaf in leaves(spec.filter))}
    return spec.prefilter is None and spec.minimum_impressions is None and not used & STORED_ONLY


@dataclass(frozen=True)
class Coverage:
    """The days a store holds: its first and last, and its runs of days if they are known."""

    first: dt.date | None = None
    last: dt.date | None = None
    runs: tuple[Period, ...] | None = None


def why_live(spec: QuerySpec, stored: Coverage, can: Callable[[QuerySpec], bool] = live_can) -> str | None:
    """Why a read goes to the live source: cross-dimension, nothing-stored, outside or gap; None if it is answered from the store."""
    if not can(spec):
        return None
    try:
        planner.plan(spec)
    except QueryError as err:
        if err.kind == "unresolvable-dataset":
            return "cross-dimension"
        raise
    first, last = period_of(spec.filter)
    if not first or not last:
        return None
    if not stored.first or not stored.last:
        return "nothing-stored"
    wanted = Period(dt.date.fromisoformat(first), dt.date.fromisoformat(last))
    if wanted.first < stored.first or wanted.last > stored.last:
        return "outside"
    return "gap" if stored.runs is not None and gaps(wanted, list(stored.runs)) else None


@dataclass(frozen=True)
class Composite:
    """Stored facts where they cover a read, a live source where they don't. SQL goes to the store."""

    stored: SqlSource
    live: Callable[[QuerySpec], DataFrame]
    coverage: Coverage
    can: Callable[[QuerySpec], bool] = live_can

    def query(self, spec: QuerySpec) -> DataFrame:
        return self.live(spec) if why_live(spec, self.coverage, self.can) else self.stored.query(spec)

    def sql(self, text: str, **args) -> DataFrame:
        return self.stored.sql(text, **args)


@dataclass(frozen=True)
class Rollup:
    """A table made before, with the days it covers (all of them where an end is not given)."""

    rows: DataFrame | None
    first: str | None = None
    last: str | None = None


@dataclass(frozen=True)
class Decision:
    """Which table answers (canonical-rollup, primary or raw), and why others were passed over."""

    source: str
    passed: tuple[str, ...] = field(default=())


def miss(kind: str, rollup: Rollup | None, p: Plan) -> str | None:
    if rollup is None:
        return f"{kind}-missing"
    if rollup.rows is None:
        return f"{kind}-empty"
    if p.first and rollup.first and p.first < rollup.first:
        return f"{kind}-missing-coverage"
    return f"{kind}-stale-coverage" if rollup.last and (not p.last or p.last > rollup.last) else None


def decide(spec: QuerySpec, primary: Rollup | None, canonical: Rollup | None = None, raw_allowed: bool = False) -> Decision:
    """The source of a read.

    Reads by canonical query take the canonical rollup if it covers them and
    they need nothing but canonical queries and dates, else the facts. Others
    take the primary rollup; where that doesn't cover them they raise, as a
    part of the data would pass for all of it, unless raw days are allowed.
    """
    p = planner.plan(spec)
    names = {*p.spec.dimensions, *(leaf.column for leaf in leaves(p.spec.filter))}
    passed: tuple[str, ...] = ()
    if "queryCanonical" in names:
        why = miss("canonical", canonical, p)
        if why is None and not names - {"queryCanonical", "date"} - set(METRICS) and p.spec.prefilter is None and p.spec.minimum_impressions is None and p.spec.search_type is None:
            return Decision("canonical-rollup")
        return Decision("raw", (why or "canonical-not-coverable",))
    why = miss("primary", primary, p)
    if why is None:
        return Decision("primary", passed)
    if raw_allowed:
        return Decision("raw", (*passed, why))
    raise QueryError("source-coverage", why)


def run(lake: Lake, spec: QuerySpec, primary: Rollup | None = None, canonical: Rollup | None = None, raw_allowed: bool = True) -> tuple[DataFrame, Decision]:
    """The page of ``spec`` from the source that ``decide`` names. ``primary`` has the columns of the read's fact table."""
    made = decide(spec, primary, canonical, raw_allowed)
    if made.source == "canonical-rollup":
        lake = replace(lake, canonical_daily=canonical.rows)
    elif made.source == "primary":
        lake = replace(lake, tables=lake.tables | {planner.plan(spec).dataset: primary.rows}, canonical_daily=None)
    else:
        lake = replace(lake, canonical_daily=None)
    return planner.run(lake, spec), made
