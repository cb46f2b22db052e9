"""Query specifications: dimensions, metrics, a tree of filters, order and paging, checked before planning."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field, replace
from typing import Any

from ..metrics import METRICS
from ..schemas import SEARCH_TYPES

DIMENSIONS = ("query", "brandedClassification", "queryCanonical", "page", "country", "device", "searchAppearance", "date", "hour")
TIME_DIMENSIONS = ("date", "hour")
INVERSE = {"equals": "notEquals", "contains": "notContains", "regex": "notRegex"}
INVERSE |= {v: k for k, v in INVERSE.items()}


class QueryError(ValueError):
    """A specification that can't be answered; ``kind`` says why."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Leaf:
    """One condition. On a dimension it filters rows, on a metric groups, on ``date`` it moves the period."""

    column: str
    op: str
    value: Any
    upper: Any = None


@dataclass(frozen=True)
class Group:
    kind: str  # "and" or "or"
    parts: tuple[Leaf | Group, ...]


Filter = Leaf | Group


def eq(column: str, value: str) -> Leaf:
    return Leaf(column, "equals", value)


def ne(column: str, value: str) -> Leaf:
    return Leaf(column, "notEquals", value)


def contains(column: str, value: str) -> Leaf:
    return Leaf(column, "contains", value)


def not_contains(column: str, value: str) -> Leaf:
    return Leaf(column, "notContains", value)


def regex(column: str, value: str) -> Leaf:
    return Leaf(column, "regex", value)


def not_regex(column: str, value: str) -> Leaf:
    return Leaf(column, "notRegex", value)


def like(column: str, value: str) -> Leaf:
    """% and _ match anywhere in the value, not only from its ends; without them it is ``contains``."""
    if "%" not in value and "_" not in value:
        return contains(column, value)
    special = r"\.^$*+?{}[]|()"
    out = "".join(".*" if c == "%" else "." if c == "_" else "\\" + c if c in special else c for c in value)
    return regex(column, out)


def in_array(column: str, values: list[str]) -> Filter:
    if not values:
        raise QueryError("invalid-filter", f"inArray on {column} needs a value")
    return Group("or", tuple(eq(column, v) for v in values)) if len(values) > 1 else eq(column, values[0])


def gte(column: str, value: Any) -> Leaf:
    return Leaf(column, "gte", value)


def gt(column: str, value: Any) -> Leaf:
    return Leaf(column, "gt", value)


def lte(column: str, value: Any) -> Leaf:
    return Leaf(column, "lte", value)


def lt(column: str, value: Any) -> Leaf:
    return Leaf(column, "lt", value)


def between(column: str, low: Any, high: Any) -> Leaf:
    return Leaf(column, "between", low, high)


def top_level() -> Leaf:
    """Pages whose path has one slash at most."""
    return Leaf("page", "topLevel", None)


def and_(*parts: Filter) -> Group:
    flat: list[Filter] = []
    for p in parts:
        flat += p.parts if isinstance(p, Group) and p.kind == "and" else [p]
    return Group("and", tuple(flat))


def or_(*parts: Filter) -> Group:
    for p in parts:
        if isinstance(p, Group):
            raise QueryError("invalid-filter", "or() takes single conditions")
        if p.column in ("date", "searchType"):
            raise QueryError("invalid-filter", f"or() can't hold a condition on {p.column}")
    if len({p.column in METRICS for p in parts}) > 1:
        raise QueryError("invalid-filter", "or() can't join conditions on rows with conditions on groups")
    return Group("or", parts)


def not_(part: Filter) -> Leaf:
    if isinstance(part, Group) or part.op not in INVERSE:
        raise QueryError("invalid-filter", "not() takes one condition on a dimension")
    return replace(part, op=INVERSE[part.op])


@dataclass(frozen=True)
class QuerySpec:
    dimensions: tuple[str, ...] = ()
    metrics: tuple[str, ...] = METRICS
    filter: Filter | None = None
    prefilter: Filter | None = None
    order_by: tuple[str, str] = ("clicks", "desc")
    limit: int = 100
    offset: int = 0
    search_type: str | None = None
    minimum_impressions: float | None = None

    def checked(self) -> QuerySpec:
        for d in self.dimensions:
            if d not in DIMENSIONS:
                raise QueryError("unknown-dimension", f"no dimension {d!r}")
        for m in (*self.metrics, *({self.order_by[0]} - {"date"})):
            if m not in METRICS:
                raise QueryError("unknown-metric", f"no metric {m!r}")
        if self.order_by[1] not in ("asc", "desc"):
            raise QueryError("invalid-order", f"no direction {self.order_by[1]!r}")
        if self.limit < 1 or self.offset < 0:
            raise QueryError("invalid-page", "a limit is 1 at least, an offset 0")
        if self.search_type is not None and self.search_type not in SEARCH_TYPES:
            raise QueryError("unknown-search-type", f"no search type {self.search_type!r}")
        if self.minimum_impressions is not None and not (math.isfinite(self.minimum_impressions) and self.minimum_impressions >= 0):
            raise QueryError("invalid-filter", "minimum_impressions must be finite and not negative")
        for leaf in (*leaves(self.filter), *leaves(self.prefilter)):
            check_leaf(leaf)
        for leaf in leaves(self.prefilter):
            if leaf.column not in METRICS:
                raise QueryError("invalid-filter", f"a prefilter takes conditions on metrics, not on {leaf.column}")
        check_groups(self.filter)
        return replace(self, metrics=self.metrics or METRICS)


def leaves(f: Filter | None) -> list[Leaf]:
    if f is None:
        return []
    return [f] if isinstance(f, Leaf) else [x for p in f.parts for x in leaves(p)]


def check_leaf(leaf: Leaf) -> None:
    if leaf.column == "date":
        for v in (leaf.value, leaf.upper):
            if v is not None:
                try:
                    dt.date.fromisoformat(str(v))
                except ValueError:
                    raise QueryError("invalid-date", f"{v!r} is no calendar date") from None
    elif leaf.column in METRICS:
        for v in (leaf.value, leaf.upper):
            if v is not None and not (isinstance(v, (int, float)) and math.isfinite(v)):
                raise QueryError("invalid-filter", f"{v!r} is no finite number")
    elif leaf.column == "searchType":
        if leaf.op != "equals" or leaf.value not in SEARCH_TYPES:
            raise QueryError("unknown-search-type", f"no search type {leaf.value!r}")
    elif leaf.column not in DIMENSIONS:
        raise QueryError("unknown-dimension", f"no column {leaf.column!r}")


def check_groups(f: Filter | None) -> None:
    """An OR over rows and groups has no one place to be answered, so it is refused, never answered as AND."""
    if isinstance(f, Group):
        kinds = {"group" if leaf.column in METRICS else leaf.column if leaf.column in ("date", "searchType") else "row" for leaf in leaves(f)}
        if f.kind == "or" and (len(kinds) > 1 or kinds & {"date", "searchType"}):
            raise QueryError("invalid-filter", "an or() takes conditions on rows alone or on groups alone")
        for p in f.parts:
            check_groups(p)


def search_type_of(f: Filter | None) -> str | None:
    """The search type that a filter asks for: the last one of the outer scope, else the first of the groups inside."""
    if isinstance(f, Leaf):
        return f.value if f.column == "searchType" else None
    parts = f.parts if f else ()
    outer = [v for p in parts if isinstance(p, Leaf) and (v := search_type_of(p))]
    inner = [v for p in parts if isinstance(p, Group) and (v := search_type_of(p))]
    return outer[-1] if outer else inner[0] if inner else None


def period_of(f: Filter | None) -> tuple[str | None, str | None]:
    """The first and last day that date conditions leave; of several the last one in the outer scope holds."""
    first = last = None

    def walk(part: Filter | None) -> None:
        nonlocal first, last
        if isinstance(part, Group):
            for p in sorted(part.parts, key=lambda p: isinstance(p, Leaf)):  # nested groups first, so the outer scope wins
                walk(p)
        elif isinstance(part, Leaf) and part.column == "date":
            day = dt.date.fromisoformat(str(part.value))
            if part.op in ("gte", "between", "equals"):
                first = day
            elif part.op == "gt":
                first = day + dt.timedelta(1)
            if part.op in ("lte", "equals"):
                last = day
            elif part.op == "lt":
                last = day - dt.timedelta(1)
            elif part.op == "between":
                last = dt.date.fromisoformat(str(part.upper))

    walk(f)
    return first and first.isoformat(), last and last.isoformat()


@dataclass(frozen=True)
class Builder:
    """Chained form: ``select("page").where(gte("date", "1998-01-01")).order_by("clicks").limit(10)``."""

    spec: QuerySpec = field(default_factory=QuerySpec)

    def where(self, *parts: Filter) -> Builder:
        old = (self.spec.filter,) if self.spec.filter else ()
        return Builder(replace(self.spec, filter=and_(*old, *parts)))

    def prefilter(self, *parts: Filter) -> Builder:
        return Builder(replace(self.spec, prefilter=and_(*parts)))

    def order_by(self, column: str, direction: str = "desc") -> Builder:
        return Builder(replace(self.spec, order_by=(column, direction)))

    def limit(self, n: int) -> Builder:
        return Builder(replace(self.spec, limit=n))

    def offset(self, n: int) -> Builder:
        return Builder(replace(self.spec, offset=n))


def select(*names: str) -> Builder:
    """Dimensions and metrics by name; without metrics all four."""
    dims, metrics = tuple(n for n in names if n not in METRICS), tuple(n for n in names if n in METRICS)
    return Builder(QuerySpec(dimensions=dims, metrics=metrics or METRICS))
