"""All analyzers by id, and a way to add one's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..plans import planner
from . import graph, movement, scoring, series


@dataclass(frozen=True)
class Analyzer:
    """``run(source, **parameters)``; ``source`` names what that is: facts, dates (with device columns), days or a lake."""

    id: str
    run: Callable[..., DataFrame]
    source: str = "facts"
    compares: bool = False


ANALYZERS: dict[str, Analyzer] = {}


def register(analyzer: Analyzer) -> Analyzer:
    if analyzer.id in ANALYZERS:
        raise ValueError(f"there is an analyzer {analyzer.id!r}")
    ANALYZERS[analyzer.id] = analyzer
    return analyzer


for _id, _run in {
    "striking-distance": scoring.striking_distance, "opportunity": scoring.opportunity, "zero-click": scoring.zero_click, "brand": scoring.brand,
    "cannibalization": scoring.cannibalization, "clustering": scoring.clustering, "concentration": scoring.concentration, "seasonality": series.seasonality,
    "trends": movement.trends, "ctr-anomaly": series.ctr_anomaly, "position-volatility": series.position_volatility, "long-tail": scoring.long_tail,
    "intent-atlas": scoring.intent_atlas, "bayesian-ctr": scoring.bayesian_ctr, "stl-decompose": series.stl_decompose, "change-point": series.change_point,
    "bipartite-pagerank": graph.bipartite_pagerank, "survival": series.survival, "position-distribution": scoring.position_distribution,
    "ctr-curve": scoring.ctr_curve, "dark-traffic": scoring.dark_traffic, "content-velocity": movement.content_velocity, "keyword-breadth": scoring.keyword_breadth,
}.items():
    register(Analyzer(_id, _run))
for _id, _run in {"movers": movement.movers, "decay": movement.decay, "query-migration": movement.query_migration}.items():
    register(Analyzer(_id, _run, compares=True))
register(Analyzer("device-gap", series.device_gap, "dates"))
register(Analyzer("trajectory", series.trajectory, "days"))
register(Analyzer("data-query", planner.run, "lake"))
register(Analyzer("data-detail", planner.detail, "lake"))


def analyze(analyzer_id: str, source: Any, **parameters: Any) -> DataFrame:
    if analyzer_id not in ANALYZERS:
        raise KeyError(f"no analyzer {analyzer_id!r}")
    return ANALYZERS[analyzer_id].run(source, **parameters)
