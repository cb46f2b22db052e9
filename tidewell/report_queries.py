"""The reports as queries over the test tables, each with SQL for its findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analyzer_queries as A
from .analyzer_queries import BEFORE, MONTH, NOW, SHORT, SPARSE, WHOLE, Query, inside, rounded
from .operators import reports
from .operators.movement import either
from .sources import facts
from .sources.staging import staged

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Floors on impressions that fit a year of the test tables.
LEAST = {"least": 20}
ASKED = {
    "brand": {"brand_terms": "red, Green."},
    "growth": {"options": {"long-tail": {"fewest": 4}}},
    "health": {"options": {"ctr-anomaly": {"days": 1}, "change-point": {"threshold": 2.0}}},
    "movers": {"options": {"striking": LEAST}},
    "opportunities": {"options": {"striking": LEAST, "opportunity": LEAST, "zero-click": {"least": 30, "below_ctr": 0.035}}},
    "pre-publish": {"topic": "Red", "options": {"cannibalization": LEAST, "striking": LEAST}},
    "risks": {"options": {"cannibalization": LEAST}},
    "triage": {"target": "https://s.example/click", "options": {"change-point": {"threshold": 2.0}}},
}
FACTS = {"growth": facts.long, "health": facts.dense, "triage": facts.dense}


def query(name: str) -> Query:
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind = FACTS.get(name, facts.sparse)
        period, before = (MONTH, ("2023-12-01", "2023-12-31")) if kind is facts.dense else (NOW, BEFORE)
        # The steps all look at these periods, so their facts are made once.
        rows = either(kind(spark, sf_dir).page_queries, period, before)
        ctx = reports.Context(facts.Facts(staged(rows)), period, before, "s.example", facts.device_dates(spark, sf_dir), ASKED[name])
        rows = reports.finding_rows(reports.run_report(name, ctx))
        return rounded(spark.createDataFrame(rows, "section string, severity string, total long, rank int, kind string, entity string, value double"))

    return made


def analyzer(name: str, *changes: tuple[str, str]) -> str:
    """The SQL of an analyzer over the year that the reports look at, with other floors."""
    sql = A.SQL[name]
    for period in (WHOLE, SHORT):
        sql = sql.replace(inside(period), inside(NOW))
    for old, new in changes:
        if old not in sql:
            raise ValueError(f"{name} has no {old!r}")
        sql = sql.replace(old, new)
    return sql


def section(name: str, sql: str, order: str, kind: str, entity: str, value: str, severity: str = "'info'", keep: int = 5, where: str = "true") -> str:
    """One row for each of the first rows of ``sql``, or one of rank 0. ``severity`` is an aggregate over p, whose rk <= keep are kept."""
    return f"""SELECT * FROM (WITH p AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rk FROM ({sql}) WHERE {where}), s AS (SELECT {severity} AS severity, count(*) AS total FROM p)
    SELECT '{name}' AS section, s.severity, s.total, CAST(rk AS INTEGER) AS rank, '{kind}' AS kind, CAST({entity} AS VARCHAR) AS entity, round(CAST({value} AS DOUBLE), 6) + 0.0 AS value FROM p, s WHERE rk <= {keep}
    UNION ALL SELECT '{name}', severity, total, 0, NULL, NULL, NULL FROM s WHERE total = 0)"""


def told(name: str, sql: str, total: str = "count(*)") -> str:
    """A section without findings."""
    return f"SELECT '{name}' AS section, 'info' AS severity, {total} AS total, 0 AS rank, NULL AS kind, NULL AS entity, NULL AS value FROM ({sql})"


def losses(column: str, high: int, medium: int, least: str = "'low'", keep: int = 5) -> str:
    lost = f"coalesce(sum({column}) FILTER (WHERE rk <= {keep}), 0)"
    return f"CASE WHEN {lost} >= {high} THEN 'high' WHEN {lost} >= {medium} THEN 'medium' ELSE {least} END"


if_any = lambda level: f"CASE WHEN count(*) > 0 THEN '{level}' ELSE 'info' END"
PAIRS_20 = (">= 100", ">= 20")
CLASH = analyzer("cannibalization", (">= 100", ">= 40"), (">= 50", ">= 20"))
CLOSE = analyzer("striking_distance", PAIRS_20)
BY_POTENTIAL = "potential_clicks DESC, query, url"
brand = analyzer("brand")
conc = analyzer("concentration_keywords")
SQL["report_brand"] = f"""{section('brand-split', brand, 'segment, clicks DESC, query, url', 'query', 'query', 'clicks').replace('rk <= 5', "rk <= 5 AND segment = 'brand'")}
UNION ALL SELECT * FROM (WITH {SPARSE}, c AS ({conc}), k AS (SELECT query, CAST(sum(clicks) AS DOUBLE) AS clicks FROM sparse WHERE {inside(NOW)} GROUP BY query HAVING sum(clicks) > 0),
    r AS (SELECT *, row_number() OVER (ORDER BY clicks DESC, query) AS rk FROM k)
    SELECT 'concentration' AS section, risk AS severity, 5 AS total, CAST(rk AS INTEGER) AS rank, 'query' AS kind, query AS entity, clicks AS value FROM r, c WHERE rk <= 5)"""
tail = analyzer("long_tail")
HEAVY = "CASE WHEN count(*) FILTER (WHERE fingerprint = 'head-heavy' AND rk <= 100) > least(count(*), 100) / 3.0 THEN 'medium' ELSE 'info' END"
breadth = analyzer("keyword_breadth_summary", (SPARSE, A.LONG), ("FROM sparse", "FROM long"))
SQL["report_growth"] = " UNION ALL ".join([
    told("content-velocity", analyzer("content_velocity")), told("keyword-breadth", breadth), told("intent-atlas", analyzer("intent_atlas")),
    section("long-tail", tail, "CASE fingerprint WHEN 'head-heavy' THEN 0 WHEN 'balanced' THEN 1 ELSE 2 END, head_share DESC, url", "page", "url", "query_count", HEAVY).replace("count(*) AS total", "least(count(*), 100) AS total"),
])
swings = f"SELECT DISTINCT url, page_volatility, page_peak, page_impressions FROM ({A.SQL['position_volatility']})"
turns = A.SQL["change_point_position"]
SQL["report_health"] = " UNION ALL ".join([
    section("ctr-anomaly", A.SQL["ctr_anomaly"], "clicks_lost DESC, query, url", "query", "query", "clicks_lost", losses("clicks_lost", 100, 25, "CASE WHEN count(*) > 0 THEN 'low' ELSE 'info' END"), where="breach_days_down > 0"),
    section("change-point", turns, "llr DESC, query, url", "query", "query", "llr", if_any("medium"), where="right_mean > left_mean"),
    section("position-volatility", swings, "page_peak DESC, url", "page", "url", "page_volatility", if_any("low")),
])
change = lambda way: f"SELECT *, abs(clicks_change) AS size FROM ({A.SQL['movers']}) WHERE direction = '{way}' AND abs(clicks_change) >= 5"
decay = A.SQL["decay"]
fall = f"""SELECT 'decliners' AS section, (SELECT CASE WHEN lost >= 100 THEN 'high' WHEN lost >= 25 THEN 'medium' ELSE 'low' END FROM l) AS severity, (SELECT count(*) FROM m) AS total, CAST(row_number() OVER (ORDER BY part, rk) AS INTEGER) AS rank,
      kind, entity, value FROM (SELECT 1 AS part, rk, 'query' AS kind, query AS entity, now_clicks AS value FROM m WHERE rk <= 5 UNION ALL SELECT 2, rk, 'page', url, now_clicks FROM d WHERE rk <= 5)"""
SQL["report_movers"] = f"""{section('rising', change('rising'), 'size DESC, query, url', 'query', 'query', 'now_clicks')}
UNION ALL SELECT * FROM (WITH m AS (SELECT *, row_number() OVER (ORDER BY size DESC, query, url) AS rk FROM ({change('declining')})), d AS (SELECT *, row_number() OVER (ORDER BY lost_clicks DESC, url) AS rk FROM ({decay})),
    l AS (SELECT (SELECT coalesce(sum(size), 0) FROM m WHERE rk <= 5) + (SELECT coalesce(sum(lost_clicks), 0) FROM d WHERE rk <= 5) AS lost) {fall})
UNION ALL {section('striking-distance', CLOSE, BY_POTENTIAL, 'query', 'query', 'position', "'low'")}"""
SQL["report_opportunities"] = " UNION ALL ".join([
    section("striking-distance", CLOSE, BY_POTENTIAL, "query", "query", "position", "'low'"),
    section("low-ctr", analyzer("opportunity", PAIRS_20), "opportunity_score DESC, query, url", "query", "query", "opportunity_score", "'low'"),
    section("zero-click", analyzer("zero_click", (">= 500", ">= 30")), "impressions DESC, query, url", "query", "query", "impressions"),
    section("query-migration", analyzer("query_migration"), "weight DESC, source, target", "page", "target", "weight"),
])
seen = f"SELECT query FROM (WITH {SPARSE} {A.pair_sql('sparse', NOW, 20)}) WHERE contains(lower(url), 'red')"
SQL["report_pre_publish"] = " UNION ALL ".join([
    section("cannibalization-risk", CLASH, "total_clicks DESC, query", "query", "query", "competitors", if_any("high"), 10, f"contains(lower(query), 'red') OR query IN ({seen})"),
    section("striking-peers", CLOSE, BY_POTENTIAL, "query", "query", "position", if_any("low"), 10, "contains(lower(query), 'red') OR contains(lower(url), 'red')"),
])
SQL["report_risks"] = " UNION ALL ".join([
    section("decay", decay, "lost_clicks DESC, url", "page", "url", "now_clicks", losses("lost_clicks", 200, 50)),
    section("cannibalization", CLASH, "total_clicks DESC, query", "query", "query", "competitors", if_any("medium")),
    told("dark-traffic", "SELECT 1", "0"),
    section("device-gap", analyzer("device_gap_days"), "round(abs(position_gap), 6) DESC, date", "page", "date", "position_gap"),
])
SQL["report_triage"] = " UNION ALL ".join([
    section("change-point", turns, "llr DESC, query, url", "page", "url", "llr", if_any("medium"), 10, "contains(lower(url), '/click')"),
    # Nothing was seen in the month before, so nothing has moved.
    told("query-migration", "SELECT 1", "0"),
    section("position-volatility", swings, "page_peak DESC, url", "page", "url", "page_volatility", if_any("low"), 10, "contains(lower(url), '/click')"),
])
for name in reports.REPORTS:
    QUERIES[f"report_{name.replace('-', '_')}"] = query(name)
