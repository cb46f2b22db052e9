"""Reports: analyzers run side by side and boiled down to sections of findings."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import movement, scoring, series

REGISTRY_VERSION = 2


@dataclass(frozen=True)
class Context:
    """What a report reads: facts, devices by date, the period, the one before, and parameters.

    ``params`` may hold ``max_findings``, what a report asks for (brand_terms,
    topic, target, target_kind, min_clicks_change), and under ``options`` the
    options of a step's analyzer by the step's key.
    """

    facts: Any
    period: tuple[str, str]
    before: tuple[str, str] | None
    site: str = ""
    dates: DataFrame | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def options(self, step: str) -> dict[str, Any]:
        return self.params.get("options", {}).get(step, {})


class ReportError(RuntimeError):
    """A step that the report can't do without has failed, or a parameter it needs is missing."""


@dataclass(frozen=True)
class Step:
    """One analyzer of a report. ``order`` says which rows come first (- for the largest); ``limit`` of them reach the driver."""

    key: str
    run: Callable[[Context, dict[str, Any]], DataFrame]
    order: tuple[str, ...]
    limit: int = 100
    required: bool = False


@dataclass(frozen=True)
class Page:
    """The first rows of a step and how many there are in all."""

    rows: list[dict]
    total: int


@dataclass(frozen=True)
class Finding:
    kind: str  # page or query
    entity: str
    metrics: dict[str, Any]
    why: str | None = None
    delta: dict[str, Any] | None = None


@dataclass(frozen=True)
class Section:
    """``total`` counts the rows its findings are the first of; coverage is partial where a step that feeds it has failed."""

    id: str
    title: str
    severity: str  # info, low, medium, high or unknown
    findings: list[Finding] = field(default_factory=list)
    total: int = 0
    label: str | None = None
    delta: float | None = None
    coverage: str = "full"

    @property
    def direction(self) -> str | None:
        return None if self.delta is None else "up" if self.delta > 0 else "down" if self.delta < 0 else "flat"


@dataclass(frozen=True)
class Outline:
    """A section to be made: the steps that feed it, the first one foremost, and the function of their pages that makes it."""

    id: str
    title: str
    feeds: tuple[str, ...]
    make: Callable[[Context, list[Page]], dict[str, Any]]


@dataclass(frozen=True)
class Definition:
    """A report. ``needs`` are parameters it can't do without; ``compares`` that it needs a period before."""

    id: str
    description: str
    steps: tuple[Step, ...]
    outlines: tuple[Outline, ...]
    needs: tuple[str, ...] = ()
    compares: bool = False
    max_findings: int = 5


@dataclass(frozen=True)
class Report:
    id: str
    site: str
    input_hash: str
    sections: list[Section]
    failed: dict[str, str]

    @property
    def degraded(self) -> bool:
        return bool(self.failed)


REPORTS: dict[str, Definition] = {}


def define_report(report: Definition) -> Definition:
    """Register a report, one's own included; steps and outlines must fit together."""
    keys = {s.key for s in report.steps}
    if not report.id or not report.steps or not report.outlines:
        raise ValueError("a report has an id, steps and sections")
    if report.id in REPORTS:
        raise ValueError(f"there is a report {report.id!r}")
    if odd := {f for o in report.outlines for f in o.feeds} - keys:
        raise ValueError(f"no step {', '.join(sorted(odd))} in report {report.id!r}")
    REPORTS[report.id] = report
    return report


def read_step(step: Step, ctx: Context) -> Page | Exception:
    """Rows are computed once, written aside, counted and ranked from there."""
    try:
        rows = staged(step.run(ctx, ctx.options(step.key)))
        # To six places, so that the order of a sum doesn't decide.
        rank = lambda c: F.round(c, 6) if dict(rows.dtypes).get(c) == "double" else F.col(c)
        ways = [rank(o[1:]).desc_nulls_last() if o[0] == "-" else rank(o).asc_nulls_last() for o in step.order]
        return Page([r.asDict(recursive=True) for r in rows.orderBy(*ways).limit(step.limit).collect()], rows.count())
    except Exception as err:
        return err


def input_hash(report_id: str, ctx: Context) -> str:
    told = {"id": report_id, "site": ctx.site, "window": [ctx.period, ctx.before], "params": ctx.params, "version": REGISTRY_VERSION}
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


def run_report(report_id: str, ctx: Context) -> Report:
    """A failed step makes the sections that only it feeds unknown; a required one fails the report."""
    report = REPORTS[report_id]
    for name in report.needs:
        if not ctx.params.get(name):
            raise ReportError(f"the report {report_id} needs {name}")
    if report.compares and not ctx.before:
        raise ReportError(f"the report {report_id} needs a period to compare with")
    with ThreadPoolExecutor(len(report.steps)) as pool:
        pages = dict(zip((s.key for s in report.steps), pool.map(lambda s: read_step(s, ctx), report.steps), strict=True))
    failed = {k: str(p) for k, p in pages.items() if isinstance(p, Exception)}
    for step in report.steps:
        if step.required and step.key in failed:
            raise ReportError(f"{step.key}: {failed[step.key]}") from pages[step.key]
    sections = []
    for o in report.outlines:
        lost = [f for f in o.feeds if f in failed]
        if len(lost) == len(o.feeds):
            sections.append(Section(o.id, o.title, "unknown", label=f"unavailable: {', '.join(lost)} failed", coverage="partial"))
        else:
            made = o.make(ctx, [Page([], 0) if f in failed else pages[f] for f in o.feeds])
            sections.append(Section(o.id, o.title, coverage="partial" if lost else "full", **made))
    return Report(report_id, ctx.site, input_hash(report_id, ctx), sections, failed)


def most(ctx: Context, otherwise: int = 5) -> int:
    return int(ctx.params.get("max_findings", otherwise))


def told(rows: list[dict], kind: str, entity: str, *metrics: str, why=None, prior: str | None = None, now: str | None = None, pct=None) -> list[Finding]:
    """Findings from rows: their metrics by column, why as a function of a row, and a change in clicks."""
    return [
        Finding(
            kind, str(r[entity]), {m: r[m] for m in metrics if r[m] is not None}, why(r) if why else None,
            {"metric": "clicks", "prior": r[prior], "current": r[now], "pct": pct(r)} if prior else None,
        )
        for r in rows
    ]


def summed(rows: list[dict], column: str) -> float:
    return sum(r[column] for r in rows)


def first(kind: str, entity: str, *metrics: str, severity, why=None, label=None, otherwise: int = 5):
    """A section of a step's first rows. ``severity`` and ``label`` are texts or functions of the rows kept."""

    def make(ctx: Context, pages: list[Page]) -> dict[str, Any]:
        kept = pages[0].rows[: most(ctx, otherwise)]
        said = lambda x: x(kept) if callable(x) else x
        return {"severity": said(severity), "findings": told(kept, kind, entity, *metrics, why=why), "total": pages[0].total, "label": said(label)}

    return make


def summary(label: Callable[[Page], str]):
    """A section that only says what its step's rows add up to."""
    return lambda ctx, pages: {"severity": "info", "total": pages[0].total, "label": label(pages[0])}


if_any = lambda level: lambda kept: level if kept else "info"
on_page = lambda r: f"on {r['url']}" if r.get("url") else None

#: Losses in clicks from which a section is high and medium.
LOSSES = {"decliners": (100, 25), "ctr-anomaly": (100, 25), "decay": (200, 50)}


def by_loss(section: str, lost: float, least: str = "low") -> str:
    high, medium = LOSSES[section]
    return "high" if lost >= high else "medium" if lost >= medium else least


def touching(text: str | None, *columns: str):
    """Whether any of the columns holds the text, in any case of letters."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains((text or "").strip().lower()), F.lit(False))
    return found


def needle(ctx: Context) -> str:
    """The target, an address as its path."""
    target = str(ctx.params["target"])
    return re.sub(r"^https?://[^/?#]*", "", target) or "/" if target.startswith("http") else target


# Brand


def brand_terms(ctx: Context) -> list[str]:
    terms = ctx.params["brand_terms"]
    return [t.strip() for t in (terms.split(",") if isinstance(terms, str) else terms) if t.strip()]


def brand_split(ctx: Context, pages: list[Page]) -> dict[str, Any]:
    rows = pages[0].rows
    kept = [r for r in rows if r["segment"] == "brand"][: most(ctx)]
    label = "no summary available"
    if rows:
        b, n = rows[0]["brand_clicks"], rows[0]["non_brand_clicks"]
        label = f"brand share {100 * b / (b + n) if b + n else 0:.1f}% ({b:.0f} brand vs {n:.0f} non-brand clicks)"
    return {"severity": "info", "findings": told(kept, "query", "query", "clicks", "impressions", "ctr", "position", why=on_page), "total": pages[0].total, "label": label}


def top_keywords(ctx: Context, options: dict[str, Any]) -> DataFrame:
    """The queries with most clicks and their share, beside the concentration of all of them."""
    items = scoring.during(ctx.facts.queries, ctx.period).groupBy("query").agg(F.sum("clicks").cast("double").alias("clicks")).where("clicks > 0")
    ranked = items.orderBy(F.desc("clicks"), "query").limit(options.get("top", 10))
    whole = scoring.concentration(ctx.facts, ctx.period, "keywords", **options)
    return whole.join(F.broadcast(ranked), F.lit(True), "left").withColumn("share", F.col("clicks") / F.nullif("total_clicks", F.lit(0.0)))


def concentrated(ctx: Context, pages: list[Page]) -> dict[str, Any]:
    rows = pages[0].rows
    kept = [r for r in rows if r["query"] is not None][: most(ctx)]
    label = f"HHI {rows[0]['hhi']:.0f} ({rows[0]['risk']}); top share {100 * rows[0]['top_share']:.1f}%" if rows else None
    return {"severity": rows[0]["risk"] if rows else "info", "findings": told(kept, "query", "query", "clicks", "share"), "total": len(kept), "label": label}


BRAND_SPLIT = Outline("brand-split", "Brand vs non-brand", ("brand",), brand_split)
define_report(Definition(
    "brand", "Brand against other queries, top brand queries, and how concentrated all queries are.",
    (
        # Brand queries first, so that a limit keeps them.
        Step("brand", lambda c, o: scoring.brand(c.facts, c.period, brand_terms(c), **o), ("segment", "-clicks", "query", "url"), 200, required=True),
        Step("concentration", top_keywords, ("-clicks", "query"), 50),
    ),
    (BRAND_SPLIT, Outline("concentration", "Keyword concentration (site-wide)", ("concentration",), concentrated)),
    needs=("brand_terms",),
))


# Growth


def long_tails(ctx: Context, pages: list[Page]) -> dict[str, Any]:
    rows, kept = pages[0].rows, pages[0].rows[: most(ctx)]
    heavy = sum(r["fingerprint"] == "head-heavy" for r in rows)
    why = lambda r: f"{r['fingerprint']} ({100 * r['head_share']:.0f}% head share)"
    return {
        "severity": "medium" if heavy > len(rows) / 3 else "info", "findings": told(kept, "page", "url", "query_count", "total_impressions", "head_share", why=why),
        "total": len(rows), "label": f"{len(rows)} pages analysed; {heavy} head-heavy",
    }


def tail_steps(ctx: Context, options: dict[str, Any]) -> DataFrame:
    rank = F.when(F.col("fingerprint") == "head-heavy", 0).when(F.col("fingerprint") == "balanced", 1).otherwise(2)
    return scoring.long_tail(ctx.facts, ctx.period, **options).withColumn("rank", rank)


define_report(Definition(
    "growth", "Newly seen queries, queries per page, groups of queries by shared words, and the shape of long tails.",
    (
        Step("content-velocity", lambda c, o: movement.content_velocity(c.facts, c.period, **o), ("week",), 200),
        Step("keyword-breadth", lambda c, o: scoring.keyword_breadth_summary(c.facts, c.period, **o), ("sort_key",), 50),
        Step("intent-atlas", lambda c, o: scoring.intent_atlas(c.facts, c.period, **o), ("-total_impressions", "cluster"), 50),
        Step("long-tail", tail_steps, ("rank", "-head_share", "url"), 100),
    ),
    (
        Outline("content-velocity", "Newly observed search queries", ("content-velocity",), summary(
            lambda p: f"{summed(p.rows, 'new_keywords')} search queries first observed within this window, across {len(p.rows)} weeks (avg {summed(p.rows, 'new_keywords') / max(1, len(p.rows)):.1f}/wk)")),
        Outline("keyword-breadth", "Search queries per page", ("keyword-breadth",), summary(
            lambda p: f"{summed(p.rows, 'page_count')} pages; smallest query-count bucket \"{p.rows[0]['bucket']}\" ({p.rows[0]['page_count']} pages)" if p.rows else "no data")),
        Outline("intent-atlas", "Shared-word query groups", ("intent-atlas",), summary(
            lambda p: f"{len(p.rows)} shared-word groups covering {summed(p.rows, 'keyword_count')} search queries")),
        Outline("long-tail", "Long-tail shape", ("long-tail",), long_tails),
    ),
))


# Health


def anomalies(ctx: Context, pages: list[Page]) -> dict[str, Any]:
    kept = pages[0].rows[: most(ctx)]
    lost = summed(kept, "clicks_lost")
    found = told(kept, "query", "query", "clicks_lost", "breach_days_down", "severity", "baseline_ctr", why=on_page)
    return {"severity": by_loss("ctr-anomaly", lost, "low" if kept else "info"), "findings": found, "total": pages[0].total, "label": f"{lost:.0f} clicks lost vs baseline", "delta": -lost}


def change_points(ctx: Context, options: dict[str, Any]) -> DataFrame:
    """Change points of positions with their change; a position that rises in number has got worse."""
    delta = F.col("right_mean") - F.col("left_mean")
    worse = F.when(delta > 0, "worsened").otherwise("improved")
    return series.change_point(ctx.facts, ctx.period, "position", **options).withColumn("delta", delta).withColumn("direction", worse)


def volatile_pages(ctx: Context, options: dict[str, Any]) -> DataFrame:
    return series.position_volatility(ctx.facts, ctx.period, **options).select("url", "page_volatility", "page_peak", "page_impressions").distinct()


VOLATILE = ("page_volatility", "page_peak", "page_impressions")
define_report(Definition(
    "health", "Click rates that broke down, positions that changed for the worse, and pages whose positions swing.",
    (
        Step("ctr-anomaly", lambda c, o: series.ctr_anomaly(c.facts, c.period, **o).where("breach_days_down > 0"), ("-clicks_lost", "query", "url"), required=True),
        Step("change-point", lambda c, o: change_points(c, o).where("direction = 'worsened'"), ("-llr", "query", "url")),
        Step("position-volatility", volatile_pages, ("-page_peak", "url")),
    ),
    (
        Outline("ctr-anomaly", "CTR anomalies", ("ctr-anomaly",), anomalies),
        Outline("change-point", "Change-points (worsening)", ("change-point",), first(
            "query", "query", "llr", "delta", severity=if_any("medium"), why=lambda r: f"worsened on {r['change_date']} ({r['url']})", label=lambda kept: f"{len(kept)} worsening segments")),
        Outline("position-volatility", "Position volatility", ("position-volatility",), first("page", "url", *VOLATILE, severity=if_any("low"))),
    ),
))


# Movers


def moved(direction: str):
    """Movers of one direction, by how far they moved; those under the least change are left out."""

    def run(ctx: Context, options: dict[str, Any]) -> DataFrame:
        size = F.abs("clicks_change")
        rows = movement.movers(ctx.facts, ctx.period, ctx.before, **options).where(F.col("direction") == direction)
        return rows.where(size >= ctx.params.get("min_clicks_change", 5)).withColumn("size", size)

    return run


def rising(ctx: Context, pages: list[Page]) -> dict[str, Any]:
    kept = pages[0].rows[: most(ctx)]
    found = told(kept, "query", "query", "now_clicks", "clicks_change", "clicks_change_percent", "position_change", why=on_page, prior="before_clicks", now="now_clicks", pct=lambda r: r["clicks_change_percent"])
    return {"severity": "info", "findings": found, "total": pages[0].total, "delta": summed(kept, "clicks_change")}


def lost_pages(rows: list[dict], why=None) -> list[Finding]:
    return told(rows, "page", "url", "now_clicks", "lost_clicks", "decline_percent", why=why, prior="before_clicks", now="now_clicks", pct=lambda r: -100 * r["decline_percent"])


def decliners(ctx: Context, pages: list[Page]) -> dict[str, Any]:
    queries, gone = (p.rows[: most(ctx)] for p in pages)
    lost = summed(queries, "size") + summed(gone, "lost_clicks")
    found = told(queries, "query", "query", "now_clicks", "clicks_change", prior="before_clicks", now="now_clicks", pct=lambda r: r["clicks_change_percent"])
    return {
        "severity": by_loss("decliners", lost), "findings": found + lost_pages(gone, lambda r: "page-level decay"), "total": pages[0].total,
        "label": f"{lost:.0f} clicks lost", "delta": -lost,
    }


def decaying(c: Context, o: dict[str, Any]) -> DataFrame:
    return movement.decay(c.facts, c.period, c.before, **o)


def striking(c: Context, o: dict[str, Any]) -> DataFrame:
    return scoring.striking_distance(c.facts, c.period, **o)


POTENTIAL = ("-potential_clicks", "query", "url")
STRIKING = ("position", "impressions", "clicks", "potential_clicks")
gain = lambda kept: f"{summed(kept, 'potential_clicks'):.0f} potential clicks"
define_report(Definition(
    "movers", "Queries that rise and fall, pages that lose clicks, and queries within striking distance, against a period before.",
    (
        Step("movers-rising", moved("rising"), ("-size", "query", "url"), 200, required=True),
        Step("movers-declining", moved("declining"), ("-size", "query", "url"), 200, required=True),
        Step("decay", decaying, ("-lost_clicks", "url")),
        Step("striking", striking, POTENTIAL),
    ),
    (
        Outline("rising", "Rising queries", ("movers-rising",), rising),
        Outline("decliners", "Decliners", ("movers-declining", "decay"), decliners),
        Outline("striking-distance", "Striking-distance opportunities", ("striking",), first("query", "query", *STRIKING, severity="low", why=lambda r: f"currently {on_page(r)}", label=gain)),
    ),
    compares=True,
))


# Opportunities


def migration(c: Context, o: dict[str, Any]) -> DataFrame:
    return movement.query_migration(c.facts, c.period, c.before, **o)


define_report(Definition(
    "opportunities", "Queries within striking distance, with low click rates for their position, and moving between pages.",
    (
        Step("striking", striking, POTENTIAL, required=True),
        Step("opportunity", lambda c, o: scoring.opportunity(c.facts, c.period, **o), ("-opportunity_score", "query", "url")),
        Step("zero-click", lambda c, o: scoring.zero_click(c.facts, c.period, **o), ("-impressions", "query", "url")),
        Step("query-migration", migration, ("-weight", "source", "target"), 50),
    ),
    (
        Outline("striking-distance", "Striking distance", ("striking",), first("query", "query", *STRIKING, severity="low", why=on_page, label=gain)),
        Outline("low-ctr", "Underperforming CTR", ("opportunity",), first(
            "query", "query", "opportunity_score", "ctr", "position", "impressions", "potential_clicks", severity="low", why=lambda r: f"low CTR {on_page(r)}")),
        Outline("zero-click", "Low-CTR queries", ("zero-click",), first(
            "query", "query", "impressions", "clicks", "position", "ctr", severity="info",
            why=lambda r: f"{100 * r['ctr']:.1f}% CTR at position {r['position']:.1f} {on_page(r)}", label=lambda kept: f"{summed(kept, 'impressions'):.0f} impressions at low CTR")),
        Outline("query-migration", "Query migration", ("query-migration",), first(
            "page", "target", "weight", "query_count", severity="info", why=lambda r: f"migrating from {r['source']}")),
    ),
))


# Pre-publish


def contested(ctx: Context, options: dict[str, Any]) -> DataFrame:
    """Queries that pages compete for, if the query or one of its pages touches the topic."""
    rows = scoring.cannibalization(ctx.facts, ctx.period, **options)
    topic = ctx.params["topic"]
    least = options.get("least", 50)
    pages = scoring.pairs(ctx.facts, ctx.period, least).where(touching(topic, "url")).select("query").distinct()
    return rows.where(touching(topic, "query")).unionByName(rows.where(~touching(topic, "query")).join(pages, "query", "left_semi"))


define_report(Definition(
    "pre-publish", "What already stands for a topic before it is published: competing pages and close rankings.",
    (
        Step("cannibalization", contested, ("-total_clicks", "query")),
        Step("striking", lambda c, o: striking(c, o).where(touching(c.params["topic"], "query", "url")), POTENTIAL),
    ),
    (
        Outline("cannibalization-risk", "Cannibalization risk", ("cannibalization",), first(
            "query", "query", "competitors", "total_clicks", "total_impressions", severity=if_any("high"), why=lambda r: f"{r['competitors']} page(s) already targeting",
            label=lambda kept: f"{len(kept)} existing competition" if kept else "no existing competition", otherwise=10)),
        Outline("striking-peers", "Existing striking-distance peers", ("striking",), first(
            "query", "query", "position", "impressions", "potential_clicks", severity=if_any("low"), why=lambda r: f"currently {on_page(r)}",
            label=lambda kept: f"{len(kept)} adjacent rankings" if kept else "no adjacent rankings", otherwise=10)),
    ),
    needs=("topic",), max_findings=10,
))


# Risks


def decay_section(ctx: Context, pages: list[Page]) -> dict[str, Any]:
    kept = pages[0].rows[: most(ctx)]
    lost = summed(kept, "lost_clicks")
    return {"severity": by_loss("decay", lost), "findings": lost_pages(kept), "total": pages[0].total, "label": f"{lost:.0f} clicks lost", "delta": -lost}


define_report(Definition(
    "risks", "Pages that decline, pages that compete, clicks without queries, and differences between devices.",
    (
        Step("decay", decaying, ("-lost_clicks", "url"), required=True),
        Step("cannibalization", lambda c, o: scoring.cannibalization(c.facts, c.period, **o), ("-total_clicks", "query"), 50),
        Step("dark-traffic", lambda c, o: scoring.dark_traffic(c.facts, c.period, **o), ("-dark_clicks", "url"), 50),
        Step("device-gap", lambda c, o: series.device_gap_days(c.dates, c.period, **o).withColumn("size", F.abs("position_gap")), ("-size", "date"), 50),
    ),
    (
        Outline("decay", "Decaying pages", ("decay",), decay_section),
        Outline("cannibalization", "Cannibalizing queries", ("cannibalization",), first(
            "query", "query", "competitors", "total_clicks", "total_impressions", severity=if_any("medium"), why=lambda r: f"{r['competitors']} pages competing")),
        Outline("dark-traffic", "Clicks without reported queries", ("dark-traffic",), first(
            "page", "url", "dark_clicks", "dark_percent", "total_clicks", severity=if_any("low"),
            label=lambda kept: f"{summed(kept, 'dark_clicks'):.0f} clicks without reported queries across {len(kept)} shown pages")),
        Outline("device-gap", "Device gap", ("device-gap",), first("page", "date", "position_gap", "ctr_gap", severity="info", why=lambda r: "desktop vs mobile delta")),
    ),
    compares=True,
))


# Triage


def at_target(rows: Callable[[Context, dict[str, Any]], DataFrame], page: tuple[str, ...], query: tuple[str, ...] = ()):
    """Rows that touch the target; none for a kind of target that they don't tell of."""

    def run(ctx: Context, options: dict[str, Any]) -> DataFrame:
        columns = query if ctx.params.get("target_kind", "page") == "query" else page
        return rows(ctx, options).where(touching(needle(ctx), *columns))

    return run


def target_change_points(ctx: Context, pages: list[Page]) -> dict[str, Any]:
    kept = pages[0].rows[: most(ctx, 10)]
    kind = ctx.params.get("target_kind", "page")
    found = told(kept, kind, "url" if kind == "page" else "query", "llr", "delta", why=lambda r: f"{r['direction']} on {r['change_date']}")
    return {"severity": "medium" if kept else "info", "findings": found, "total": pages[0].total, "label": f"{len(kept)} change-point{'s' * (len(kept) != 1)}"}


def of_page(label: Callable[[list[dict]], str], make):
    """A section that says nothing of a query."""

    def made(ctx: Context, pages: list[Page]) -> dict[str, Any]:
        out = make(ctx, pages)
        shown = pages[0].rows[: most(ctx, 10)]
        return out | {"label": "not for query targets" if ctx.params.get("target_kind") == "query" else label(shown)}

    return made


define_report(Definition(
    "triage", "Change points, query migration and swings of position of one page or query.",
    (
        Step("change-point", at_target(change_points, ("url",), ("query",)), ("-llr", "query", "url"), 200),
        Step("query-migration", at_target(migration, ("source", "target")), ("-weight", "source", "target"), 200),
        Step("position-volatility", at_target(volatile_pages, ("url",)), ("-page_peak", "url"), 200),
    ),
    (
        Outline("change-point", "Change-points", ("change-point",), target_change_points),
        Outline("query-migration", "Query migration", ("query-migration",), of_page(
            lambda kept: f"{len(kept)} migration edges touching target",
            first("page", "target", "weight", "query_count", severity="info", why=lambda r: f"from {r['source']}", otherwise=10))),
        Outline("position-volatility", "Position volatility", ("position-volatility",), of_page(
            lambda kept: f"{len(kept)} volatile page{'s' * (len(kept) != 1)}", first("page", "url", *VOLATILE, severity=if_any("low"), otherwise=10))),
    ),
    needs=("target",), max_findings=10,
))


def as_rows(report: Report) -> list[tuple[str, str, str, int, str | None, str]]:
    """(report, section, severity, total, label, findings as JSON) of each section."""
    return [(report.id, s.id, s.severity, s.total, s.label, json.dumps([asdict(f) for f in s.findings], default=str, sort_keys=True)) for s in report.sections]


def finding_rows(report: Report) -> list[tuple[str, str, int, int, str | None, str | None, float | None]]:
    """(section, severity, total, rank, kind, entity, value) of each finding, the value being its first metric; rank 0 for a section without any."""
    out = []
    for s in report.sections:
        for rank, f in enumerate(s.findings, 1):
            out.append((s.id, s.severity, s.total, rank, f.kind, f.entity, float(next(iter(f.metrics.values())))))
        if not s.findings:
            out.append((s.id, s.severity, s.total, 0, None, None, None))
    return out


def as_dict(report: Report) -> dict:
    return asdict(report)
