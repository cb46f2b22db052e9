import datetime as dt

import pytest

from tidewell.operators import reports
from tidewell.operators.reports import Definition, Outline, Step, define_report
from tidewell.sources.facts import Facts

DAY = dt.date(2024, 1, 1)
PAIRS = "url string, query string, date date, clicks int, impressions int, sum_position double"


def context(spark, rows, **params):
    return reports.Context(Facts(spark.createDataFrame(rows, PAIRS)), ("2024-01-01", "2024-01-31"), ("2023-12-01", "2023-12-31"), params=params)


def test_failed_steps_are_unknown_and_required_ones_fail(spark):
    ctx = context(spark, [("/a", "red", DAY, 1, 200, 2000.0)], brand_terms=["red"])
    risks = reports.run_report("risks", ctx)
    found = {s.id: s for s in risks.sections}
    assert found["device-gap"].severity == "unknown" and found["device-gap"].coverage == "partial" and risks.degraded and "device-gap" in risks.failed
    assert found["decay"].severity == "low" and found["decay"].direction == "flat" and found["cannibalization"].severity == "info"
    striking = {s.id: s for s in reports.run_report("opportunities", ctx).sections}["striking-distance"]
    assert striking.total == 1 and striking.findings[0].entity == "red" and striking.findings[0].why == "on /a"
    with pytest.raises(reports.ReportError, match="needs brand_terms"):
        reports.run_report("brand", context(spark, []))
    with pytest.raises(reports.ReportError, match="compare"):
        reports.run_report("movers", reports.Context(ctx.facts, ctx.period, None))
    with pytest.raises(reports.ReportError, match="brand"):
        reports.run_report("brand", reports.Context(None, ctx.period, None, params={"brand_terms": "red"}))
    assert reports.input_hash("risks", ctx) != reports.input_hash("brand", ctx)


def test_severities_by_loss(spark):
    before = DAY - dt.timedelta(10)
    for lost, level in ((40, "low"), (60, "medium"), (250, "high")):
        rows = [("/a", "q", before, lost + 10, 1000, 0.0), ("/a", "q", DAY, 10, 1000, 0.0), ("/b", "r", before, 1, 100, 0.0), ("/b", "r", DAY, 9, 100, 0.0)]
        found = {s.id: s for s in reports.run_report("risks", context(spark, rows)).sections}["decay"]
        assert (found.severity, found.delta, found.direction) == (level, -lost, "down")
    found = {s.id: s for s in reports.run_report("movers", context(spark, rows)).sections}
    assert found["rising"].severity == "info" and [f.entity for f in found["rising"].findings] == ["r"] and found["rising"].direction == "up"
    # 250 clicks of the query and 250 of its page.
    assert found["decliners"].severity == "high" and found["decliners"].delta == -500 and [f.kind for f in found["decliners"].findings] == ["query", "page"]
    few = {s.id: s for s in reports.run_report("movers", context(spark, rows, min_clicks_change=9)).sections}
    assert few["rising"].findings == []


def test_findings_are_bounded_and_totals_are_not(spark):
    rows = [(f"/p{i}", f"query {i}", DAY, 1, 200 + 20 * i, 2000.0) for i in range(12)]
    found = {s.id: s for s in reports.run_report("opportunities", context(spark, rows)).sections}["striking-distance"]
    assert len(found.findings) == 5 and found.total == 12 and found.findings[0].entity == "query 11"
    found = {s.id: s for s in reports.run_report("opportunities", context(spark, rows, max_findings=2)).sections}["striking-distance"]
    assert len(found.findings) == 2
    assert {r[3] for r in reports.finding_rows(reports.run_report("opportunities", context(spark, []))) if r[0] != "none"} == {0}


def test_targets_are_paths_or_queries(spark):
    ctx = context(spark, [("/a", "red", DAY, 1, 200, 0.0)], target="https://x.example/a?b")
    assert reports.needle(ctx) == "/a?b" and reports.needle(context(spark, [], target="https://x.example")) == "/" and reports.needle(context(spark, [], target="red")) == "red"
    found = {s.id: s for s in reports.run_report("triage", context(spark, [("/a", "red", DAY, 1, 200, 0.0)], target="red", target_kind="query")).sections}
    assert found["query-migration"].label == "not for query targets" and found["change-point"].severity == "info"


def test_own_report(spark):
    mine = Definition("mine", "Pages.", (Step("pages", lambda c, o: c.facts.pages, ("-clicks", "url")),), (Outline("top", "Top pages", ("pages",), reports.first("page", "url", "clicks", severity="info")),))
    define_report(mine)
    try:
        made = reports.run_report("mine", context(spark, [("/a", "q", DAY, 1, 2, 0.0), ("/b", "q", DAY, 5, 2, 0.0)]))
        assert [f.entity for f in made.sections[0].findings] == ["/b", "/a"] and reports.as_dict(made)["id"] == "mine" and len(reports.as_rows(made)) == 1
        for bad in (mine, Definition("", "", mine.steps, mine.outlines), Definition("odd", "", mine.steps, (Outline("x", "X", ("none",), mine.outlines[0].make),))):
            with pytest.raises(ValueError):
                define_report(bad)
    finally:
        del reports.REPORTS["mine"]
