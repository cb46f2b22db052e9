import datetime as dt

import pytest

from tidewell.operators import registry, summaries
from tidewell.sources.facts import Facts


def test_every_analyzer_is_registered():
    assert len(registry.ANALYZERS) == 30
    with pytest.raises(ValueError):
        registry.register(registry.Analyzer("brand", print))


def test_own_analyzer_and_dispatch(spark):
    pq = spark.createDataFrame([("/a", "red", dt.date(2024, 1, 1), 1, 200, 2000.0)], "url string, query string, date date, clicks int, impressions int, sum_position double")
    assert registry.analyze("striking-distance", Facts(pq), period=("2024-01-01", "2024-01-31")).count() == 1
    registry.register(registry.Analyzer("mine", lambda f, **_: f.pages))
    assert registry.analyze("mine", Facts(pq)).count() == 1
    del registry.ANALYZERS["mine"]
    with pytest.raises(KeyError):
        registry.analyze("mine", None)


def test_trends():
    assert summaries.velocity_trend([10, 10, 20, 20]) == "accelerating" and summaries.velocity_trend([20, 20, 10, 10]) == "decelerating"
    assert summaries.velocity_trend([10, 10, 11]) == "stable" == summaries.velocity_trend([])
    assert summaries.gap_trend(-0.05, 0.01) == "improving" and summaries.gap_trend(0.01, -0.05) == "worsening" and summaries.gap_trend(0.1, 0.1) == "stable"


def test_median_of_a_survival_curve(spark):
    curve = spark.createDataFrame([("a", 1, 0.9), ("a", 3, 0.6), ("a", 5, 0.4), ("b", 2, 0.8), ("c", 4, 0.25)], "cohort string, tenure int, survival double")
    got = {r.cohort: r.median_tenure for r in summaries.survival_median(curve).collect()}
    assert abs(got["a"] - 4.0) < 1e-9 and got["b"] is None and abs(got["c"] - 4 * 0.5 / 0.75) < 1e-9
