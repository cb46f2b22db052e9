"""Periods and what of them is covered."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DAY = dt.timedelta(1)


@dataclass(frozen=True)
class Period:
    first: dt.date
    last: dt.date

    @property
    def days(self) -> int:
        return (self.last - self.first).days + 1

    def previous(self) -> Period:
        """The period of equal length right before."""
        return Period(self.first - self.days * DAY, self.first - DAY)

    def year_before(self) -> Period:
        """The same weekdays 52 weeks before."""
        return Period(self.first - 364 * DAY, self.last - 364 * DAY)


def default_period(today: dt.date) -> Period:
    """What a read takes that names no period: 29 days up to three days ago, as later days are not final."""
    return Period(today - 31 * DAY, today - 3 * DAY)


def preset(name: str, today: dt.date) -> Period:
    """last-7d and the like, mtd, qtd, ytd, last-month and last-quarter, up to the day before ``today``."""
    end = today - DAY
    quarter = dt.date(today.year, 3 * ((today.month - 1) // 3) + 1, 1)
    if name.startswith("last-") and name.endswith("d"):
        return Period(today - int(name[5:-1]) * DAY, end)
    first = {"mtd": today.replace(day=1), "qtd": quarter, "ytd": dt.date(today.year, 1, 1)}
    if name in first:
        return Period(first[name], end)
    if name == "last-month":
        last = today.replace(day=1) - DAY
        return Period(last.replace(day=1), last)
    if name == "last-quarter":
        last = quarter - DAY
        return Period(dt.date(last.year, 3 * ((last.month - 1) // 3) + 1, 1), last)
    raise ValueError(f"no period {name!r}")


def spans(dates: list[dt.date], longest: int | None = None) -> list[Period]:
    """Runs of following days, cut after ``longest`` days."""
    out: list[Period] = []
    for d in sorted(set(dates)):
        if out and d == out[-1].last + DAY and (longest is None or out[-1].days < longest):
            out[-1] = Period(out[-1].first, d)
        else:
            out.append(Period(d, d))
    return out


def gaps(period: Period, covered: list[Period]) -> list[Period]:
    """Runs of the period's days that no covered period holds."""
    days = [period.first + i * DAY for i in range(period.days)]
    return spans([d for d in days if not any(c.first <= d <= c.last for c in covered)])


def islands(days: DataFrame, *keys: str) -> DataFrame:
    """Runs of following days by key, from (keys, date): first_day, last_day, days."""
    by = W.partitionBy(*keys).orderBy("date")
    runs = days.select(*keys, "date").distinct().withColumn("run", F.date_sub("date", F.row_number().over(by)))
    return runs.groupBy(*keys, "run").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("days")).drop("run")


def routes_to_live(period: Period, covered: list[Period]) -> bool:
    """Whether a read must go to the live source: nothing is stored, it begins before or ends after what is, or days in between lack."""
    return not covered or bool(gaps(period, covered))
