import datetime as dt
import hashlib
import random

from tidewell.plans.coverage import coverage, verdict

DAYS = "table string, date date"


def day(n):
    return dt.date(2024, 3, 1) + dt.timedelta(n)


def plan(spark, held, tables, first=0, last=29):
    rows = [(t, day(n)) for t, ns in held.items() for n in ns]
    return coverage(spark.createDataFrame(rows, DAYS), tables, day(first).isoformat(), day(last).isoformat())


def told(spans):
    return sorted((r.table, r.kind, (r.first_day - day(0)).days, (r.last_day - day(0)).days, r.days) for r in spans.collect())


def test_runs_and_gaps(spark):
    held = {"pages": [0, 1, 2, 5, 5, 6, 29, 35, -4], "queries": range(-3, 40), "other": [1]}
    got = told(plan(spark, held, {"pages": True, "queries": False, "none": True}))
    assert got == [
        ("none", "gap", 0, 29, 30), ("pages", "covered", 0, 2, 3), ("pages", "covered", 5, 6, 2), ("pages", "covered", 29, 29, 1),
        ("pages", "gap", 3, 4, 2), ("pages", "gap", 7, 28, 22), ("queries", "covered", 0, 29, 30),
    ]


def test_same_as_day_by_day(spark):
    rng = random.Random(1)
    held = {f"t{k}": [n for n in range(30) if rng.random() < k / 4] for k in range(5)}
    spans = told(plan(spark, held, dict.fromkeys(held, True)))
    for t, ns in held.items():
        for n in range(30):
            kinds = [kind for u, kind, a, b, _ in spans if u == t and a <= n <= b]
            assert kinds == ["covered" if n in ns else "gap"]


def test_grace_and_version(spark):
    judge = lambda held, tables, grace=0: verdict(plan(spark, held, tables), day(0).isoformat(), day(29).isoformat(), grace).first()
    most = {"a": range(28), "b": range(30)}
    assert not judge(most, {"a": True, "b": True}).complete and not judge(most, {"a": True}, 1).complete
    assert judge(most, {"a": True, "b": True}, 2).complete and judge(most, {"a": False, "b": True}).complete
    assert not judge(most, {"b": False}).complete and not judge({"a": []}, {"a": True}, 90).complete and judge({"a": [0]}, {"a": True}, 90).complete
    text = "\n".join(["a\0" + f"{day(0)}\0{day(27)}", "b\0" + f"{day(0)}\0{day(29)}"])
    assert judge(most, {"b": True, "a": True}).version == hashlib.sha256(text.encode()).hexdigest()[:32]
    assert judge(most, {"a": True}).version != judge({"a": range(27)}, {"a": True}).version
