import random

from tidewell.llm.lines import dedup_lines

SCHEMA = "doc_id long, text string, body int"


def slow(rows, run=3):
    first = {}
    docs = []
    for doc, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        n = min(run, len(lines))
        docs.append((doc, lines, n, (doc is None, doc or 0, hash_key(text))))
        for i in range(len(lines) - n + 1 if lines else 0):
            k = tuple(lines[i : i + n])
            first[k] = min(first.get(k, (docs[-1][3], i)), (docs[-1][3], i))
    out = []
    for (doc, text, _), (_, lines, n, order) in zip(rows, docs):
        gone = set()
        for i in range(len(lines) - n + 1 if lines else 0):
            if first[tuple(lines[i : i + n])] < (order, i):
                gone |= set(range(i, i + n))
        out.append((doc, None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


def hash_key(text):
    return 0 if text is None else _hash[text]


_hash = {}


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    _hash.update({r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()})
    got = sorted([tuple(r) for r in dedup_lines(df).collect()], key=str)
    assert got == slow(rows)


def test_against_brute_force(spark):
    rng = random.Random(9)
    lines = [f"line {i}" for i in range(14)] + [""]
    rows = []
    for i in range(150):
        text = [rng.choice(lines) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.3:
            text = [rng.choice(lines)] * rng.randrange(1, 30)
        rows.append((rng.choice([i, 500 - i]), "\n".join(text), 1))
    rows += [(i, "\n".join(f"own {j}" for j in range(20)), 1) for i in range(1000, 1040)]
    rows += [(2000, None, 1), (2001, "", 1), (None, rows[3][1], 1), (None, "x\ny\nz", 1), (None, "x\ny\nz", 1), (5, rows[7][1], 1), (2002, "\n" * 4000, 1), rows[4], (2003, "only one", 1), (2004, "only one", 1)]
    check(spark, rows)


def test_a_very_long_text_that_stays_in_part(spark):
    import time

    n = 50_000
    shared = [f"shared line number {i} of the text" for i in range(n)]
    own = [f"own line number {i} of the text" for i in range(n)]
    mixed = [x for i in range(0, n, 10) for x in shared[i : i + 10] + own[i : i + 10]]
    df = spark.createDataFrame([(1, "\n".join(shared), 1), (2, "\n".join(mixed), 1)], SCHEMA)
    began = time.monotonic()
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert time.monotonic() - began < 60
    assert got[1].n_removed == 0 and got[2].n_removed == n and got[2].text == "\n".join(own)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = dedup_lines(spark.createDataFrame([(1, "a", 1)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_long_lines_go_on_their_own(spark):
    notice, passage = "Released under the MIT License.", " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, f"a\n{notice}\nb\nc", 1),
        (2, f"{notice}\nd", 1),
        (3, f"e\n\n{passage}", 1),
        (4, f"{passage}\n\nf\n{notice}\ng\n{notice}", 1),
        (5, notice, 1),
        (6, "two words\nh", 1),
        (7, "i\ntwo words", 1),
        (None, f"{passage}\nj", 1),
    ]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: "d", 3: rows[2][1], 4: "\nf\ng", 5: "", 6: rows[5][1], 7: rows[6][1], None: "j"}
    assert {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, SCHEMA), line_words=None).collect()} == {d: t for d, t, _ in rows}


def test_long_lines_against_sql(spark):
    import duckdb
    import pandas as pd

    from tidewell.llm.queries import OP5_SQL

    rng = random.Random(4)
    lines = [f"line {i} of some words" for i in range(12)] + ["", "short", "not five words"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))), 1) for i in range(120)] + [(900, None, 1), (901, "", 1), (902, lines[0], 1)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]))
    want = sorted((d, n, gone) for d, n, gone, _ in con.execute(OP5_SQL).fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want and sum(x[2] for x in got) > 100
