import random
import re

import pyarrow as pa

from tidewell.llm.repeats import remove_repeats, whole_groups

SCHEMA = "doc_id long, text string, block int"


def slow(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    order = [float("inf") if d is None else d for d, _, _ in rows]
    first = {}
    for d, w in zip(order, words):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = []
    for (doc, _, _), d, w in zip(rows, order, words):
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        out.append((doc, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def sample():
    rng = random.Random(4)
    vocabulary = [f"é{i}" for i in range(400)]
    passage = [rng.choices(vocabulary, k=rng.randrange(10, 70)) for _ in range(12)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(6)):
            text += rng.choices(vocabulary, k=rng.randrange(30))
            if rng.random() < 0.6:
                p = rng.choice(passage)
                text += p[rng.randrange(3) : len(p) - rng.randrange(3)]
        rows.append((rng.choice([i, i, i, 1000 - i]), rng.choice([" ", "\n", "\t "]).join(text), 7))
    rows += [(i, " ".join(passage[3] * 2), 7) for i in range(2000, 2060)]
    rows += [(3000, None, 0), (3001, "", 0), (3002, " \n\t", 0), (None, " ".join(passage[1]), 0), (None, " ".join(passage[1]), 0), (3003, "x " * 300, 1), (3004, "x " * 40, 1), (3003, "x " * 300, 1)]
    # The largest id there is comes before no id.
    rows += [(2**63 - 1, " ".join(passage[1]), 1), (2**63 - 1, " ".join(f"last{i}" for i in range(20)), 1), (None, " ".join(f"last{i}" for i in range(20)), 1)]
    return rows


def test_against_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for block_bytes, group_rows in ((1 << 20, 1000), (4000, 1000), (4000, 5)):
        got = sorted([tuple(r) for r in remove_repeats(df, block_bytes, group_rows).collect()], key=str)
        assert got == slow(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_groups_come_whole_or_in_bounded_tables():
    rng = random.Random(6)
    for _ in range(200):
        values = sorted(rng.choice(range(6)) for _ in range(rng.randrange(60)))
        at, batches = 0, []
        while at < len(values):
            n = rng.randrange(1, 9)
            batches.append(pa.RecordBatch.from_arrays([pa.array(values[at : at + n], pa.int64())], ["v"]))
            at += n
        rows, most = rng.randrange(1, 12), rng.randrange(1, 20)
        seen, last = [], None
        for table, more in whole_groups(iter(batches), "v", rows, most):
            got = table.column("v").to_pylist()
            assert got and len(got) <= rows + most + 9
            # A table goes on with a value exactly if the one before ended with it.
            assert more == (last == got[0]) and (not more or len(set(got)) == 1)
            seen += got
            last = got[-1]
        assert seen == values
