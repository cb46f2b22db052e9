import pickle
import random
import re

from tidewell.llm.decontaminate import Index, drop_leaks, find_leaks

DOCS, ITEMS = "doc_id long, text string, item_id int", "item_id long, text string, doc_id int"


def slow(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for item, text in {(i, t) for i, t, _ in items}:
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        for doc, body, _ in docs:
            v = words(body)
            shared = len(want & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)})
            if 5 * shared >= 4 * len(want):
                out.append((doc, item, len(want), shared, shared / len(want)))
    return sorted(out, key=str)


def sample():
    rng = random.Random(6)
    vocabulary = [f"wörd{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 4, 5, 6, 14, 40]))), 1) for i in range(60)]
    items += [(60, None, 1), (61, "", 1), (62, "!!", 1), (7, items[7][1], 1), (7, "another text of item seven here", 1), (None, "nobody calls me by my name today", 1)]
    docs = []
    for i in range(200):
        text = rng.choices(vocabulary, k=rng.randrange(60))
        if i % 2:
            leak = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(4)):
                if leak:
                    leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
            text += [w.upper() + rng.choice(["", ",", "."]) for w in leak] + rng.choices(vocabulary, k=3)
        docs.append((i, " ".join(text), 1))
    docs += [(500, None, 1), (501, "", 1), (None, items[3][1], 1), (5, items[9][1], 1), (502, items[44][1] + " filler" * 50_000, 1), (503, "Nobody calls me by my name today!", 1)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = sample()
    want = slow(docs, items)
    assert len(want) > 50
    for pass_bytes in (1 << 20, 400):
        got = find_leaks(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), pass_bytes=pass_bytes)
        assert sorted([tuple(r) for r in got.collect()], key=str) == want


def test_drop_and_empty_tables(spark):
    docs, items = sample()
    docs.append((6, items[9][1], 1))
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    clean = [row for row in docs if not slow([row], items)]
    assert docs[-1] not in clean and any(row[0] == 6 for row in clean) and (None, items[3][1], 1) not in clean
    for pass_bytes in (1 << 20, 400):
        kept = drop_leaks(d, b, pass_bytes=pass_bytes)
        assert kept.columns == d.columns
        assert sorted([tuple(r) for r in kept.collect()], key=str) == sorted(clean, key=str)
    none = spark.createDataFrame([], ITEMS)
    assert find_leaks(d, none).collect() == [] and find_leaks(spark.createDataFrame([], DOCS), b).collect() == []
    assert drop_leaks(d, none).count() == len(docs) and drop_leaks(spark.createDataFrame([], DOCS), b).collect() == []


def test_index_is_small(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(words, k=60))) for i in range(4000)]
    index = Index(items, 0.8)
    arrays = [index.words, index.begin, *[x for pair in index.sketches.values() for x in pair]]
    text = sum(len(t) for _, t in items)
    assert sum(x.nbytes for x in arrays) < 2 * text and len(pickle.dumps(index)) < 4 * text
