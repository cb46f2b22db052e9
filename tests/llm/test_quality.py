import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewell.llm.quality import BUCKETS, EVIDENCE, FEATURES, fitted_curve, hashed_grams, keep_good, kth_largest, labelled_sample, resample
from tidewell.llm.words import Tokens

DOCS, LABELS = "doc_id long, text string, good_id int", "doc_id long, quality int, text string"


def sample():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(400):
        good = i % 5 > 0
        text = [rng.choice(words) for _ in range(rng.choice([4, 60, 200]))]
        if not good:
            text = [w + rng.choice(["###", "%%%"]) for w in text] if i % 2 else [text[0]] * len(text)
        rows.append((i, " ".join(text), 1))
        if i % 3:
            labels.append((i, int(good), "x"))
    return rows, labels


def test_tokens_are_those_of_a_pattern():
    texts = ["Ab ab, c--d_1 %%%x", "", None, "Été\t\x1f!?a", "a" * 3 + " " + "b.C"]
    want = [re.findall(rb"[a-zA-Z0-9_\x7f-\xff]+|[^a-zA-Z0-9_\x7f-\xff\x00-\x20]+", (t or "").encode()) for t in texts]
    got = Tokens(pa.array(texts))
    assert [got.bytes[a:b] for a, b in zip(got.start, got.end)] == [w for t in want for w in t]
    assert got.row.tolist() == [i for i, t in enumerate(want) for _ in t]
    codes = {}
    for code, word in zip(got.code.tolist(), [w.lower() for t in want for w in t]):
        assert codes.setdefault(word, code) == code
    assert len(set(codes.values())) == len(codes)


def slow_grams(text):
    """All features of one text, by itself."""
    grams, at, fresh, again = hashed_grams(pa.array([text]))
    return [*grams.tolist(), *[BUCKETS] * int(fresh[0]), *[BUCKETS + 1] * int(again[0])]


def test_grams_of_a_batch_are_those_of_each_text():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("a b c, dd e! f".split(), k=rng.randrange(0, 40))) for _ in range(200)] + [None, "", "x", "x y"]
    grams, at, fresh, again = hashed_grams(pa.array(texts))
    for i, text in enumerate(texts):
        alone = hashed_grams(pa.array([text], pa.string()))
        assert grams[at[i] : at[i + 1]].tolist() == alone[0].tolist()
        tokens = re.findall(r"\w+|[^\w\s]+", text or "")
        n = len(tokens)
        assert at[i + 1] - at[i] == max(0, 2 * n - 1)
        threes = Counter(zip(tokens, tokens[1:], tokens[2:]))
        assert fresh[i] == len(threes) and again[i] == sum(threes.values()) - len(threes)
    # Equal tokens and pairs have equal buckets wherever they stand.
    a, b = hashed_grams(pa.array(["p q r", "r p q"]))[0].reshape(2, 5).tolist()
    assert [a[0], a[1], a[2], a[4]] == [b[2], b[3], b[4], b[0]]


def test_parts_junk_from_good_and_matches_slow_weights(spark):
    rows, labels = sample()
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in resample(docs, marks).collect()}
    chosen = labelled_sample(marks).collect()
    good = {r.doc_id for r in chosen if r.good and r.for_model}
    counts = np.zeros((2, FEATURES))
    for i, text, _ in rows:
        found = np.bincount(slow_grams(text), minlength=FEATURES)
        counts[0] += found
        counts[1] += found * (i in good)
    p = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])
    for i, text, _ in rows:
        mine = slow_grams(text)
        assert got[i].n_grams == len(mine)
        assert math.isclose(got[i].log_weight, EVIDENCE * ratio[mine].mean(), abs_tol=1e-4)
    long = [i for i, text, _ in rows if len(text.split()) > 10]
    assert sum(got[i].kept == (i % 5 > 0) for i in long) >= 0.97 * len(long)
    # Gumbel top-k: exactly the documents with the largest keys; k is the expected number of good ones.
    keys = sorted((r.draw_key for r in got.values()), reverse=True)
    k = sum(r.kept for r in got.values())
    held = [r for r in chosen if not r.for_model]
    slope, start = fitted_curve(np.array([got[r.doc_id].log_weight for r in held]), np.array([float(r.good) for r in held]))
    assert slope > 0 and k == round(sum(1 / (1 + math.exp(-slope * r.log_weight - start)) for r in got.values()))
    assert abs(k - 320) < 16
    assert {r.doc_id for r in got.values() if r.kept} == {r.doc_id for r in got.values() if r.draw_key >= keys[k - 1]}


def test_draws_follow_the_weights(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    # Texts that mix good and bad words in all shares, so that weights spread.
    rows = [(i, " ".join(rng.choice(words) + ("#" if rng.random() < i / 60 else "") for _ in range(60)), 1) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1).cache()
    marks = spark.createDataFrame([(i, int(i < 30), "x") for i in range(60)], LABELS).cache()
    seeds, k = 16, 20
    runs = [resample(docs, marks, evidence=4.0, seed=s, share=k / 60).collect() for s in range(seeds)]
    drawn = [{r.doc_id for r in run if r.kept} for run in runs]
    weight = {r.doc_id: r.log_weight for r in runs[0]}
    top = set(sorted(weight, key=weight.get, reverse=True)[:k])
    assert all(len(d) == k for d in drawn) and len({frozenset(d) for d in drawn}) == seeds
    assert all(d != top for d in drawn)  # the noise takes effect
    # How often each is drawn is what drawing without replacement by weight gives.
    order = sorted(weight)
    log_w = np.array([weight[i] for i in order])
    chance = np.zeros(len(order))
    for g in np.random.default_rng(5).gumbel(size=(4000, len(order))):
        chance[np.argsort(-(log_w + g))[:k]] += 1 / 4000
    often = np.array([sum(i in d for d in drawn) / seeds for i in order])
    assert np.corrcoef(often, chance)[0, 1] > 0.85
    assert abs(often - chance).max() < 4.5 * math.sqrt(0.25 / seeds)


def test_odd_rows(spark):
    rows, labels = sample()
    rows += [(900, None, 0), (901, "", 0), (None, "word1### word2%%% " * 40, 0), (5, rows[5][1], 0), (902, "word3 " + "word9 word4 " * 40_000, 0)]
    labels += [(None, 1, "n"), (3, None, "n"), (900, 1, "n")]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = resample(docs, marks).collect()
    assert len(got) == len(rows)
    assert {r.log_weight for r in got if r.doc_id in (900, 901)} == {0.0}
    kept = keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(row for row, r in zip(rows, docs_order(docs, marks)) if r)


def docs_order(docs, marks):
    """Whether each row of docs is kept, in the order of its rows."""
    verdict = {}
    for r in resample(docs, marks).collect():
        verdict.setdefault(r.doc_id, []).append(r.kept)
    return [verdict[r.doc_id].pop(0) for r in docs.collect()]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rows, labels = sample()
    good, bad = rows[3][1] + " " + rows[8][1], "word1### word2%%% " * 60
    odd = [(7000, good, 1), (7000, bad, 2), (None, good, 3), (None, bad, 4)]
    marks = spark.createDataFrame(labels, LABELS)
    for some in (odd, odd[::-1]):
        kept = keep_good(spark.createDataFrame(rows + some, DOCS), marks).where("doc_id = 7000 OR doc_id IS NULL").collect()
        assert sorted(r.good_id for r in kept) == [1, 3]


def test_empty_tables(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert resample(empty, none).collect() == []
    assert keep_good(empty, none).collect() == []
    one = spark.createDataFrame([(1, "a b", 0), (2, "### ###", 0)], DOCS)
    assert all(r.kept and r.log_weight == 0 for r in resample(one, none).collect())


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.randrange(-(1 << 62), 1 << 62), rng.randrange(-5, 5), 7]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 37, 150, 299, 300):
        assert kth_largest(df, "x", k) == ordered[k - 1]
