import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidewell.llm import divergence as module
from tidewell.llm.divergence import divergence, share

SCHEMA = "doc_id long, text string, lang string, source string"


def slow(rows, least):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        counts[lang, source] += found
        docs[lang] += Counter(found.keys())
        groups.add((lang, source))
    kept = {lang: sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode) for lang, _ in groups}
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang] += c
    p = lambda c, lang: {t: 1 + (10**9 * (c[t] + 2)) // (sum(c[u] for u in kept[lang]) + 2 * len(kept[lang])) for t in kept[lang]}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, source in groups:
        own, q = p(counts[lang, source], lang), p(whole[lang], lang)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                theirs = p(counts[lang, other], lang)
                pairs.append((other, sum(f(own[t], theirs[t]) for t in kept[lang])))
        terms = [(t, f(own[t], q[t])) for t in kept[lang] if counts[lang, source][t] and own[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found)]
    return sorted(out)


def sample(n=700):
    rng = random.Random(7)
    words = ["Aa", "bé", "the", "The", "ñ", "ÀB", "z'q", "x1y", "日本", "🙂k", "tie", "eit", "of"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "b", "c", None, "d", "é", "Z"])
        lang = rng.choice(["en", "en", "en", None, "fr", "xx" if i % 50 == 0 else "en"])
        lean = words[: 12 if source == "b" else None]
        rows.append((i, rng.choice([None, "", "  "]) if i % 41 == 0 else rng.choice([" ", ".", "-"]).join(rng.choices(lean, k=rng.randrange(1, 30))), lang, source))
    return rows + [rows[3], rows[3], (None, "the " * 50_000, "fr", "long"), (5, "the", "empty", "s"), (6, None, "empty", "t")]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_same_as_slow(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", `term` string").repartition(5)
    assert rows_of(divergence(docs)) == slow(rows, 10)


def test_small_chunks_and_tiles(spark, monkeypatch):
    for name, value in (("CHUNK_TERMS", 5), ("CHUNK_ROWS", 17), ("TILE_SOURCES", 2), ("ROWS_PER_TASK", 40), ("HELD_TERMS", 10)):
        monkeypatch.setattr(module, name, value)
    rows = sample(250)
    assert rows_of(divergence(spark.createDataFrame(rows, SCHEMA), 4)) == slow(rows, 4)


def test_empty_tables(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    assert rows_of(divergence(spark.createDataFrame([(1, None, None, "a"), (2, "x", None, None)], SCHEMA))) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_shares_are_exact():
    counts = np.array([2, 3, 999_999_999_999, 10**13 + 7])
    for total in (10**13 + 9, 8 * 10**15):
        assert share(counts, total).tolist() == [1 + 10**9 * int(c) // total for c in counts]
