import random
import re

import numpy as np
import xxhash

from tidewell.llm import simhash
from tidewell.llm.shared import cut
from tidewell.llm.simhash import BINS, alike, band_masks, drop_near_copies, likely, linked, named, simhash_groups, sketched


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def slow_single(rows, least=0.8):
    """The rows (doc_id, text) that stay of each group of texts alike by five-word shingles: positions of the smallest ids."""
    words = [re.sub(r"[\x20\x09-\x0D]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")).strip(" ").split(" ") for _, t in rows]
    sets = [set() if w == [""] else {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if words[i] == words[j] or (union and shared >= least * union - 1e-9):
                root[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        k = (doc is None, doc or 0)
        if find(i) not in best or k < best[find(i)][0]:
            best[find(i)] = (k, i)
    return sorted(rows[i][0] if rows[i][0] is not None else -1 for _, i in best.values())


def test_near_copies_against_brute_force(spark):
    rng = random.Random(15)
    words = [f"w{i}É" for i in range(500)] + ["Ab", "aB"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 5, 30, 120, 400])))) for i in range(60)]
    for i in range(60, 400):
        text = rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 4, 10])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((rng.choice([i, 1000 - i]), rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, rows[8][1]), (None, "only here"), (-7, rows[9][1].upper().replace("É", "É"))]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fp int").repartition(3)
    got = sorted(-1 if r.doc_id is None else r.doc_id for r in drop_near_copies(df).collect())
    want = slow_single(rows)
    # No text goes that is alike to none that stays; a link may be missed in few cases.
    assert set(want) <= set(got) and len(got) <= len(want) + 4 and len(want) < 330


def test_copies_of_one_text_link_and_others_do_not(spark):
    rng = random.Random(3)
    base = [f"t{rng.randrange(10**6)}" for _ in range(200)]

    def changed(n):
        text = list(base)
        for i in range(n):
            text[7 + i * (180 // max(n, 1))] = f"new{rng.randrange(10**9)}"
        return " ".join(text)

    # n far changes touch 5 n shingles of 196: a similarity of (196 - 5 n) / (196 + 5 n).
    rows = [(0, " ".join(base))] + [(i, changed(i)) for i in range(1, 12)]
    got = {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0} | {i for i in range(1, 12) if (196 - 5 * i) / (196 + 5 * i) < 0.8}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}É" for i in range(300)] + ["Ab", "aB"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 4, 40, 200])))) for i in range(120)]
    for i in range(120, 260):
        text = rows[rng.randrange(120)][1].split()
        if len(text) > 150:
            text[rng.randrange(len(text))] = "changed"
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [(300, None), (301, ""), (302, " \n"), (None, rows[0][1]), (None, "only here"), (5, rows[5][1]), (-7, rows[3][1].upper())]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fp int").repartition(3)
    got = sorted([tuple(r) for r in simhash_groups(df).collect()], key=str)
    assert got == slow_groups(rows)


def test_hot_bucket_is_dealt_over_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_SIDE", 8)
    fps = [(1 << a) | (1 << b) for a in range(20) for b in range(a)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    reach = {f: f for f in fps}

    def find(f):
        while reach[f] != f:
            f = reach[f]
        return f

    for e in edges:
        assert (e.a ^ e.b).bit_count() <= 4
        reach[find(e.a)] = find(e.b)
    assert len({find(f) for f in fps}) == 1


def test_every_band_scheme_covers_the_radius():
    rng = random.Random(1)
    for n in (10, 10**7, 10**9, 10**12):
        masks = band_masks(n)
        for _ in range(500):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)


def test_empty_table_and_drop(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(empty).collect() == []
    text = " ".join(f"word{i}" for i in range(50))
    df = spark.createDataFrame([(2, text, "x"), (1, text, "y"), (1, text, "y"), (9, "other words here now", "z"), (None, text, "n")], "doc_id long, text string, extra string")
    kept = sorted((r.doc_id is None, r.doc_id, r.extra) for r in drop_near_copies(df).collect())
    assert kept == [(False, 1, "y"), (False, 9, "z")]
    assert drop_near_copies(empty).collect() == []


def test_each_row_stands_for_itself(spark):
    rng = random.Random(4)
    a, b = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "ab")
    schema = "doc_id long, text string, extra string, c0 string"
    cases = [
        # The near copy goes and the only b stays, although both have the doc_id 5.
        ([(3, a, "x", None), (5, a, "x", None), (5, b, "x", None)], [(3, a, "x", None), (5, b, "x", None)]),
        # Rows without a doc_id are copies like others, and come last.
        ([(None, a, "x", None), (4, a, "x", None), (None, b, "x", None), (None, b, "x", None)], [(4, a, "x", None), (None, b, "x", None)]),
        ([(None, None, None, None), (None, "", "x", None)], 1),
        # Of one doc_id and text, one; which one does not depend on the order.
        ([(7, a, None, "x"), (7, a, "x", None), (7, a, "x", None)], 1),
    ]
    for rows, want in cases:
        got = [[tuple(r) for r in drop_near_copies(spark.createDataFrame(some, schema)).collect()] for some in (rows, rows[::-1])]
        assert sorted(got[0], key=str) == sorted(got[1], key=str)
        assert len(got[0]) == want if isinstance(want, int) else sorted(got[0], key=str) == sorted(want, key=str)


def test_sketches_keep_all_that_are_alike(spark):
    rng = random.Random(11)
    rows, similar = [], {}
    for i in range(400):
        n = rng.choice([1, 3, 10, 60, 400, 3000])
        keep = rng.choice([1.0, 0.97, 0.9, 0.89, 0.7, 0.3, 0.0])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = {x if rng.random() < keep else rng.getrandbits(64) for x in a}
        similar[i] = len(a & b) / len(a | b)
        rows.append((i, -i, *(bytearray(sketched(np.array(sorted(x), np.uint64))) for x in (a, b))))
    edges = spark.createDataFrame(rows, "a long, b long, sketch_a binary, sketch_b binary").repartition(3)
    got = {r.a for r in likely(edges, 0.8).collect()}
    assert got >= {i for i, s in similar.items() if s >= 0.8}
    assert len(got & {i for i, s in similar.items() if s < 0.5 and len(rows[i][2]) == BINS}) < 0.5 * sum(s < 0.5 for s in similar.values())
    assert likely(edges.limit(0), 0.8).collect() == []


def slow_alike(x, y, least=0.8):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.split(), y.split()))
    return len(a & b) >= least * len(a | b) - 1e-9


def test_texts_of_a_hub_are_dealt_and_edges_kept_exactly(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HUB_EDGES", 7)
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    bases = [rng.choices(words, k=n) for n in (1, 6, 80, 300, 5_000)]
    texts = []
    for i in range(150):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 3, 6]) * max(1, len(text) // 200)):
            text[rng.randrange(len(text))] = rng.choice(words)
        texts.append(" ".join(text))
    # Text 0 has an edge to each other one; the others have some, right or wrong.
    edges = sorted({(0, i) for i in range(1, 150)} | {tuple(sorted(rng.sample(range(150), 2))) for _ in range(300)})
    bodies = cut(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3))
    near = cut(spark.createDataFrame([(*e, rng.random()) for e in edges], "a long, b long, share double").repartition(3))
    right = [e for e in edges if slow_alike(texts[e[0]], texts[e[1]])]
    assert 20 < len(right) < len(edges) - 20
    assert sorted(tuple(r) for r in alike(near, bodies, 0.8).collect()) == right
    root = list(range(150))
    for _ in range(150):
        for a, b in right:
            root[a] = root[b] = min(root[a], root[b])
    ends = {x for e in right for x in e}
    assert {r.node: r.root for r in linked(near, bodies, 0.8).collect()} == {x: root[x] for x in ends}
    assert linked(near.limit(0), bodies, 0.8).collect() == []


def test_texts_that_share_half_their_name_stay_apart(spark, monkeypatch):
    rows = [(1, 5), (1, 3), (1, 9), (2, 5), (-4, 0)]
    got = {(r.t1, r.t2): r.id for r in named(spark.createDataFrame(rows, "t1 long, t2 long")).collect()}
    assert len(set(got.values())) == len(rows) and got[1, 3] == 1 and got[2, 5] == 2 and got[-4, 0] == -4
    # With all first halves equal, texts still go by themselves.
    real = simhash.text_sketches
    monkeypatch.setattr(simhash, "text_sketches", lambda rows: real(rows).selectExpr("place", "7L AS t1", "t2", "fp", "keys", "sketch"))
    rng = random.Random(2)
    a, b = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "ab")
    docs = [(1, a), (2, b), (3, a), (4, b + " more"), (5, None)]
    kept = drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 5]


def test_texts_meet_all_others_of_their_bucket(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        rows += [(3 * i + k, " ".join([*base[:78], *(f"x{3 * i + k}y{j}" for j in range(2))]) if k else " ".join(base)) for k in range(3)]
    # One bucket holds all texts, so the first and the last one before a text are seldom the one it is alike to.
    real = simhash.text_sketches
    monkeypatch.setattr(simhash, "text_sketches", lambda rows: real(rows).selectExpr("place", "t1", "t2", "0L AS fp", "array(7L) AS keys", "sketch"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for side in (2048, 16):
        monkeypatch.setattr(simhash, "CELL_SIDE", side)
        assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [3 * i for i in range(30)]


def test_a_bucket_of_texts_that_are_almost_alike_writes_no_pairs(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]

    def changed(text, n, name):
        text = list(text)
        for i in rng.sample(range(2, 298), n):
            text[i] = f"{name}x{i}"
        return text

    # 120 texts with a similarity of some 0.7 to each other, and 30 near copies of some of them.
    rows = [changed(base, 6, f"a{i}") for i in range(120)]
    rows += [changed(rows[rng.randrange(120)], 2, f"b{i}") for i in range(30)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(rows)
    want = slow_single(rows)
    assert 100 < len(want) <= 120
    real, written, cuts = simhash.text_sketches, [], simhash.cut
    monkeypatch.setattr(simhash, "text_sketches", lambda rows: real(rows).selectExpr("place", "t1", "t2", "0L AS fp", "array(7L) AS keys", "sketch"))

    def counted(df):
        out = cuts(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # All texts share one bucket: of their 11,175 pairs, none but those that join groups may be written.
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == want
    assert max(written) <= 4 * len(rows)
    # The same over many cells, some cut by texts and some by shingles.
    for side, shingles in ((16, 10**6), (2048, 9_000)):
        monkeypatch.setattr(simhash, "CELL_SIDE", side)
        monkeypatch.setattr(simhash, "CELL_SHINGLES", shingles, raising=False)
        assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == want
