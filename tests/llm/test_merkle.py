import hashlib
import random
import zlib
from collections import Counter, defaultdict

from tidewell.llm import merkle
from tidewell.llm.merkle import verified

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def up(level, group):
    return [H(*level[i : i + group]) for i in range(0, len(level), group)]


def path(level, i, group):
    """Levels above a leaf: siblings before and after it."""
    steps = []
    while len(level) > 1:
        first = i - i % group
        steps.append((level[first:i], level[i + 1 : first + group]))
        level, i = up(level, group), i // group
    return steps, level[0]


def slow(rows, group):
    """Rows by doc_id and the rest; equal rows share a set of proofs."""
    trees = defaultdict(list)
    for r in rows:
        doc_id, source, lang, n, text = r
        odd = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        trees[lang].append((doc_id is not None, doc_id or 0, leaf(r), doc_id, leaf((doc_id, source, lang, n + 1, text)) if odd else leaf(r)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    roots = []
    for lang in langs:
        trees[lang].sort()
        roots.append(path([x[2] for x in trees[lang]], 0, group)[1])
    out = []
    for k, lang in enumerate(langs):
        tops, root = path(roots, k, group)
        level = [x[2] for x in trees[lang]]
        for i, (_, _, own, doc_id, claim) in enumerate(trees[lang]):
            steps = path(level, i, group)[0] + tops
            acc = claim
            for before, after in steps:
                acc = H(*before, acc, *after)
            out.append((doc_id, own, roots[k], root, H(*[h for s in steps for part in s for h in part]), acc, acc == root))
    return Counter(out)


def sample(n):
    rng = random.Random(3)
    rows = [(rng.randrange(2 * n), rng.choice(["a", None, "é"]), rng.choice(["en", "en", None, "fr", "", "de"]), rng.choice([None, 1, 22]), rng.choice(["", None, "wörd\n" * rng.randrange(9)])) for _ in range(n)]
    return rows + [rows[0]] * 5 + [(None, None, None, None, None)] * 3 + [(7, "x", "lone", 5, "t" * 100_000), (-12, "x", "two", 0, "a"), (14, "x", "two", 0, "b")]


def test_same_as_slow(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_TASK", 40)
    for n, group in ((300, 2), (90, 3)):
        rows = sample(n)
        monkeypatch.setattr(merkle.proofs, "__defaults__", (3,))
        docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", tree string")
        got = verified(docs.repartition(3), group).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
        assert Counter(map(tuple, got)) == slow(rows, group)


def test_one_row_and_none(spark):
    rows = [(1, None, "en", None, "x")]
    assert Counter(map(tuple, verified(spark.createDataFrame(rows, SCHEMA)).collect())) == slow(rows, 2)
    assert verified(spark.createDataFrame([], SCHEMA)).collect() == []
