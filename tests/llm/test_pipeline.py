"""The stages one after the other, each held against a slow version on what the one before kept."""

import random
from collections import Counter

import corpus_pipeline
from tidewell.llm.shared import cut
from tests.llm.test_decontaminate import slow as slow_leaks
from tests.llm.test_mixing import slow_targets
from tests.llm.test_simhash import slow_single

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def sample():
    rng = random.Random(14)
    words = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=20))) for i in range(10)]
    docs, labels = [], []
    for i in range(300):
        text = rng.choices(words, k=rng.choice([30, 80, 200]))
        kind = i % 10
        if kind == 0:
            text = [w + rng.choice(["###", "%%%"]) for w in text]
        elif kind == 1 and docs:
            text = rng.choice(docs)[1].split()
        elif kind == 2:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(items)[1].split() + text[at:]
        docs.append((i, " ".join(text), "en", rng.choice(["a", "hot", "hot", "b", None]), 1))
        if i % 2:
            labels.append((i, int("###" not in docs[-1][1] and "%%%" not in docs[-1][1]), 0))
        elif kind == 0:
            labels.append((i, 0, 0))
    docs += [(400, None, None, "a", None), (401, "", None, None, 0)]
    return docs, labels, items


def test_stages_against_slow_versions(spark, tmp_path):
    docs, labels, items = sample()
    folder = f"file://{tmp_path}"
    write(spark, folder, docs, labels, items)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/stage{k}")
        now = spark.read.parquet(f"{folder}/stage{k}")
        kept.append([tuple(r) for r in now.collect()])
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    good, single, clean, mix, shards = kept
    junk = {i for i, t, *_ in docs if t and ("###" in t or "%%%" in t)}
    ids = {r[0] for r in good}
    assert not ids & junk and len(ids) >= 0.95 * (len(docs) - len(junk))
    want = set(slow_single([r[:2] for r in good]))
    assert {r[0] for r in single} == want and len(single) == len(want)
    leaked = {r[0] for r in slow_leaks([(*r[:2], 0) for r in single], [(*i, 0) for i in items])}
    assert leaked and {r[0] for r in clean} == want - leaked
    size = lambda t: len((t or "").split())
    sums, taken = Counter(), Counter()
    for r in clean:
        sums[r[3]] += size(r[1])
    for r in mix:
        taken[r[3]] += size(r[1])
    for s, t in slow_targets({s: sums[s] for s in [*sorted(x for x in sums if x is not None), *([None] if None in sums else [])]}).items():
        assert abs(taken[s] - t) <= 30
    assert max(Counter(r[0] for r in mix).values()) <= 3 and {r[0] for r in mix} <= want - leaked
    assert sorted(r[0] for r in shards) == sorted(r[0] for r in mix)


def test_run_over_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder, [], [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_columns_of_any_name_and_type(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int, `a.b` string, _metadata string, `m` map<string,int>, `b``c` int"
    rows = [(i, f"plain words number {i} of many that are {i * 7} and {i * i} apart", "en", "s", 9, "x", "y", {"k": i}, i) for i in range(40)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        folder = f"file://{tmp_path}"
        if name.startswith("simhash"):
            spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            docs = cut(out)
    assert out.count() == 40
