import math
import random
import zlib
from collections import Counter

import numpy as np

from tidewell.llm.language import EMBED, WIDTHS, WINDOW, cut_windows, identify_languages, predict, train

WORDS = {"aa": ["kalo", "miru", "tasen", "oki"], "bb": ["zhrv", "plks", "grwn", "czt"], "cc": ["ñandú", "ésta", "ñoño", "çava"]}
SCHEMA = "doc_id long, text string, lang string, score int"


def test_held_out_accuracy_and_edge_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.choice([3, 10, 300]))), lang, 0))
    rows += [(1000, None, "aa", 0), (1001, "", "aa", 0), (1002, "123 !? _ ½ ²", "bb", 0), (None, "kalo miru", None, 0), (1003, "kalo " * 30_000, None, 0), (5, rows[5][1], None, 0)]
    got = identify_languages(spark.createDataFrame(rows, SCHEMA), most_pieces=600).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    truth = {r[0]: r[2] for r in rows[:600]}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id < 600]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[None].lang_pred == "aa" and by_id[1003].lang_pred == "aa" and not by_id[None].held_out
    assert all(0 <= r.score <= 1 for r in got)


def slow_log_probs(net, window):
    """The network by its definition: embed each byte, slide each filter, take the largest answer, softmax."""
    pooled = []
    for w, filters, bias in zip(WIDTHS, net.filters, net.bias):
        for k in range(filters.shape[1]):
            best = max(
                sum(float(net.embed[window[at + j], e]) * float(filters[j * EMBED + e, k]) for j in range(w) for e in range(EMBED))
                for at in range(WINDOW - w + 1)
            )
            pooled.append(max(0.0, best + float(bias[k])))
    z = [sum(x * float(net.out[i, c]) for i, x in enumerate(pooled)) + float(net.out_bias[c]) for c in range(len(net.langs))]
    return [x - math.log(sum(math.exp(y) for y in z)) for x in z]


def test_tables_give_a_plain_convolution():
    rng = random.Random(7)
    texts = [" ".join(rng.choices(WORDS[k], k=20)).encode() for k in WORDS for _ in range(8)]
    net = train(texts, [k for k in WORDS for _ in range(8)], epochs=2)
    windows = np.concatenate([cut_windows(t)[:1] for t in texts[::9]])
    got = net.log_probs(windows, net.tables())
    for row, window in zip(got, windows):
        assert np.allclose(row, slow_log_probs(net, window), atol=1e-4)


def test_prediction_is_the_mean_over_all_windows_of_a_slow_network(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(WORDS[k], k=20)) for k in WORDS for _ in range(8)]
    net = train([t.encode() for t in texts], [k for k in WORDS for _ in range(8)], epochs=2)
    docs = [(1, texts[0]), (2, texts[9] + " " + texts[10] * 4), (3, "!!"), (4, None)]
    for r in predict(spark.createDataFrame(docs, "doc_id long, text string"), net).collect():
        text = dict(docs)[r.doc_id]
        if r.doc_id > 2:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        mean = np.mean([np.exp(slow_log_probs(net, w)) for w in cut_windows(text.encode())], axis=0)
        assert r.lang_pred == net.langs[int(mean.argmax())] and abs(r.score - mean.max()) < 1e-4


def test_every_language_is_learned_and_the_sample_is_bounded(spark, monkeypatch):
    from tidewell.llm import language

    seen = []
    monkeypatch.setattr(language, "train", lambda texts, langs: seen.append(Counter(langs)))
    rows = [(i, f"text {i} " * rng, f"l{i % 300}") for i in range(3000) for rng in [1 + i % 7]]
    rows += [(i, "hot text " * 2000, "hot") for i in range(200)] + [(9, "same row " * 90, "hot")] * 50
    language.train_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_pieces=600)
    assert len(seen[0]) == 301 and max(seen[0].values()) <= language.LEAST_PER_LANG == seen[0]["hot"]


def test_windows_hold_every_byte():
    for n in (0, 1, WINDOW - 1, WINDOW, WINDOW + 1, 5 * WINDOW, 5 * WINDOW + 77):
        text = bytes(i % 251 + 1 for i in range(n))
        w = cut_windows(text)
        whole = b"".join(r.tobytes() for r in w[:-1])
        tail = w[-1].tobytes().rstrip(b"\0")
        assert text.startswith(whole) and text.endswith(tail) and len(whole) + len(tail) >= n


def test_empty_and_unlabelled_tables(spark):
    assert identify_languages(spark.createDataFrame([], SCHEMA)).collect() == []
    got = identify_languages(spark.createDataFrame([(1, "kalo", None, 0)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
