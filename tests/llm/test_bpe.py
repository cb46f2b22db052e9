import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm.bpe import Codec, decode, encode, starts_anew

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = ["a", "b", "e", "th", "in", "'", "'s", "'ll", "s", " ", "\n", " ", "1", "½", "!", "...", "é", "é", "́", "한", "ᅡ", "ᆨ", "中", "🙂", "İ", "Σ"]
PIECES += ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "ͅ", "ཱི", "aaaa", "\x1c", "ª", "ß"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def codec(vocabulary):
    return Codec(vocabulary)


def whole(codec, text):
    return codec.whole.encode(text or "", add_special_tokens=False).ids


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        few = rng.sample(PIECES, rng.randrange(1, 8))
        text = "".join(rng.choice(few) for _ in range(rng.randrange(60)))
        yield rng.choice(["ab", "aaa", "the", "'s", "!'", "中", "thé"]) * rng.randrange(1, 400) + text if rng.random() < 0.3 else text


def test_leaves_join_to_the_ids_of_the_whole_text(codec):
    rng = random.Random(5)
    for text in texts(1, 3000):
        places = codec.cut_places(text, rng.choice([1, 2, 3, 5, 8, 20, 200]))
        got = codec.tree([codec.leaf(text[a:b]) for a, b in zip(places, places[1:], strict=False)])
        assert got.tolist() == whole(codec, text), text


def test_windows_grow_inside_one_unsplit_run(codec, monkeypatch):
    grown = []
    glued = codec.glued
    monkeypatch.setattr(codec, "glued", lambda *a: grown.append(len(a[0])) or glued(*a))
    text = "".join(random.Random(2).choice("aeinrst") for _ in range(20_000))
    places = codec.cut_places(text, 700)
    assert codec.tree([codec.leaf(text[a:b]) for a, b in zip(places, places[1:], strict=False)]).tolist() == whole(codec, text)
    assert max(grown) > 10_000


def test_short_texts_and_decoding(codec):
    some = [*texts(3, 500), None, "", "a\tB,c's  it's 'll''s 12\x1c3"]
    ids = codec.encode(pa.array(some, pa.string()))
    assert ids.to_pylist() == [whole(codec, t) for t in some]
    assert not starts_anew("́") and not starts_anew("ᆨ") and starts_anew("a") and starts_anew("中")


def test_frames(spark, vocabulary, codec):
    rng = random.Random(4)
    long = "".join(rng.choice(["wörd ", "the'", "x" * 50, "\n", "12", "é"]) for _ in range(4000))
    rows = [(1, long, {"a": 1}), (2, None, None), (3, "", {}), (1, long, {"a": 1}), (None, "Hello <|endoftext|> world", None), (4, "y" * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string,int>").withColumn("ids", F.lit("clash"))
    out = decode(encode(docs, vocabulary, leaf_chars=256), vocabulary).select("row.text", F.col("row.ids").alias("own"), "n_tokens", "decoded", F.hex("ids").alias("h")).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = whole(codec, r.text)
        assert r.n_tokens == len(ids) and r.own == "clash"
        assert r.h.lower() == b"".join(i.to_bytes(4, "little") for i in ids).hex()
        assert r.decoded == codec.whole.decode(ids, skip_special_tokens=False)
    assert decode(encode(docs.limit(0), vocabulary), vocabulary).count() == 0


def test_other_vocabularies_are_refused(vocabulary):
    with pytest.raises(ValueError):
        Codec(vocabulary.replace('"end_of_word_suffix": "</w>"', '"end_of_word_suffix": null').replace('"end_of_word_suffix":"</w>"', '"end_of_word_suffix":null'))
