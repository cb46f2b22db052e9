"""BPE encoding and decoding of whole texts with a given vocabulary; long texts are encoded in leaves that are joined as a tree."""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import quoted, slices

#: Characters of a leaf: longer texts are cut into leaves, which tasks encode by themselves.
LEAF_CHARS = 16_384
#: Stands between ids where the text has white space.
MARK = -1
#: Bytes of a run between which nothing splits, up to which it is encoded anew; from a longer one only a window is.
SHORT_RUN = 256
#: Tokens of the first window on each side of a join.
WINDOW = 8
#: Fixed value: how this kind of vocabulary splits text, and what that is for words of ASCII and Latin-1 letters in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
LATIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
#: Runs whose ids a task remembers.
KNOWN_RUNS = 1 << 17
#: Bytes that must follow the start of a run for the pattern to see that it starts there: two characters of four bytes.
AHEAD = 8


@cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b if b in plain else 256 + others.index(b)) for b in range(256)]


@cache
def composing() -> frozenset[str]:
    """Characters that may join with one before them: the second ones of all canonical decompositions, and Hangul vowels and finals."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(seconds | {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]})


def starts_anew(char: str) -> bool:
    """Whether normal form C of a text is that of the part before ``char`` and that of the rest."""
    if char.isascii():
        return True
    first = unicodedata.normalize("NFD", char)[0]
    return unicodedata.category(char) != "Cn" and not unicodedata.combining(first) and first not in composing()


@lru_cache(maxsize=4)
def token_names(vocabulary: str) -> pa.Array:
    """The name of each id."""
    spec = json.loads(vocabulary)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = [""] * (1 + max(ids.values()))
    for name, i in ids.items():
        names[i] = name
    return pa.array(names)


def names_of(ids: pa.Array, names: pa.Array) -> pa.Array:
    """The text of each row of packed ``ids`` as the library's decode gives it: without a decoder, the tokens' names parted by spaces."""
    _, ends, flat = ids.buffers()
    ends = np.frombuffer(ends, np.int32)[ids.offset : ids.offset + len(ids) + 1] // 4
    of = names.take(pa.array(np.frombuffer(flat, "<u4")[ends[0] : ends[-1]])) if flat is not None else pa.array([], pa.string())
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), of), " ")
    return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))


class Codec:
    """A byte-level BPE vocabulary whose words end in a suffix, as a JSON text of the tokenizers library.

    ``encode`` gives the ids of short texts, ``leaf`` those of a piece of a long
    one with marks for white space, and ``joined`` those of two neighbouring
    pieces from theirs. Ids agree with the library's on the whole text: a
    sequence of tokens is the one that the merges make if each two neighbours
    are what the merges make of those two alone. So two encodings may be put
    together where a window over their join begins and ends with tokens that
    they have at the same places.
    """

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(text)
        model, extra = spec["model"], spec["added_tokens"]
        plain = not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model.get("byte_fallback"))
        simple = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in extra)
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or not plain or not simple or spec["decoder"] or spec["post_processor"]:
            raise ValueError("a byte-level BPE vocabulary with a word suffix and no decoder is needed")
        self.whole = Tokenizer.from_str(text)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.word_model = self.whole.model
        self.text, names = text, token_names(text).to_pylist()
        suffix, byte_of = model["end_of_word_suffix"], {c: b for b, c in enumerate(byte_chars())}
        special = {t["id"] for t in extra}
        self.raw = [b"" if i in special else bytes(byte_of[c] for c in n.removesuffix(suffix)) for i, n in enumerate(names)] + [b" "]
        self.n_bytes = np.array([len(b) for b in self.raw])
        #: What may come before a run: the end of a word, a special token, or white space (the last place, which is that of MARK).
        self.closes = np.array([i in special or n.endswith(suffix) for i, n in enumerate(names)] + [True])
        self.bars = np.array([i in special for i in range(len(names))] + [True])
        self.specials = sorted((t["content"] for t in extra), key=len, reverse=True)
        at = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cc")]
        white = "".join(c for c in at if self.whole.normalizer.normalize_str(c) == " ")
        self.white = re.compile(f"[{re.escape(white)}]+")
        if not set("\t\n\v\f\r ") <= set(white):
            raise ValueError("the vocabulary's normalizer must make white space of ASCII white space")
        self.plain = all(PATTERN == p["pattern"].get("Regex") for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self.known: dict[str, tuple[int, ...]] = {}

    # -- short texts

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text (null: none). White space parts words for certain, so each distinct word is encoded once."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        distinct = words.flatten().dictionary_encode()
        flat = pc.take(self.word_ids(distinct.dictionary.to_pylist()), distinct.indices)
        ends = flat.offsets.to_numpy()[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.values)

    def word_ids(self, words: list[str]) -> pa.ListArray:
        """Ids of texts without ASCII white space: the model alone splits and merges ASCII and Latin-1 words, the library the rest."""
        known, tokenize, special, latin = self.known, self.word_model.tokenize, self.special.search, LATIN.fullmatch
        others = [w for w in words if not self.plain or not latin(w) or special(w)]
        by_library = {w: e.ids for w, e in zip(others, self.whole.encode_batch(others, add_special_tokens=False), strict=True)}
        flat: list[int] = []
        ends = [0]
        for word in words:
            if (ids := by_library.get(word)) is not None:
                flat += ids
            else:
                for run in LATIN_RUNS.findall(word.lower()):
                    if (run_ids := known.get(run)) is None:
                        chars = run if run.isascii() else "".join(map(byte_chars().__getitem__, run.encode()))
                        run_ids = known[run] = tuple(t.id for t in tokenize(chars))
                    flat += run_ids
            ends.append(len(flat))
        if len(known) > KNOWN_RUNS:
            known.clear()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    # -- leaves and their joins

    @cached_property
    def inner_model(self):
        """Merges without the suffix, for windows that do not reach the end of a word."""
        from tokenizers.models import BPE

        model = json.loads(self.text)["model"]
        return BPE(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def cut_places(self, text: str, leaf_chars: int) -> list[int]:
        """Where a long text is cut: every ``leaf_chars`` characters, or as soon after as no special token or composed character is cut."""
        longest = max(map(len, self.specials), default=1)
        places, at = [0], leaf_chars
        while at < len(text):
            while at < len(text) and not starts_anew(text[at]):
                at += 1
            around = text[max(0, at - longest + 1) : at + longest - 1]
            inside = [m for s in self.specials for m in re.finditer(re.escape(s), around) if m.start() < min(at, longest - 1) < m.end()]
            at += inside[0].end() - min(at, longest - 1) if inside else 0
            if not inside and at < len(text):
                places.append(at)
                at += leaf_chars
        return [*places, len(text)]

    def leaf(self, text: str) -> np.ndarray:
        """Ids of one leaf, with a MARK for each run of white space."""
        words = self.white.split(text)
        ids = self.word_ids(words)
        return np.insert(ids.values.to_numpy(), ids.offsets.to_numpy()[1:-1], MARK)

    def text_of(self, ids: np.ndarray) -> bytes:
        return b"".join([self.raw[i] for i in ids.tolist()])

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """Places in ``ids`` at which a run of the pattern starts."""
        before = np.r_[True, self.closes[ids[:-1]]] if len(ids) else np.zeros(0, bool)
        return np.flatnonzero(before & (ids != MARK))

    def settled(self, left: np.ndarray) -> int:
        """The last place in ``left`` at which a run starts whatever follows ``left``."""
        span = 64
        while True:
            tail = left[-span:]
            bar = np.flatnonzero(self.bars[tail])
            low = int(bar[-1]) + 1 if len(bar) else 0
            left_of = np.cumsum(self.n_bytes[tail][::-1])[::-1]
            starts = [s for s in self.runs(tail).tolist() if s > low and left_of[s] >= AHEAD and (s or span >= len(left))]
            if starts:
                return len(left) - len(tail) + starts[-1]
            if len(bar) or span >= len(left):
                return len(left) - len(tail) + low
            span *= 4

    def model_ids(self, raw: bytes, ends: bool) -> list[int]:
        chars = byte_chars()
        return [t.id for t in (self.word_model if ends else self.inner_model).tokenize("".join([chars[b] for b in raw]))]

    def glued(self, raw: bytes, before: np.ndarray, after: np.ndarray) -> list[int]:
        """Ids of one unsplit run ``raw``, whose beginning encodes as ``before`` and whose end as ``after``.

        A window over what lies between grows until it begins and ends with
        tokens that the two sides have there, or reaches the ends of the run.
        """
        size = WINDOW
        while True:
            l, r = max(0, len(before) - size), min(len(after), size)
            low = int(self.n_bytes[before[:l]].sum())
            high = len(raw) - int(self.n_bytes[after[r:]].sum())
            ids = self.model_ids(raw[low:high], high == len(raw))
            if (not l or ids[0] == before[l]) and (r == len(after) or ids[-1] == after[r - 1]):
                return [*before[:l].tolist(), *ids, *after[r:].tolist()]
            size *= 2

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of a text from those of its two halves.

        From the last settled run of the left half on, a window over the join is
        split by the pattern again, and grows to the right until one of its runs
        starts where one of the right half does. Runs before that are encoded
        anew, long ones by ``glued``.
        """
        if not len(left) or not len(right) or self.bars[left[-1]] or self.bars[right[0]]:
            return np.concatenate([left, right])
        at = self.settled(left)
        tail, size = left[at:], 4
        while True:
            starts = self.runs(right[: 64 * size])
            to = int(starts[size]) if size < len(starts) else min(len(right), 64 * size)
            bar = np.flatnonzero(self.bars[right[:to]])
            to = int(bar[0]) if len(bar) else to
            done = bool(len(bar)) or to == len(right)
            ids = self.bridge(tail, right[:to], done)
            if ids is not None:
                new, used = ids
                return np.concatenate([left[:at], np.array(new, np.int32), right[used:]])
            size *= 2

    def bridge(self, tail: np.ndarray, head: np.ndarray, done: bool) -> tuple[list[int], int] | None:
        """New ids from the start of ``tail`` up to a place in ``head``, and that place; None if the window must grow."""
        text = self.text_of(tail) + self.text_of(head)
        if not done:  # the window may end within a character
            text = text[: len(text.decode(errors="ignore").encode())]
        join = int(self.n_bytes[tail].sum())
        t_runs, h_runs = self.runs(tail), self.runs(head)
        t_ends, h_ends = np.r_[0, np.cumsum(self.n_bytes[tail])], join + np.r_[0, np.cumsum(self.n_bytes[head])]
        t_at = dict(zip(t_ends[t_runs].tolist(), t_runs.tolist(), strict=True))
        h_at = dict(zip(h_ends[h_runs].tolist(), h_runs.tolist(), strict=True))
        h_close = {int(h_ends[i + 1]): i + 1 for i in np.flatnonzero(self.closes[head]).tolist()}
        new: list[int] = []
        end = char = 0
        for name, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text.decode()):
            start = end + a - char
            if start >= join and start in h_at and (done or len(text) - start >= AHEAD):
                return new, h_at[start]
            end, char = start + len(name), b
            if end - start <= SHORT_RUN:
                new += self.model_ids(text[start:end], True)
                continue
            before = tail[t_at[start] : -1] if start in t_at and end > join else tail[:0]
            if len(before) and self.closes[before].any():
                before = tail[:0]
            close = h_close.get(end)
            opens = [i for i in h_runs.tolist() if close is not None and i < close]
            after = head[opens[-1] : close] if opens else head[:0]
            new += self.glued(text[start:end], before, after)
        return (new, len(head)) if done else None

    def tree(self, leaves: list[np.ndarray]) -> np.ndarray:
        """Ids of a text from those of its leaves, joined two by two until one is left; without marks."""
        while len(leaves) > 1:
            leaves = [self.joined(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0][leaves[0] != MARK]


@lru_cache(maxsize=4)
def codec(text: str) -> Codec:
    # A task has a core of its own; the library's threads would take those of others.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(text)


def packed(ids: pa.ListArray) -> pa.Array:
    """Each list of ids as little-endian unsigned 32-bit integers."""
    flat = ids.values.to_numpy().astype("<u4", copy=False)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((ids.offsets.to_numpy() * 4).astype(np.int32)), pa.py_buffer(flat)])


def encode(docs: DataFrame, vocabulary: str, keep: list[str] | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """row (a struct of ``keep``, all columns if None), n_tokens and ids of each text of ``docs``, one row per input row.

    ``vocabulary`` is the JSON text of a tokenizers file (see ``Codec``); ids
    are little-endian unsigned 32-bit integers, those of the library for the
    whole text without added special tokens, truncation or padding. A null or
    empty text has no ids; repeated rows are encoded each; an empty table
    gives none. Only the column text is looked at.

    A text of more than ``leaf_chars`` characters is cut into leaves, wherever
    that falls, which tasks encode in parallel; a task then joins those of one
    text two by two. Only long texts are shuffled, and come back as ids. A task
    holds one text at most, as its row does. Input rows are numbered where they
    are read, so ``docs`` should be read from files.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # a few MB, whatever the corpus
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in (keep or docs.columns)]).alias("row"), F.col("text").cast("string").alias("text"))
    row = rows.schema["row"]
    n_tokens, ids_field = T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = use.encode(part.column("text"))
                counts = pc.list_value_length(ids).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("row"), counts, packed(ids)], ["row", "n_tokens", "ids"])

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                places = use.cut_places(text, leaf_chars)
                n = len(places) - 1
                # The row goes with the first leaf.
                own = pa.concat_arrays([batch.column("row").slice(i, 1), pa.nulls(n - 1, batch.column("row").type)])
                columns = [pa.array([batch.column("at")[i].as_py()] * n), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([text[a:b] for a, b in zip(places, places[1:], strict=False)])], ["at", "seq", "n", "row", "text"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = pa.array([use.leaf(t).astype("<i4").tobytes() for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("at", "seq", "n", "row")), ids], ["at", "seq", "n", "row", "ids"])

    def join_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared.value)
        leaves: list[np.ndarray] = []
        for batch in batches:
            for i, (n, raw) in enumerate(zip(batch.column("n").to_pylist(), batch.column("ids"), strict=True)):
                if not leaves:
                    own = batch.column("row").slice(i, 1)
                leaves.append(np.frombuffer(raw.as_buffer(), "<i4"))
                if len(leaves) == n:
                    ids = use.tree(leaves)
                    leaves = []
                    columns = [own, pa.array([len(ids)], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "n_tokens", "ids"])

    out = T.StructType([row, n_tokens, ids_field])
    is_long = F.coalesce(F.length("text") > leaf_chars, F.lit(False))
    place = [T.StructField("at", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("row", row.dataType)]
    leaves = (
        rows.withColumn("at", F.monotonically_increasing_id()).where(is_long)
        .mapInArrow(to_leaves, T.StructType([*place, T.StructField("text", T.StringType())]))
    )
    parts = spark.sparkContext.defaultParallelism * 4
    done = (
        leaves.repartition(parts, "at", "seq").mapInArrow(encode_leaves, T.StructType([*place, ids_field]))
        .repartition(parts, "at").sortWithinPartitions("at", "seq").mapInArrow(join_leaves, out)
    )
    return rows.where(~is_long).mapInArrow(short, out).unionByName(done)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of its column ids (see ``encode``; null: null), special tokens included."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    columns = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = token_names(shared.value)
        for batch in batches:
            for part in slices(batch, "ids"):
                yield pa.RecordBatch.from_arrays([*part.columns, names_of(part.column("ids"), names)], [*columns, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())]))
