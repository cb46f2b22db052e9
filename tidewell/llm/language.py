"""Language identification by a byte-level convolutional network trained with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import unit_hash

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
EPOCHS = 10
BATCH = 64
RATE = 0.01
#: Bound of the labelled sample that trains the network: pieces of WINDOW characters from all places of all labelled texts,
#: the same number of each language, but LEAST_PER_LANG of each at least, however many languages there are.
MOST_PIECES = 6_000
LEAST_PER_LANG = 50
UNKNOWN = "und"


@dataclass
class ByteConvNet:
    """Byte embedding, convolutions of several widths, max pooling over the window, softmax."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Each filter bank as sums of table look-ups by byte pairs, and a last single byte for odd widths."""
        banks = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            each = [self.embed @ f[j * EMBED : (j + 1) * EMBED] for j in range(w)]
            bank = [(each[j][:, None, :] + each[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)]
            banks.append(bank + ([each[-1]] if w % 2 else []))
        return banks

    def log_probs(self, windows: np.ndarray, banks: list[list[np.ndarray]]) -> np.ndarray:
        """windows: (n, WINDOW) uint8."""
        byte = windows.astype(np.intp)
        pair = byte[:, :-1] * 256 + byte[:, 1:]
        pooled = []
        for w, bank, bias in zip(WIDTHS, banks, self.bias, strict=True):
            n = WINDOW - w + 1
            total = np.take(bank[0], pair[:, :n], axis=0)
            for j in range(1, w // 2):
                total += np.take(bank[j], pair[:, 2 * j : 2 * j + n], axis=0)
            if w % 2:
                total += np.take(bank[-1], byte[:, w - 1 : w - 1 + n], axis=0)
            pooled.append(np.maximum(total.max(axis=1) + bias, 0))
        return log_softmax(np.concatenate(pooled, axis=1) @ self.out + self.out_bias)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def cut_windows(text: bytes) -> np.ndarray:
    """All of a text as windows: the last one ends with the text, a shorter text is padded with zeros."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= WINDOW:
        out = np.zeros((1, WINDOW), np.uint8)
        out[0, : len(raw)] = raw
        return out
    full = len(raw) // WINDOW
    rows = raw[: full * WINDOW].reshape(full, WINDOW)
    return rows if full * WINDOW == len(raw) else np.vstack([rows, raw[-WINDOW:][None]])


def train(texts: list[bytes], labels: list[str], seed: int = 11, epochs: int = EPOCHS) -> ByteConvNet:
    """Fit the network with Adam on windows of the texts and on short pieces of them; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    code = {lang: i for i, lang in enumerate(langs)}
    windows, target = [], []
    for text, lang in zip(texts, labels, strict=True):
        for row in cut_windows(text):
            windows.append(row)
            target.append(code[lang])
        short = int(rng.integers(8, 90))
        at = int(rng.integers(0, max(1, len(text) - short)))
        windows.append(cut_windows(text[at : at + short])[0])
        target.append(code[lang])
    x, y = np.array(windows, np.uint8).reshape(-1, WINDOW), np.array(target, np.int64)
    share = np.bincount(y, minlength=len(langs)) / max(1, len(y))
    cost = (1 / np.maximum(share, 1e-9) / max(1, len(langs)))[y].astype(np.float32)
    p = {"e": rng.normal(0, 0.3, (256, EMBED)), "o": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), "ob": np.zeros(len(langs))}
    for k, w in enumerate(WIDTHS):
        p[f"f{k}"], p[f"b{k}"] = rng.normal(0, 0.3, (w * EMBED, FILTERS)), np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            byte = x[rows].astype(np.intp)
            e = p["e"][byte].reshape(len(rows), -1)
            pooled, where, columns = [], [], []
            for k, w in enumerate(WIDTHS):
                n = WINDOW - w + 1
                cols = np.lib.stride_tricks.as_strided(e, (len(rows), n, w * EMBED), (e.strides[0], 4 * EMBED, 4))
                z = (np.ascontiguousarray(cols).reshape(-1, w * EMBED) @ p[f"f{k}"]).reshape(len(rows), n, FILTERS)
                top = z.argmax(axis=1)
                where.append(top)
                columns.append(cols)
                pooled.append(np.take_along_axis(z, top[:, None, :], 1)[:, 0, :] + p[f"b{k}"])
            raw = np.concatenate(pooled, axis=1)
            act = np.maximum(raw, 0)
            d = np.exp(log_softmax(act @ p["o"] + p["ob"]))
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= (cost[rows] / len(rows))[:, None]
            g = {"o": act.T @ d, "ob": d.sum(axis=0), "e": np.zeros_like(p["e"])}
            back = (d @ p["o"].T) * (raw > 0)
            each = np.arange(len(rows))[:, None]
            for k, w in enumerate(WIDTHS):
                b = back[:, k * FILTERS : (k + 1) * FILTERS]
                seen = columns[k][each, where[k]]  # (rows, filters, w * EMBED)
                g[f"f{k}"] = np.einsum("nfc,nf->cf", seen, b)
                g[f"b{k}"] = b.sum(axis=0)
                into = (b[:, :, None] * p[f"f{k}"].T[None]).reshape(len(rows), FILTERS, w, EMBED)
                at_byte = byte[each[:, :, None], where[k][:, :, None] + np.arange(w)]
                np.add.at(g["e"], at_byte.ravel(), into.reshape(-1, EMBED))
            step += 1
            for name, grad in g.items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad * grad
                p[name] -= RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    span = range(len(WIDTHS))
    return ByteConvNet(langs, p["e"], [p[f"f{k}"] for k in span], [p[f"b{k}"] for k in span], p["o"], p["ob"])


def train_on(labelled: DataFrame, most_pieces: int = MOST_PIECES) -> ByteConvNet | None:
    """A network from ``labelled`` (doc_id, text, lang), or None if no row has both text and language.

    Each labelled text is cut into pieces of WINDOW characters; those with the
    smallest seeded hash train it, at most ``most_pieces`` in all, shared
    evenly by the languages (LEAST_PER_LANG of each at least).
    """
    usable = labelled.where("lang IS NOT NULL AND length(text) > 0").select("doc_id", "text", "lang", F.ceil(F.length("text") / WINDOW).cast("int").alias("n"))
    counts = usable.groupBy("lang").agg(F.sum("n").alias("n")).collect()  # one row for each language
    if not counts:
        return None
    each = max(LEAST_PER_LANG, most_pieces // len(counts))
    # Twice what is wanted is drawn by rate, so that little is ordered.
    rates = labelled.sparkSession.createDataFrame([(r.lang, 2 * each / r.n) for r in counts], "lang string, rate double")
    by_hash = lambda i: F.struct(unit_hash("doc_id", i, seed=1).alias("u"), i.alias("i"))
    places = F.filter(F.transform(F.sequence(F.lit(0), F.col("n") - 1), by_hash), lambda p: p["u"] < F.col("rate"))
    drawn = (
        usable.join(F.broadcast(rates), "lang")
        .withColumn("p", F.explode(places))
        .select("lang", F.col("p.u").alias("u"), F.substring("text", F.col("p.i") * WINDOW + 1, F.lit(WINDOW)).alias("piece"))
        .distinct()
        .withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("u", "piece")))
        .where(F.col("k") <= each)
        .select("lang", "piece")
        .collect()
    )
    drawn.sort(key=lambda r: (r.lang, r.piece))
    return train([r.piece.encode() for r in drawn], [r.lang for r in drawn]) if drawn else None


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """doc_id, lang_pred, score and all other columns of ``docs`` but text, by the text alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        banks = model.tables() if model else []
        for batch in batches:
            texts = batch.column("text")
            pred: list[str] = [UNKNOWN] * len(texts)
            score = np.zeros(len(texts))
            held: list[tuple[int, np.ndarray]] = []
            rows = 0

            def judge() -> None:
                logs = np.exp(np.concatenate([model.log_probs(w[i : i + 128], banks) for _, w in held for i in range(0, len(w), 128)]))
                first = np.cumsum([0] + [len(w) for _, w in held])[:-1]
                mean = np.add.reduceat(logs, first, axis=0) / np.array([len(w) for _, w in held])[:, None]
                for (i, _), p in zip(held, mean, strict=True):
                    pred[i], score[i] = model.langs[int(p.argmax())], float(min(1.0, p.max()))

            for i, value in enumerate(texts):
                if model is None or not value.is_valid or next(filter(str.isalpha, text := value.as_py()), None) is None:
                    continue
                held.append((i, cut_windows(text.encode())))
                rows += len(held[-1][1])
                if rows >= 2048:
                    judge()
                    held, rows = [], 0
            if held:
                judge()
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(pred, pa.string()), pa.array(score)], others + ["lang_pred", "score"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify_languages(docs: DataFrame, most_pieces: int = MOST_PIECES) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs`` (doc_id, text, lang).

    The network learns from rows whose crc32(doc_id as text) mod 3 is not 1
    and whose lang is not null; held_out marks the others by that remainder
    (a null doc_id counts as not held out and doesn't train). A prediction uses
    the whole text and nothing else: the mean over all its windows. A text that
    is null or has no letter, and every text if nothing could be learned, gets
    ``und`` with score 0. One row per input row, repeats included.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    net = train_on(docs.where(~held_out & F.col("doc_id").isNotNull()), most_pieces)
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), net)
