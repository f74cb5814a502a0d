"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read as UTF-8 bytes, capitals of ASCII folded and all but letters read as blanks, in pieces of PIECE bytes, which run through the network side by side. Two gated recurrent layers, one
in each direction, label every byte with probabilities of the languages; the means over the bytes of letters are
the document's probabilities. Gates and states use x / (1 + |x|) in place of the usual curves, which is as good here
and needs no exponentials.

Trained in numpy on the driver, by backpropagation through time, on PER_LANGUAGE texts of each language at most: those whose ids
come first in order of md5. Seeds are fixed, so reruns agree.

Nulls: rows with a null id or lang teach nothing; a null text or one without letters is `und` with score 0; a null id
counts as held out. Repeated rows get equal results. With nothing to learn from, every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.common import bytes_of, crc_of, query, slices, table

PIECE, WIDTH, HIDDEN = 128, 2048, 8
PER_LANGUAGE, PIECES_PER_TEXT, TRAIN_PIECE, ROUNDS, BATCH, RATE, SEED = 64, 12, 64, 260, 256, 0.02, 5

_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LETTER[128:] = True
_FOLD = np.where(_LETTER, np.arange(256), ord(" ")).astype(np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * x / (1 + np.abs(x))


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Layer:
    """A gated recurrent layer over byte values. x: time x batch; states: time x hidden x batch."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.p = {
            "e": rng.normal(0, 0.5, (3 * hidden, 256)).astype(np.float32),  # what a byte adds to both gates and the candidate
            "u": rng.normal(0, 0.4, (3 * hidden, hidden)).astype(np.float32),
        }

    def forward(self, x: np.ndarray, keep: bool = False):
        k, (steps, batch) = self.h, x.shape
        states = np.empty((steps, k, batch), np.float32)
        h, cache = np.zeros((k, batch), np.float32), []
        e, u = self.p["e"], self.p["u"]
        for t in range(steps):
            a, b = e.take(x[t], axis=1), u @ h
            s = a[: 2 * k]
            s += b[: 2 * k]
            d = np.abs(s)
            d += 1
            s /= d
            s *= 0.5
            s += 0.5
            z, r = s[:k], s[k:]
            n = r * b[2 * k :]
            n += a[2 * k :]
            d = np.abs(n)
            d += 1
            n /= d
            if keep:
                cache.append((h, z, r, n, b[2 * k :]))
            new = np.subtract(h, n, out=states[t])
            new *= z
            new += n
            h = new
        return (states, cache) if keep else states

    def backward(self, x: np.ndarray, cache: list, upstream: np.ndarray) -> dict[str, np.ndarray]:
        k, (steps, batch) = self.h, x.shape
        u, du = self.p["u"], np.zeros_like(self.p["u"])
        inputs = np.empty((steps, 3 * k, batch), np.float32)
        carry = np.zeros((k, batch), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, n, un = cache[t]
            dh = upstream[t] + carry
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dn * un * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            inputs[t] = np.concatenate([dz, dr, dn])
            back = np.concatenate([dz, dr, dn * r])
            du += back @ h.T
            carry = dh * z + u.T @ back
        flat = x.reshape(-1)
        one_hot = np.zeros((flat.size, 256), np.float32)
        one_hot[np.arange(flat.size), flat] = 1
        return {"e": inputs.transpose(1, 0, 2).reshape(3 * k, -1) @ one_hot, "u": du}


@dataclass
class Model:
    languages: list[str]
    ahead: Layer | None = None
    back: Layer | None = None
    w: np.ndarray | None = None  # languages x (2 * hidden + 1)

    def logits(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = f.shape[1]
        return self.w[:, :k] @ f + self.w[:, k : 2 * k] @ b + self.w[:, 2 * k :]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language at every byte. x: time x batch."""
        y = self.logits(self.ahead.forward(x), self.back.forward(x[::-1])[::-1])
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over each text's letters; zeros for a text without any."""
        total, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        counts = np.array([-(-len(t) // PIECE) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        for a in range(0, len(owner), WIDTH):
            part = [texts[i][p * PIECE : (p + 1) * PIECE].ljust(PIECE) for i, p in zip(owner[a : a + WIDTH].tolist(), begin[a : a + WIDTH].tolist())]
            x = np.ascontiguousarray(_FOLD[np.frombuffer(b"".join(part), np.uint8)].reshape(len(part), PIECE).T)
            mask = _LETTER[x]
            y = self.probabilities(x)
            y *= mask[:, None, :]
            np.add.at(total, owner[a : a + WIDTH], y.sum(0, dtype=np.float64).T)
            np.add.at(letters, owner[a : a + WIDTH], mask.sum(0))
        return total / np.maximum(letters, 1)[:, None]


def cut(text: bytes, seed: int) -> list[bytes]:
    """PIECES_PER_TEXT pieces for training, from random places of the whole text."""
    rng = np.random.default_rng([SEED, seed])
    places = rng.integers(0, max(1, len(text) - TRAIN_PIECE + 1), PIECES_PER_TEXT).tolist()
    return [text[p : p + TRAIN_PIECE].ljust(TRAIN_PIECE) for p in places]


def train(pieces: list[bytes], languages: list[str], seed: int = SEED) -> Model:
    """Fit on pieces of TRAIN_PIECE bytes, equally many of each language in every round."""
    names = sorted(set(languages))
    model = Model(names)
    if not names:
        return model
    rng = np.random.default_rng(seed)
    data = _FOLD[np.frombuffer(b"".join(pieces), np.uint8)].reshape(len(pieces), TRAIN_PIECE)
    target = np.array([names.index(lang) for lang in languages])
    groups = [np.flatnonzero(target == c) for c in range(len(names))]
    model.ahead, model.back = Layer(rng, HIDDEN), Layer(rng, HIDDEN)
    model.w = rng.normal(0, 0.3, (len(names), 2 * HIDDEN + 1)).astype(np.float32)
    params = [(model.ahead.p, "e"), (model.ahead.p, "u"), (model.back.p, "e"), (model.back.p, "u"), ({"w": model.w}, "w")]
    moments = [(np.zeros_like(d[n]), np.zeros_like(d[n])) for d, n in params]
    for step in range(1, ROUNDS + 1):
        pick = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups])
        x, want = np.ascontiguousarray(data[pick].T), target[pick]
        f, cf = model.ahead.forward(x, True)
        b, cb = model.back.forward(x[::-1], True)
        b = b[::-1]
        y = model.logits(f, b)
        y = np.exp(y - y.max(1, keepdims=True))
        y /= y.sum(1, keepdims=True)
        y[:, want, np.arange(len(pick))] -= 1
        y *= (_LETTER[x] / max(1, _LETTER[x].sum()))[:, None, :]
        y = y.astype(np.float32)
        k = HIDDEN
        dw = np.concatenate([np.einsum("tcb,tkb->ck", y, f), np.einsum("tcb,tkb->ck", y, b), y.sum((0, 2))[:, None]], 1)
        gf = model.ahead.backward(x, cf, model.w[:, :k].T @ y)
        gb = model.back.backward(x[::-1], cb, (model.w[:, k : 2 * k].T @ y)[::-1])
        rate = RATE * (1 - 0.9 * step / ROUNDS)
        for (d, n), (m, v), g in zip(params, moments, (gf["e"], gf["u"], gb["e"], gb["u"], dw)):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            d[n] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of(doc_id) % 5 == 0, F.lit(True))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, doc, k, piece) for lang, doc, seed, text in zip(*(c.to_pylist() for c in batch.columns)) for k, piece in enumerate(cut(text, seed))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), batch.column(1).type, pa.int32(), pa.binary()))], ["lang", "doc_id", "k", "piece"])


def sample(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    """Pieces of at most PER_LANGUAGE texts of each language. Ids are chosen first, in bounded ranks."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]
    rank, part = Window.partitionBy("lang").orderBy(*order), Window.partitionBy("lang", "_part").orderBy(*order)
    chosen = rows.select("doc_id", "lang").distinct().withColumn("_part", crc_of(F.col("doc_id")) % 128)
    chosen = chosen.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= PER_LANGUAGE)  # of each part first, so that no task gets a whole language
    chosen = chosen.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= PER_LANGUAGE).select("doc_id", "lang")
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], chosen.schema)
    again = Window.partitionBy("doc_id", "lang").orderBy("text")
    picked = rows.select("doc_id", "lang", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"])
    picked = picked.withColumn("_r", F.row_number().over(again)).where("_r = 1").select("lang", "doc_id", crc_of(F.col("doc_id")).alias("seed"), "text")
    got = picked.mapInArrow(_pieces, f"lang string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, k int, piece binary").collect()
    got = sorted((tuple(r) for r in got), key=lambda r: r[:3])
    return [bytes(r[3]) for r in got], [r[0] for r in got]


def fit(docs: DataFrame) -> Model:
    return train(*sample(docs))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, known = bytes_of(batch.column("text")), batch.column("letters").to_pylist()
            for a, b in slices(texts):
                if not model.languages:
                    best, score = ["und"] * (b - a), [0.0] * (b - a)
                else:
                    p = model.pooled(texts[a:b])
                    top = p.argmax(1)
                    best = [model.languages[k] if ok else "und" for k, ok in zip(top.tolist(), known[a:b])]
                    score = [min(1.0, float(q)) if ok else 0.0 for q, ok in zip(p.max(1), known[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("held_out")[a:b], pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"), letters)
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


@query("op5_recurrent_language")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
