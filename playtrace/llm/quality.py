"""Quality classification by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of terms: shapes of three neighbouring characters (letters, capitals, digits, blanks and kinds of punctuation,
runs drawn together), pairs of plain shapes, hashed lower-case words, and words that recur at once. Logarithmic counts, weighted by rarity in the labelled sample,
are reduced to DIMENSIONS by a truncated singular value decomposition. The labelled vectors are broadcast, their
number is at most PER_LABEL for each label, and every document's cosines to all of them are computed
in blocks. The NEIGHBOURS most similar ones vote, weighted by similarity to the power SHARPNESS and, so that a rare label
is not outvoted by numbers, by one over the number of its labelled vectors.

The sample: the PER_LABEL labelled texts of each label that come first in order of the id's md5. Nothing outside it is learned from.
Their terms are counted where the texts are; the driver gets a row of terms for each, 7.6 KB.

Nulls: rows of labels with a null id or label teach nothing; a null or empty text (any text without terms) scores 0; a null
id counts as held out. Repeated rows get equal results and teach once; an id with several texts or labels teaches all pairs of them,
as far as they are among the first PER_LABEL. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.common import Words, byte_codes, crc_of, query, released, slices, table, text_slices

PER_LABEL, DIMENSIONS, NEIGHBOURS, SHARPNESS, THRESHOLD, SEED = 1000, 48, 15, 4, 0.7, 7
WORD_BUCKETS = 512

_CODES = byte_codes(7)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_KINDS = 12
_KIND = np.full(256, 10, np.int32)
_KIND[128:] = 0
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".", ",;:", "!?", "|", "#$%&*@^~=<>")):
    _KIND[list(_chars.encode())] = _k
ECHOES = 4
_TERMS = _KINDS**3 + _KINDS**2 + WORD_BUCKETS + ECHOES


def terms(texts: list[bytes]) -> np.ndarray:
    """A row of 1 + log(count) of each term for each text."""
    out = np.zeros((len(texts), _TERMS), np.float32)
    words = Words(texts, _CODES)
    if not len(words.data):
        return out
    data, n = words.data, len(texts)
    kind = _KIND[data]
    breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1) - 1  # the line feed between two texts
    kind[breaks] = 11
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.concatenate([[0], breaks + 1])))

    def add(first: int, size: int, code: np.ndarray, of: np.ndarray):
        """Count codes text by text, so that the work follows the text and the table stays small."""
        ends = np.searchsorted(of, np.arange(n + 1))
        for i in range(n):
            out[i, first : first + size] = np.bincount(code[ends[i] : ends[i + 1]], minlength=size)

    own = kind != 11
    pair = (own[1:] & own[:-1]).nonzero()[0]
    add(_KINDS**3, _KINDS**2, kind[pair] * _KINDS + kind[pair + 1], doc[pair])
    turn = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    k, d = kind[turn], doc[turn]
    triple = np.flatnonzero((d[:-2] == d[2:]) & (k[2:] != 11)) if len(k) > 2 else np.zeros(0, np.int64)
    add(0, _KINDS**3, (k[triple] * _KINDS + k[triple + 1]) * _KINDS + k[triple + 2], d[triple])
    add(_KINDS**3 + _KINDS**2, WORD_BUCKETS, (words.hash % np.uint64(WORD_BUCKETS)).astype(np.int64), words.doc)
    for gap in range(1, ECHOES + 1):
        again = (words.doc[gap:] == words.doc[:-gap]) & (words.hash[gap:] == words.hash[:-gap])
        out[:, _TERMS - gap] = np.bincount(words.doc[gap:][again], minlength=n)
    np.log1p(out, out=out)
    return out


@dataclass
class Model:
    weights: np.ndarray  # of each term
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled, of length 1
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = (counts * self.weights) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out, share = np.zeros(len(texts)), 1 / np.bincount(self.labels.astype(int), minlength=2).clip(1)[self.labels.astype(int)]
        for a in range(0, len(texts), 256):
            counts = terms(texts[a : a + 256])
            cosine = np.maximum(self.project(counts) @ self.vectors.T, 0)
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.take_along_axis(cosine, near, 1).astype(np.float64) ** SHARPNESS * share[near]
            total = weight.sum(1)
            votes = (weight * self.labels[near]).sum(1)
            out[a : a + 256] = np.where(counts.any(1) & (total > 0), votes / np.maximum(total, 1e-300), 0.0)
        return np.clip(out, 0, 1)


def train(texts: list[bytes], labels: list[int], seed: int = SEED) -> Model:
    return model_of(np.concatenate([terms(texts[a:b]) for a, b in slices(texts)]) if texts else np.zeros((0, _TERMS), np.float32), labels, seed)


def model_of(counts: np.ndarray, labels: list[int], seed: int = SEED) -> Model:
    """The model of labelled rows of terms, at most 2 * PER_LABEL."""
    rarity = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = counts * rarity
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.maximum(lengths, 1e-12)
    rank = min(DIMENSIONS, *x.shape)
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], rank)).astype(np.float32)
    for _ in range(6):  # subspace iteration towards the leading right singular vectors
        basis = np.linalg.qr(x.T @ (x @ basis))[0] if len(x) else basis
    model = Model(rarity, np.ascontiguousarray(basis[:, :rank]), np.zeros((0, rank), np.float32), np.asarray(labels, np.float64))
    model.vectors = model.project(counts)
    return model


def sample(docs: DataFrame, labels: DataFrame, learnable: Column) -> DataFrame:
    """(quality, doc_id, _hash, text): the PER_LABEL labelled texts of each label that come first in order of the id's md5, the id and the text's hash."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]

    def first(rows: DataFrame, part: Column, order: list) -> DataFrame:
        """PER_LABEL rows of each label; of each part first, so that no task gets a whole label."""
        for within in (["quality", part], ["quality"]):
            rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_r") <= PER_LABEL)
        return rows.drop("_r")

    known = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(learnable & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    ids = first(marked.join(known.select("doc_id").distinct(), "doc_id"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 128, order)
    ids = F.broadcast(ids)  # at most 2 * PER_LABEL rows
    texts = known.withColumn("_hash", F.xxhash64("text"))
    chosen = first(texts.join(ids, "doc_id").select("doc_id", "quality", "_hash").distinct(), F.pmod("_hash", F.lit(128)), [*order, "_hash"])
    rows = texts.join(F.broadcast(chosen), ["doc_id", "_hash"])
    return rows.groupBy("quality", "doc_id", "_hash").agg(F.first("text").alias("text"))


def _labelled(chosen: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The terms and labels of a sample in a fixed order; terms are counted in tasks, so no text reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                rows = pa.array([x.tobytes() for x in terms(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in ("quality", "doc_id", "_hash")), rows], ["quality", "doc_id", "_hash", "terms"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    got = chosen.mapInArrow(released(run), f"quality int, doc_id {kind}, _hash long, terms binary").collect()
    got.sort(key=lambda r: tuple(r)[:3])
    counts = np.array([np.frombuffer(r["terms"], np.float32) for r in got]) if got else np.zeros((0, _TERMS), np.float32)
    return counts, [r["quality"] for r in got]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of(doc_id) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return model_of(*_labelled(sample(docs, labels, ~held_out(F.col("doc_id")))))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                score = shared.value.score(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("held_out")[a:b], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be of quality, with all their columns; all of them if nothing is labelled."""
    model = fit(docs, labels)
    if not len(model.labels):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                yield batch[a:b].filter(pa.array(shared.value.score(texts) >= THRESHOLD))

    return docs.mapInArrow(released(keep), docs.schema)


@query("op7_neighbour_quality")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
