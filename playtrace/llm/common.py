"""What several operators share: reading a table, word boundaries, and the registry of queries."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrace.plans.registry import shipped

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = shipped(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, core: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """docs with its other columns in one, _others, so that no name can clash; and how to get each column of docs back."""
    others = [c for c in docs.columns if c not in core]
    both = docs.select(*core, (F.struct(*others) if others else F.lit(0)).alias("_others"))
    return both, {c: F.col(c) if c in core else F.col("_others")[c].alias(c) for c in docs.columns}


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte value, from a seed."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
UNBASE = pow(BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, or of its inverse; kept for the next call."""
    key = "inverse" if inverse else "plain"
    if key not in _POWERS or len(_POWERS[key]) < n:
        size = max(n, 1 << 16)
        p = np.full(size, UNBASE if inverse else BASE, np.uint64)
        p[0] = 1
        _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[key][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BLOCK = 1 << 20


def no_space(data: np.ndarray) -> np.ndarray:
    return ~_SPACE[data]


class Words:
    """The words of several byte strings at once: start, end, hash and string number of each word.

    Works through the bytes in blocks that end between words, so the large temporary arrays have one block's size.
    """

    def __init__(self, texts: list[bytes], codes: np.ndarray, inside=no_space):
        """codes: 64-bit number of each byte value. inside(bytes): which bytes belong to words, never line feeds."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = data = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(texts)]
        mask = inside(data)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
        self.start, self.end = edges[::2], edges[1::2]
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.hash, first = np.zeros(len(self.start), np.uint64), 0
        while first < len(self.start):
            low = self.start[first]
            last = max(first + 1, int(np.searchsorted(self.end, low + BLOCK, "right")))
            part = data[low : self.end[last - 1]]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(codes[part] * powers(len(part)), out=total[1:])
            a, b = self.start[first:last] - low, self.end[first:last] - low
            self.hash[first:last] = mixed((total[b] - total[a]) * powers(len(part) + 1, True)[a])
            first = last

    def grams(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each run of n words within one string, and the run's hash."""
        h = self.hash if hashes is None else hashes
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[: len(h) - n + 1] == self.doc[n - 1 :])
        out = np.zeros(len(first), np.uint64)
        for k in range(n):
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + h[first + k])
        return first, out


def slices(texts: list[bytes], most: int = 2_000_000):
    """Index ranges of neighbouring texts of about `most` bytes together; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def bytes_of(column) -> list[bytes]:
    """An Arrow column of texts or binary values; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def text_slices(*columns, most: int = 2_000_000) -> Iterator[tuple]:
    """Neighbouring rows of some columns of texts, of about `most` bytes together: first and last index and the texts of each column, so that only these are copied."""
    each = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    sizes, a = np.cumsum(sum(each)), 0
    while a < len(sizes):
        before = int(sizes[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield a, b, *(bytes_of(c[a:b]) for c in columns)
        a = b


def released(run):
    """A function of Arrow batches that gives back the memory it held when a task ends; workers live on for the next tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()

    return wrapped
