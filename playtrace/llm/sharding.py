"""Sharding into parts of nearly equal bytes by histogram sort.

Documents are ordered by a key: a hash of the text, then of id and text, then of a row number written once. So
equal texts lie side by side, and a group of copies of any size can still be split. Each round counts the exact
bytes below candidate boundaries, the probes, over all partitions; the probes then move into the ranges that
hold a wanted boundary, until all are within the tolerance (or no key lies between). Rows move once, at the end.

Nulls: a null text has no bytes, and counts as empty for its checksum; null ids are ids like any other. Repeated rows are documents of
their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.common import packed, query, table
from playtrace.session import durable

SHARDS, OVERHEAD, TOLERANCE, PROBES = 40, 16, 0.001, 15
KEYS = ("_k1", "_k2", "_k3")


def _packed(keys: list[np.ndarray]) -> np.ndarray:
    """Signed 64-bit columns as byte strings in the same order."""
    flipped = np.empty((len(keys[0]), len(keys)), ">u8")  # most significant byte first
    for i, k in enumerate(keys):
        flipped[:, i] = k.view(np.uint64) ^ np.uint64(1 << 63)
    return flipped.view("S24")[:, 0]


def _below(probes: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = _packed([batch.column(k).to_numpy() for k in KEYS])
            order = np.argsort(packed)
            packed, size = packed[order], batch.column("_size").to_numpy()[order]
            cuts = np.concatenate([[0], np.searchsorted(packed, probes, "right"), [len(packed)]])
            sums = np.concatenate([[0], np.cumsum(size)])
            full = np.flatnonzero(np.diff(cuts))
            key = [packed[i].ljust(24, b"\0") for i in cuts[full]], [packed[i - 1].ljust(24, b"\0") for i in cuts[full + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(sums[cuts[full + 1]] - sums[cuts[full]], pa.int64()), pa.array(key[0], pa.binary()), pa.array(key[1], pa.binary())], ["range", "bytes", "low", "high"])

    return count


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """shards - 1 keys, as numbers of 192 bits; a shard holds the keys above one and up to the next.

    rows has _k1, _k2, _k3 and _size. Every round brings a row for each range between probes to the driver: at
    most (PROBES + 2) * shards.
    """
    top = 1 << 192
    probes, done, total = [top * (i + 1) // (shards * 8) for i in range(shards * 8 - 1)], {}, None
    while True:
        packed = np.array([p.to_bytes(24, "big") for p in probes], "S24")
        found = rows.select(*KEYS, "_size").mapInArrow(_below(packed), "range int, bytes long, low binary, high binary")
        found = {r[0]: r for r in found.groupBy("range").agg(F.sum("bytes"), F.min("low"), F.max("high")).collect()}
        if total is None:
            total = sum(r[1] for r in found.values())
        slack, at, fresh = total / shards * tolerance, 0, set()
        edges = [(0, -1)]  # bytes up to and with a key
        for i in range(len(probes) + 1):
            if i in found:
                at += found[i][1]
            edges.append((at, probes[i] if i < len(probes) else top - 1))
        ends = np.array([e[0] for e in edges])
        for k in range(1, shards):
            if k in done:
                continue
            want = total * k / shards
            i = int(np.searchsorted(ends, want))  # the range with the wanted byte ends at edge i
            i = min(max(i, 1), len(edges) - 1)
            near = min((edges[i - 1], edges[i]), key=lambda e: abs(e[0] - want))
            if abs(near[0] - want) <= slack or i - 1 not in found:
                done[k] = near[1]
                continue
            low, high = (int.from_bytes(bytes(x).ljust(24, b"\0"), "big") for x in found[i - 1][2:])
            if low == high:
                done[k] = near[1]
                continue
            step = high - low  # the lowest key is a probe itself, so the range always shrinks
            fresh |= {low + step * j // (PROBES + 1) for j in range(PROBES + 1)} | {low - 1 if low else 0}
            fresh |= {edges[i - 1][1]} if edges[i - 1][1] >= 0 else set()
            fresh |= {edges[i][1]}
        if not fresh:
            return sorted(done[k] for k in range(1, shards))
        probes = sorted(fresh)


def shard(docs: DataFrame, columns: list[str], shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``columns`` of docs with _size, _crc, _shard and _slot (the row's place in its shard, gapless from 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"_size": (F.octet_length(text) + OVERHEAD).cast("long"), "_crc": F.crc32(text.cast("binary")), "_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), "doc_id", text), "_k3": F.xxhash64(F.monotonically_increasing_id())})
    rows = durable(keyed.select(*columns, "_size", "_crc", *KEYS))
    cuts = splitters(rows, shards, tolerance)
    cuts = [[((c >> s) & ((1 << 64) - 1)) - (1 << 63) for s in (128, 64, 0)] if c >= 0 else None for c in cuts]

    def above(c: list[int] | None):
        if c is None:  # a boundary before all keys
            return F.lit(True)
        a, b, d = (F.col(k) for k in KEYS)
        x, y, z = (F.lit(v).cast("long") for v in c)
        return (a > x) | ((a == x) & ((b > y) | ((b == y) & (d > z))))

    number = F.lit(0)
    for c in cuts:
        number = number + above(c).cast("int")
    rows = rows.withColumn("_shard", number).withColumns({"_p1": F.shiftright("_k1", 54), "_p2": F.shiftright("_k2", 58)})
    by = ["_shard", "_p1", "_p2"]  # at most 65,536 parts of a shard, in the order of the keys
    before = Window.partitionBy("_shard").orderBy("_p1", "_p2").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by).orderBy(*KEYS)
    placed = rows.withColumn("_in", F.row_number().over(within)).join(starts, by).withColumn("_slot", F.col("_before") + F.col("_in") - 1)
    return placed.select(*columns, "_size", "_crc", "_shard", "_slot")


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of docs, and the numbers shard and slot (replacing columns of these names)."""
    rows, back = packed(docs.select(*[c for c in docs.columns if c.lower() not in ("shard", "slot")]), ["doc_id", "text"])
    return shard(rows, rows.columns, shards).select(*back.values(), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


@query("op9_histogram_shards")
def _(spark, sf_dir):
    s = shard(table(spark, sf_dir, "documents"), ["doc_id"])
    return s.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
