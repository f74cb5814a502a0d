"""How quality filters overlap: what each removes in every order of application, and what it removes alone.

A filter turns a text away or not, whatever ran before, so a document is fully told by the set of filters it fails. Every
count of the audit is a sum over (part, set of failed filters), a table of at most 32 rows for each part, which Spark adds up where the
documents are; the 120 orders are then read off that table.

The one filter that looks at other documents is the repeated text. A counting Bloom sketch of all texts comes first: each
task counts, up to two, the cells its texts' hashes fall on; the counts are added by block of cells. A text with a cell counted once is the
only one of its kind; all others are possible repeats. Only these are shuffled, whole, to find the least id of
each text, so a false alarm costs time but no error. The merged sketch keeps one bit a cell. It has CELLS to 2 * CELLS cells for each document and never over
2 ** MAX_BITS (128 MB), which is what is broadcast at most. Beyond 134 million documents it grows no further: more unique texts then count as possible
repeats and are shuffled, with the same result.

Nulls: a null text is empty; a null part is the empty part; a null id is never smaller nor larger than another, so such rows never count as
repeats, nor make others so. Rows with equal ids and texts are not repeats of each other, each counts. Labels with a null id say nothing; of several labels
of an id, 1 wins. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.llm.common import WORD, mixed, query, table

CELLS, HASHES, MAX_BITS, BLOCK_BITS = 8, 4, 30, 18
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, r"[#$%&*|]"
FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sketch_bits(documents: int) -> int:
    """The sketch of so many documents has 2 ** sketch_bits cells."""
    return min(MAX_BITS, max(10, math.ceil(math.log2(CELLS * documents + 1))))


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES cells of each 64-bit hash, one row for each of them."""
    a = mixed(hashes.astype(np.int64).view(np.uint64).copy())
    b = mixed(a ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) >> np.uint64(64 - bits) for k in range(HASHES)])


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketch(docs: DataFrame, bits: int) -> np.ndarray:
    """One bit for each cell: whether two or more texts fall on it. At most 2 ** MAX_BITS bits reach the driver."""
    block = min(bits, BLOCK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.sort(cells(batch.column(0).to_numpy(), bits).ravel())
            at = at[np.concatenate([[True, True], at[2:] != at[:-2]])[: len(at)]]  # each cell twice at most
            ends = np.flatnonzero(np.diff(at >> np.uint64(block))) + 1
            for part in np.split(at, ends) if len(at) else ():
                inside = (part & np.uint64(2**block - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([int(part[0] >> np.uint64(block))], pa.int64()), pa.array([inside.tobytes()], pa.binary())], ["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, inside in zip(batch.column("block").to_pylist(), batch.column("cells")):
                counts = seen.setdefault(b, np.zeros(2**block, np.uint8))
                more = np.bincount(np.frombuffer(inside.as_buffer(), np.uint32), minlength=2**block)
                np.minimum(counts + np.minimum(more, 2).astype(np.uint8), 2, out=counts)
        for b, counts in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())], ["block", "cells"])

    schema = "block long, cells binary"
    parts = docs.select(text_hash().alias("_hash")).mapInArrow(count, schema)
    out = np.zeros((2 ** (bits - block), 2**block // 8), np.uint8)
    for row in parts.repartition("block").mapInArrow(merge, schema).toLocalIterator():
        out[row["block"]] = np.frombuffer(row["cells"], np.uint8)
    return out.ravel()


def possible_repeat(docs: DataFrame) -> Column:
    """Whether a row's text may occur in another row; never false where it does."""
    bits = sketch_bits(docs.count())
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, bits))

    @F.pandas_udf("boolean")
    def look(hashes: pd.Series) -> pd.Series:
        at = cells(hashes.to_numpy(), bits)
        twice = shared.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series(twice.all(axis=0))

    return look(text_hash())


def text_flags(text: Column) -> dict[str, Column]:
    """The filters that look at one text; true where it fails."""
    words, distinct = F.col("_words"), F.size(F.array_distinct("_list"))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": words < LEAST_WORDS,
        "B": F.lit(100) * distinct < F.lit(LEAST_DISTINCT) * words,
        "C": F.lit(100) * capitals > F.lit(MOST_CAPITALS) * F.length(text),
        "D": text.rlike(MARKS),
    }


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): n rows of that id fail the filters whose bits are in mask (A: 1, B: 2, ...)."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_repeat", F.col("doc_id").isNotNull() & possible_repeat(rows))  # first, so that only texts wait for Python
    sha = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))  # never null, so no join tests it for null on every row
    flagged = rows.withColumn("_list", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("_words", F.size("_list"))
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(text_flags(F.col("text")).values())), F.lit(0))
    flagged = flagged.select("doc_id", "part", mask.alias("mask"), F.when(F.col("_repeat"), sha).alias("_sha"))
    flagged = flagged.groupBy("doc_id", "part", "mask", "_sha").agg(F.count("*").alias("n"))
    first = rows.where("_repeat").groupBy("text").agg(F.min("doc_id").alias("_low"))
    first = first.select("_low", sha.alias("_text"))
    both = flagged.join(first, (F.col("doc_id") == F.col("_low")) & (F.col("_sha") == F.col("_text")), "left")
    again = F.when(F.col("_sha").isNotNull() & F.col("_low").isNull(), 16).otherwise(0)
    return both.select("doc_id", "part", (F.col("mask") + again).alias("mask"), "n")


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail."""
    of = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
    of = of.agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    marked = failures(docs, part).join(of, F.col("doc_id") == F.col("_id"), "left")
    add = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), add("_good").alias("good"), add("_toxic").alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the masks' counts.

    shapley: over all orders, a document is removed by each of its m failed filters equally often, 120 / m times.
    """
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            own = 1 << FILTERS.index(f)
            steps.append({"o": "".join(order), "s": k + 1, "b": before, "f": own})
            before |= own
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<o: string, s: int, b: int, f: int>>")
    # every mask of a part meets the 600 steps, so each part has all of them
    rows = counts.withColumn("_s", F.explode(steps)).select("*", "_s.o", "_s.s", "_s.b", "_s.f")
    mask, before, own = F.col("mask"), F.col("b"), F.col("f")
    clean, fails = mask.bitwiseAND(before) == 0, mask.bitwiseAND(own) != 0
    add = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    rows = rows.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step"))
    return rows.agg(
        add(clean & ~fails).alias("kept"), add(clean & fails).alias("removed"), add(~clean & fails).alias("redundant"), add(mask == own).alias("unique_fails"),
        add(clean & fails, "good").alias("good_lost"), add(clean & fails, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * F.expr("120 div bit_count(mask)")).otherwise(0)).cast("long").alias("shapley"),
    )


_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM d),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN lab USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, i::INT AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) r(i)),
g AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM m, s GROUP BY ALL)
SELECT * EXCLUDE own, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g"""


@query("op12_filter_audit", _SQL)
def _(spark, sf_dir):
    return audit(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
