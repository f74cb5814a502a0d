"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

Every source is one long stream: its documents in a seeded random order, cut into blocks of ``block_words`` words.
Targets share the total by weight, stop at ``most`` times a source's size, and pass the excess on. The blocks of
the mix are seats, given one after the other to the source with the highest quotient target / (2 * seats + 1);
consecutive runs of seats are the shards of the mix, so each shard gets whole quotas. A source takes its whole
stream as often as its seats allow, and the rest as neighbouring blocks from a seeded first block on, in a circle. As the stream
is in random order, those are random documents, and at most two of them are cut.

Nulls: a null text has no words; null sources are one source, which comes last; a null id is an id like any other.
Repeated rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.common import WORD, packed, query, table
from playtrace.session import durable

WEIGHTS, MOST, BLOCK_WORDS, SEED, SHARDS = (5, 2, 1), 3, 32, 17, 40


@dataclass
class Source:
    name: str | None
    size: int
    votes: Fraction  # its target
    seats: list[int]  # the blocks it has in each shard of the mix
    taken: int
    first: int  # word of the stream at which the partial pass begins


def targets(sizes: list[int], weights: list[int], most: int) -> list[Fraction]:
    """Shares of sum(sizes) by weight, none above most * size; the excess goes to the others by weight."""
    rest, open_ = sum(sizes), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: Fraction(rest * weights[i], total) for i in open_}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = Fraction(most * sizes[i]) if over else share[i]
        if not over:
            break
        rest -= sum(most * sizes[i] for i in over)
        open_ -= set(over)
    return out


def apportion(votes: list[Fraction], seats: int) -> list[int]:
    """Sainte-Laguë: each seat goes to the highest votes / (2 * own seats + 1), ties to the first.

    Rounding votes / divisor gives all but a few seats; those follow by their quotients.
    """
    total = sum(votes)
    if not total:
        return [0] * len(votes)
    got = [int(v * seats / total + Fraction(1, 2)) for v in votes]
    short = seats - sum(got)
    if short > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got))]
        heapq.heapify(heap)
        for _ in range(short):
            i = heap[0][1]
            got[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif short < 0:
        heap = [(v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got)) if g]
        heapq.heapify(heap)
        for _ in range(-short):
            i = -heapq.heappop(heap)[1]
            got[i] -= 1
            if got[i]:
                heapq.heappush(heap, (votes[i] / (2 * got[i] - 1), -i))
    return got


def _seeded(seed: int, text: str) -> int:
    return int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:8], 16)


def plan(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED, shards: int = SHARDS) -> list[Source]:
    """The quotas of all sources; one small record for each source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    amount = [sizes[n] for n in names]
    votes = targets(amount, [weights[i % len(weights)] for i in range(len(names))], most)
    seats = (2 * sum(amount) + block_words) // (2 * block_words)
    upto = [apportion(votes, seats * (s + 1) // shards) for s in range(shards)]
    out = []
    for i, name in enumerate(names):
        quotas = [b[i] - (a[i] if a else 0) for a, b in zip([None, *upto], upto)]
        blocks = -(-amount[i] // block_words)
        first = _seeded(seed, "" if name is None else name) % blocks * block_words if blocks else 0
        out.append(Source(name, amount[i], votes[i], quotas, min(sum(quotas) * block_words, most * amount[i]), first))
    return out


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.withColumn("_size", _size(F.col("text"))).withColumn("_order", order).withColumn("_part", F.substring("_order", 1, 3))


def mix(docs: DataFrame, columns: list[str], weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``columns`` of docs, and for every row _size, _source_size, _target, _taken, _full (whole passes), and the
    words of a further, partial pass: those numbered from _a to _b - 1 and from _c to _d - 1.

    Places in the streams are prefix sums: over the words of 4096 parts of each source, then within a part, so no
    source is ever in one task. Everything about a source comes from one row for each source.
    """
    spark, by = docs.sparkSession, ["source", "_part"]
    rows = durable(_keyed(docs, seed).select(*dict.fromkeys([*columns, "source"]), "_size", "_order", "_part"))
    parts = durable(rows.groupBy(*by).agg(F.sum("_size").alias("_words")))
    totals = {r[0]: r[1] for r in parts.groupBy("source").agg(F.sum("_words")).collect()}  # a row for each source
    facts = [(s.name, s.size, float(s.votes), s.taken // s.size if s.size else 0, s.taken % s.size if s.size else 0, s.first) for s in plan(totals, weights, most, block_words, seed)]
    facts = spark.createDataFrame(facts, "_s string, _source_size long, _target double, _full long, _rest long, _first long")
    upto = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("source").alias("_ps"), F.col("_part").alias("_pp"), F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_before"))
    starts = starts.join(facts, F.col("_ps").eqNullSafe(F.col("_s"))).drop("_s")
    within = Window.partitionBy(*by).orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_part") == F.col("_pp"))).withColumn("_at", F.col("_before") + F.col("_in"))

    def clip(x: Column) -> Column:  # a place of the stream, as a word of this document
        return F.greatest(F.lit(0), F.least(x - F.col("_at"), F.col("_size")))

    end = F.col("_first") + F.col("_rest")
    spans = {"_a": clip(F.col("_first")), "_b": clip(F.least(end, F.col("_source_size"))), "_c": F.lit(0).cast("long"), "_d": clip(end - F.col("_source_size"))}
    placed = placed.withColumns(spans).withColumn("_taken", F.col("_full") * F.col("_size") + F.col("_b") - F.col("_a") + F.col("_d"))
    return placed.select(*columns, "_size", "_source_size", "_target", "_taken", "_full", "_a", "_b", "_c", "_d")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass over a document. A cut document keeps its taken words, joined by blanks; n_chars, if there, is made anew."""
    rows, back = packed(docs, ["doc_id", "text", "source"])
    m = mix(rows, rows.columns, **options)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    partial = F.when(F.col("_b") - F.col("_a") + F.col("_d") == F.col("_size"), F.col("text")).otherwise(
        F.array_join(F.concat(F.slice(words, (F.col("_c") + 1).cast("int"), (F.col("_d") - F.col("_c")).cast("int")), F.slice(words, (F.col("_a") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int"))), " ")
    )
    pieces = F.concat(F.array_repeat(F.col("text"), F.col("_full").cast("int")), F.when(F.col("_b") - F.col("_a") + F.col("_d") > 0, F.array(partial)).otherwise(F.array().cast("array<string>")))
    rows = m.withColumn("_piece", F.explode(pieces))
    fresh = {"text": F.col("_piece"), "n_chars": F.length("_piece").cast("long")}
    return rows.select(*[fresh[c].alias(c) if c in fresh else column for c, column in back.items()])


_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM docs GROUP BY source),
w AS (SELECT *, CAST(CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w, 3 * source_size AS cap, (SELECT sum(source_size) FROM src) AS total FROM src),
lowest AS (  -- sources by cap / weight: those before the first that can take its share are full
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM w),
level AS (SELECT rest AS open_rest, weight AS open_weight, cap / w AS at_ FROM lowest WHERE cap * weight >= rest * w ORDER BY cap / w, pos LIMIT 1),
tgt AS (SELECT w.*, CASE WHEN cap / w < at_ THEN CAST(cap AS DOUBLE) ELSE CAST(open_rest * w AS DOUBLE) / CAST(open_weight AS DOUBLE) END AS target FROM w, level),
seats AS (SELECT CAST((2 * total + {BLOCK_WORDS}) // {2 * BLOCK_WORDS} AS BIGINT) AS n FROM w LIMIT 1),
won AS (SELECT pos, count(*) AS got FROM (
  SELECT pos, target / (2 * s.i + 1) AS quotient FROM tgt, (SELECT unnest(generate_series(0, (SELECT n FROM seats))) AS i) s
  WHERE target > 0 ORDER BY quotient DESC, pos LIMIT (SELECT n FROM seats)) GROUP BY pos),
quota AS (SELECT tgt.*, least(coalesce(got, 0) * {BLOCK_WORDS}, cap) AS taken_all,
         CASE WHEN source_size = 0 THEN 0 ELSE ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8))::BIGINT % ((source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS}) * {BLOCK_WORDS} END AS first_
         FROM tgt LEFT JOIN won USING (pos)),
placed AS (SELECT docs.*, q.source_size, q.target, q.first_, q.taken_all, CAST(sum(size) OVER (PARTITION BY docs.source ORDER BY ord, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS at_
         FROM docs JOIN quota q ON docs.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE taken_all // source_size * size
  + greatest(0, least(least(first_ + taken_all % source_size, source_size) - at_, size)) - greatest(0, least(first_ - at_, size))
  + greatest(0, least(first_ + taken_all % source_size - source_size - at_, size)) END AS BIGINT) AS taken
FROM placed"""


@query("op10_sainte_lague_mix", _SQL)
def _(spark, sf_dir):
    m = mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))
