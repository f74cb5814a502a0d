"""Process mining: frequencies, directly-follows graph, chains, loop folding, variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from playtrace.functions.scalars import round_half_up
from playtrace.operators import ordered, sequences
from playtrace.operators.sequences import SEP, SESSION

# Lengths of the reported lists and the longest loop that is folded.
TOP_VARIANTS = 12
TOP_TRANSITIONS = 14
TOP_ENDS = 8
MAX_LOOP = 6


def activity_frequency(steps: DataFrame) -> DataFrame:
    """Count and share of each activity."""
    counts = steps.groupBy("game_id", "type").agg(F.count("*").alias("count"))
    total = counts.groupBy("game_id").agg(F.sum("count").alias("total"))
    return counts.join(total, "game_id").select("game_id", "type", "count", (F.col("count") / F.col("total")).alias("share"))


def directly_follows(steps: DataFrame) -> DataFrame:
    return sequences.transitions(steps).groupBy("game_id", "src", "dst").agg(F.count("*").alias("count"))


def top_transitions(steps: DataFrame, k: int = TOP_TRANSITIONS) -> DataFrame:
    return ordered.top_k(directly_follows(steps), ["game_id"], [F.desc("count"), "src", "dst"], k)


def end_activities(steps: DataFrame, k: int = TOP_ENDS) -> DataFrame:
    """Most frequent first and last activities."""
    ends = sequences.session_ends(steps)
    kinds = F.explode(F.array(F.struct(F.lit("start").alias("end"), F.col("first_type").alias("type")),
                              F.struct(F.lit("end").alias("end"), F.col("last_type").alias("type"))))
    counts = ends.select("game_id", kinds.alias("e")).groupBy("game_id", "e.end", "e.type").agg(F.count("*").alias("count"))
    return ordered.top_k(counts, ["game_id", "end"], [F.desc("count"), "type"], k)


def chains(steps: DataFrame, n: int) -> DataFrame:
    """How often each run of ``n`` consecutive activities occurs."""
    after = [f"next{i}" for i in range(1, n)]
    full = sequences.with_next(steps, n - 1).where(F.col(after[-1]).isNotNull())
    return full.groupBy("game_id", "type", *after).agg(F.count("*").alias("count")).select(
        "game_id", F.lit(n).alias("n"), F.concat_ws(SEP, "type", *after).alias("chain"), "count"
    )


def top_chains(steps: DataFrame, lengths: tuple[int, ...] = (2, 3, 4), k: int = TOP_TRANSITIONS) -> DataFrame:
    """The most frequent chains of every length, from one look-ahead over the sessions."""
    longest = max(lengths)
    nxt = [F.col(f"next{i}") for i in range(1, longest)]
    ahead = sequences.with_next(steps, longest - 1)
    per_n = [
        F.struct(F.lit(n).alias("n"), F.when(nxt[n - 2].isNotNull(), F.concat_ws(SEP, "type", *nxt[: n - 1])).alias("chain"))
        for n in lengths
    ]
    counts = (
        ahead.select("game_id", F.explode(F.array(*per_n)).alias("c"))
        .where(F.col("c.chain").isNotNull())
        .groupBy("game_id", "c.n", "c.chain")
        .agg(F.count("*").alias("count"))
    )
    return ordered.top_k(counts, ["game_id", "n"], [F.desc("count"), "chain"], k)


def _fold_codes(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fold adjacent repeats in many sequences laid end to end.

    Folding the shortest block first leaves no shorter repeat behind, so one pass per
    block length is enough: a stretch that keeps repeating with period L is cut to its
    first period plus the unfinished one.
    """
    for length in range(1, MAX_LOOP + 1):
        n = len(code)
        if n < 2 * length:
            continue
        same = (code[length:] == code[:-length]) & (owner[length:] == owner[:-length])
        edge = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cut = (stop - start) // length * length
        drop = np.zeros(n + 1, dtype=np.int64)
        np.add.at(drop, start + length, (cut > 0).astype(np.int64))
        np.add.at(drop, start + length + cut, -(cut > 0).astype(np.int64))
        keep = np.cumsum(drop)[:n] == 0
        code, owner = code[keep], owner[keep]
    return code, owner


@pandas_udf(T.ArrayType(T.StringType()))
def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Loop-folded path of each activity array; works on a whole Arrow batch at once."""
    for paths in batches:
        sizes = paths.map(len).to_numpy()
        if not sizes.sum():
            yield pd.Series([[] for _ in sizes], index=paths.index)
            continue
        code, names = pd.factorize(np.concatenate([np.asarray(p, dtype=object) for p in paths]))
        code, owner = _fold_codes(code, np.repeat(np.arange(len(sizes)), sizes))
        cuts = np.cumsum(np.bincount(owner, minlength=len(sizes)))[:-1]
        yield pd.Series(np.split(names[code], cuts), index=paths.index)


def fold_steps(steps: DataFrame, segment: int = sequences.SEGMENT) -> DataFrame:
    """Loop folding on rows, for sessions too long to be one array.

    Same passes as ``folded``: rows whose activity recurs ``length`` steps later form
    stretches, and whole periods at the start of a stretch are dropped.
    """
    cur = steps.select(*SESSION, "pos", "type")
    for length in range(1, MAX_LOOP + 1):
        ahead = sequences.with_next(cur, length, segment)
        marked = ahead.withColumn("same", F.coalesce(F.col("type") == F.col(f"next{length}"), F.lit(False)))
        if length == 1:
            kept = marked.where(~F.col("same"))
        else:
            runs = ordered.running(marked.drop(*[f"next{i}" for i in range(1, length + 1)]), SESSION, ["pos"],
                                   {"seen": F.col("same").cast("long")}, hot_rows=segment)
            runs = runs.withColumn("stretch", F.when(F.col("same"), F.col("pos") - F.col("seen")))
            sizes = runs.where("same").groupBy(*SESSION, "stretch").agg(F.count("*").alias("m"), F.min("pos").alias("p0"))
            sizes = sizes.where(F.col("m") >= length)
            kept = runs.join(sizes, [*SESSION, "stretch"], "left").where(
                F.col("m").isNull() | (F.col("pos") - F.col("p0") >= F.floor(F.col("m") / length) * length)
            )
        again = ordered.numbered(kept.select(*SESSION, "pos", "type"), SESSION, ["pos"], "_rn", hot_rows=segment)
        cur = ordered.durable(again.select(*SESSION, (F.col("_rn") - 1).alias("pos"), "type"))
    return cur


def folded_paths(steps: DataFrame, segment: int = sequences.SEGMENT) -> DataFrame:
    """The loop-folded path of every session and its raw length."""
    lengths = steps.groupBy(*SESSION).agg(F.count("*").alias("length"))
    arrays = sequences.paths(steps, segment)
    last = steps.where(F.col("pos") == segment).select(*SESSION)  # one row per longer session
    if last.isEmpty():
        whole = arrays.select(*SESSION, F.size("path").cast("long").alias("length"), folded("path").alias("path"))
        return whole
    short = arrays.join(last, SESSION, "left_anti").select(*SESSION, folded("path").alias("path"))
    long = fold_steps(steps.join(last, SESSION, "left_semi"), segment)
    long = (
        long.groupBy(*SESSION)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("_s"))
        .select(*SESSION, F.transform("_s", lambda s: s["type"]).alias("path"))
    )
    return short.unionByName(long).join(lengths, SESSION).select(*SESSION, "length", "path")


def variants(folded_df: DataFrame, k: int | None = TOP_VARIANTS) -> DataFrame:
    """Distinct folded paths with count and share of sessions; all of them if ``k`` is None."""
    counts = folded_df.groupBy("game_id", F.array_join("path", SEP).alias("path")).agg(F.count("*").alias("count"))
    total = counts.groupBy("game_id").agg(F.sum("count").alias("total"))
    shares = counts.join(total, "game_id").select("game_id", "path", "count", (F.col("count") / F.col("total")).alias("coverage"))
    return shares if k is None else ordered.top_k(shares, ["game_id"], [F.desc("count"), "path"], k)


def raw_variants(steps: DataFrame, k: int | None = TOP_VARIANTS) -> DataFrame:
    """Variants of the paths as they are, without folding."""
    whole = (
        sequences.paths(steps)
        .groupBy(*SESSION)
        .agg(F.array_sort(F.collect_list(F.struct("segment", "path"))).alias("_s"))
        .select(*SESSION, F.flatten(F.transform("_s", lambda s: s["path"])).alias("path"))
    )
    return variants(whole, k)


def stats(steps: DataFrame, folded_df: DataFrame) -> DataFrame:
    """Sessions, events, variants, mean lengths, self-loop rate."""
    loops = directly_follows(steps).groupBy("game_id").agg(
        F.sum("count").alias("transitions"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("count")).otherwise(0)).alias("loops")
    )
    acts = steps.groupBy("game_id").agg(F.count("*").alias("events"), F.count_distinct("type").alias("distinct_activities"))
    per_path = folded_df.groupBy("game_id", F.array_join("path", SEP).alias("p")).agg(
        F.count("*").alias("n"), F.sum(F.size("path")).alias("folded"), F.sum("length").alias("raw")
    )
    per_game = per_path.groupBy("game_id").agg(
        F.sum("n").alias("sessions"), F.count("*").alias("variants"), F.sum("folded").alias("folded"), F.sum("raw").alias("raw")
    )
    return per_game.join(acts, "game_id").join(loops, "game_id", "left").select(
        "game_id",
        "sessions",
        "events",
        "variants",
        round_half_up(F.col("folded") / F.col("sessions"), 1).alias("avg_steps"),
        round_half_up(F.col("raw") / F.col("sessions"), 1).alias("avg_events"),
        round_half_up(F.try_divide(F.col("loops").cast("double"), F.col("transitions").cast("double")), 3).alias("self_loop_rate"),
        "distinct_activities",
    )


def self_loop_rate(steps: DataFrame) -> DataFrame:
    tr = sequences.transitions(steps)
    return tr.groupBy("game_id").agg(
        F.count_if(F.col("src") == F.col("dst")).alias("self_loops"),
        F.count("*").alias("transitions"),
        round_half_up(F.count_if(F.col("src") == F.col("dst")) / F.count("*"), 3).alias("rate"),
    )
