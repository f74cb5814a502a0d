"""Bootstrap validation of network edges: are their weights stable, or owed to a few sessions?

Every replicate draws as many sessions as there are, with replacement. Sessions with the
same transitions are interchangeable, so they are grouped into profiles first and a
replicate draws counts of profiles. All chance comes from a counter: a number mixed from
(seed, profile, replicate) is turned into a Poisson count through the inverse of its
distribution. The means sum to a little less than the number of sessions, and the draws
still missing are thrown one by one at the profiles laid end to end in the order of their
keys. Poisson counts given their total are multinomial, so the whole is an exact resample;
only the thrown draws, some eight times the root of the number of sessions, move as rows.
Nothing depends on partitioning, and SQL can repeat it.

A replicate whose Poisson counts already exceed the number of sessions, eight standard
deviations off, keeps them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.functions.scalars import round_half_up
from playtrace.operators import network
from playtrace.operators.sequences import SESSION
from playtrace.session import durable

BUCKET_PROFILES = 4_000
MAX_BUCKETS = 1 << 14
BLOCK = 100  # replicates drawn at once
THROWN = 20  # replicates whose missing draws are thrown by one task
MIN_SESSIONS = 3
KEY_BITS = 60
SPARE = 8  # standard deviations by which the Poisson counts fall short of the sessions
# Increment and multipliers of the 64-bit mixing function splitmix64.
STEP, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def settings(iterations: int | None = None, level: float | None = None) -> tuple[int, float]:
    """Replicates (default 300, 50..2000) and level (default .05, inside 0..1)."""
    iterations = min(2000, max(50, iterations or 300))
    return iterations, level if level and 0 < level < 1 else 0.05


def mixed(z: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    z = np.asarray(z, dtype=np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
    return z ^ (z >> np.uint64(31))


def seed_offset(seed: int) -> int:
    return int(mixed(np.array([seed & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


def _counted(start: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """The number at a place of the sequence that begins at ``start``."""
    return mixed(start + (counter.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP))


def _chance(start: np.ndarray, counter: np.ndarray) -> np.ndarray:
    return (_counted(start, counter) >> np.uint64(11)) * 2.0**-53


def _poisson(mean: float) -> tuple[int, np.ndarray]:
    """The first count worth telling apart and the distribution function from there on."""
    spread = 9 * math.sqrt(mean) + 20
    low, high = max(0, math.floor(mean - spread)), math.ceil(mean + spread)
    if mean == 0:
        return 0, np.ones(1)
    k = np.arange(low, high + 1)
    log_factorial = math.lgamma(low + 1) + np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))
    return low, np.cumsum(np.exp(k * math.log(mean) - mean - log_factorial))


def _poisson_counts(key: np.ndarray, weight: np.ndarray, sessions: int, offset: int, replicates: np.ndarray) -> np.ndarray:
    """Poisson counts, replicate x profile."""
    share = max(0.0, sessions - SPARE * math.sqrt(sessions)) / sessions
    chance = _chance(key.astype(np.uint64) + np.uint64(offset), replicates[:, None])
    out = np.empty(chance.shape, dtype=np.int64)
    for w in np.unique(weight):
        low, below = _poisson(w * share)
        same = weight == w
        out[:, same] = low + np.searchsorted(below, chance[:, same], side="right")
    return out


def _key(text) -> F.Column:
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _profiles(transitions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct transition counts, the number of sessions that have them, and a key made of their text."""
    per = transitions.groupBy(*SESSION, "src", "dst").agg(F.count("*").alias("n"))
    sets = per.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "n"))).alias("edges"))
    all_sessions = sessions.select(*SESSION).join(sets, SESSION, "left")  # single steps count as draws too
    profiles = all_sessions.groupBy("game_id", F.coalesce("edges", F.expr("array()")).alias("edges")).agg(F.count("*").alias("weight"))
    text = F.array_join(F.transform("edges", lambda e: F.concat_ws("\x1f", e["src"], e["dst"], e["n"])), "\x1e")
    return profiles.withColumn("key", _key(F.concat("game_id", F.lit("\x1e"), text)))


def replicate_counts(transitions: DataFrame, sessions: DataFrame, iterations: int, seed: int = 42) -> DataFrame:
    """Edge counts of every replicate: ``game_id, replicate, src, dst, count`` (non-zero only)."""
    profiles = durable(_profiles(transitions, sessions))
    wanted = min(MAX_BUCKETS, max(1, math.ceil(profiles.count() / BUCKET_PROFILES)))
    bits = math.ceil(math.log2(wanted))  # a bucket is a range of keys, so buckets and their profiles have one order
    placed = profiles.withColumn("bucket", F.shiftright("key", KEY_BITS - bits).cast("int"))
    sizes = placed.groupBy("game_id", "bucket").agg(F.sum("weight").alias("weight"))  # at most 2^bits rows a game
    games = sizes.groupBy("game_id").agg(
        F.sum("weight").alias("sessions"), F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("layout")
    )
    games = games.withColumn("game_key", _key(F.col("game_id")))
    offset = seed_offset(seed)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of the Poisson counts of a batch of profiles."""
        for pdf in batches:
            for (game, n), g in pdf.groupby(["game_id", "sessions"]):
                for first in range(0, iterations, BLOCK):
                    replicates = np.arange(first, min(first + BLOCK, iterations))
                    counts = _poisson_counts(g["key"].to_numpy(), g["weight"].to_numpy(), n, offset, replicates)
                    yield pd.DataFrame({"game_id": game, "replicate": replicates, "drawn": counts.sum(axis=1)})

    def throw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The missing draws of some replicates as places in each bucket."""
        layout = pdf["layout"].iloc[0]
        buckets = np.array([b["bucket"] for b in layout])
        ends = np.cumsum([b["weight"] for b in layout])
        starts = np.concatenate(([0], ends))
        parts = [pd.DataFrame({"game_id": [], "bucket": [], "replicate": [], "places": []})]
        for replicate, missing, sessions, game_key in zip(pdf["replicate"], pdf["missing"], pdf["sessions"], pdf["game_key"]):
            start = _counted(np.array([game_key], dtype=np.uint64) + np.uint64(offset), np.array([replicate]))
            place = np.sort((_chance(start, np.arange(missing)) * sessions).astype(np.int64))
            at = np.searchsorted(ends, place, side="right")
            hit, cuts = np.unique(at, return_index=True)
            if len(hit):
                places = np.split(place - starts[at], cuts[1:])
                parts.append(pd.DataFrame({"game_id": key[0], "bucket": buckets[hit], "replicate": replicate, "places": places}))
        return pd.concat(parts).astype({"game_id": object})

    def draw(key: tuple, pdf: pd.DataFrame, thrown: pd.DataFrame) -> pd.DataFrame:
        """Counts of the profiles of one bucket, summed to edge counts."""
        pdf = pdf.sort_values("key", kind="stable")
        weight = pdf["weight"].to_numpy()
        ends = np.cumsum(weight)
        flat = [(i, e["src"], e["dst"], e["n"]) for i, edges in enumerate(pdf["edges"]) for e in edges]
        rows = pd.DataFrame(flat, columns=["profile", "src", "dst", "n"])
        by_edge = [(*e, g["profile"].to_numpy(), g["n"].to_numpy()) for e, g in rows.groupby(["src", "dst"], sort=True)]
        places = dict(zip(thrown["replicate"], thrown["places"]))
        parts = [pd.DataFrame({"game_id": [], "replicate": [], "src": [], "dst": [], "count": []})]
        for first in range(0, iterations, BLOCK):
            replicates = np.arange(first, min(first + BLOCK, iterations))
            times = _poisson_counts(pdf["key"].to_numpy(), weight, int(pdf["sessions"].iloc[0]), offset, replicates)
            for r in replicates:
                if r in places:
                    np.add.at(times[r - first], np.searchsorted(ends, places[r], side="right"), 1)
            for src, dst, which, each in by_edge:
                total = times[:, which] @ each
                hit = np.flatnonzero(total)
                parts.append(pd.DataFrame({"game_id": key[0], "replicate": hit + first, "src": src, "dst": dst, "count": total[hit]}))
        return pd.concat(parts).astype({"game_id": object, "src": object, "dst": object})

    sized = placed.join(games.select("game_id", "sessions"), "game_id")
    drawn = sized.select("game_id", "sessions", "key", "weight").mapInPandas(totals, "game_id string, replicate int, drawn long")
    drawn = drawn.groupBy("game_id", "replicate").agg(F.sum("drawn").alias("drawn")).join(games, "game_id")
    missing = drawn.withColumn("missing", F.greatest(F.col("sessions") - F.col("drawn"), F.lit(0)))
    thrown = missing.groupBy("game_id", F.expr(f"replicate div {THROWN}").alias("turn")).applyInPandas(throw, "game_id string, bucket int, replicate int, places array<long>")
    counted = (
        sized.groupBy("game_id", "bucket")
        .cogroup(thrown.groupBy("game_id", "bucket"))
        .applyInPandas(draw, "game_id string, replicate int, src string, dst string, count long")
    )
    return counted.groupBy("game_id", "replicate", "src", "dst").agg(F.sum("count").alias("count"))


def validate(
    transitions: DataFrame,
    sessions: DataFrame,
    weight: str = "probability",
    iterations: int | None = None,
    level: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Mean, percentile interval and p (share of replicates without the edge) of every edge."""
    iterations, level = settings(iterations, level)
    lo = math.floor(level / 2 * iterations)
    hi = min(iterations - 1, math.ceil((1 - level / 2) * iterations) - 1)
    enough = sessions.groupBy("game_id").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SESSIONS).select("game_id")
    observed = network.edges(transitions.join(enough, "game_id", "left_semi"), weight)
    counts = replicate_counts(transitions, sessions, iterations, seed)
    resampled = network.weigh(counts, weight, ("game_id", "replicate"))
    # At most 2000 weights per edge; replicates without the edge weigh 0 and sort first.
    per_edge = resampled.groupBy("game_id", "src", "dst").agg(
        F.array_sort(F.collect_list("weight")).alias("w"), F.sum("weight").alias("total"), F.count("*").alias("present")
    )
    joined = observed.select("game_id", "src", "dst", "weight").join(per_edge, ["game_id", "src", "dst"], "left")
    missing = F.lit(iterations) - F.coalesce("present", F.lit(0))
    at = lambda i: F.when(F.lit(i) < missing, 0.0).otherwise(F.element_at("w", (F.lit(i) - missing + 1).cast("int")))
    p = missing / F.lit(iterations)
    return joined.select(
        "game_id",
        "src",
        "dst",
        round_half_up("weight").alias("weight"),
        round_half_up(F.coalesce("total", F.lit(0.0)) / iterations).alias("bootstrap_mean"),
        round_half_up(at(lo)).alias("ci_lower"),
        round_half_up(at(hi)).alias("ci_upper"),
        round_half_up(p).alias("p_value"),
        ((p <= level) & (at(lo) > 0)).alias("significant"),
    )


def summary(validated: DataFrame) -> DataFrame:
    return validated.groupBy("game_id").agg(F.count_if("significant").alias("significant"), F.count("*").alias("total"))


def table_order(validated: DataFrame) -> DataFrame:
    """Most certain and heaviest edges first within each game."""
    return validated.orderBy("game_id", F.asc("p_value"), F.desc("weight"), "src", "dst")
