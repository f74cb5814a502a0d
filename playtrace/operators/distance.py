"""Behaviour vectors of sessions, and dissimilarities of every session to a few centres.

Pairs of all sessions are never made: each row is compared with the centres of its game, whose number is bounded by
``clustering.clamp_k``. Vectors stay long (one row per feature that is there), so they are as large as the log,
however many activities it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.operators import medoids, ordered, sequences
from playtrace.operators.sequences import SEP, SESSION
from playtrace.session import durable

DISSIMILARITIES = ("euclidean", "manhattan", "cosine", "jensenshannon", "sequence")
STEPS = 1 << 20  # steps of sessions that are looked at together


def usable(steps: DataFrame) -> DataFrame:
    """Sessions with at least one transition."""
    return steps.groupBy(*SESSION).agg(F.count("*").alias("length")).where(F.col("length") >= 2)


def vectors(steps: DataFrame) -> DataFrame:
    """Shares of the session's states and of its transitions, as rows."""
    ahead = sequences.with_next(steps, 1)
    state = F.struct(F.concat(F.lit("s:"), "type").alias("feature"), F.lit(0).alias("kind"))
    move = F.struct(F.concat(F.lit("t:"), "type", F.lit(SEP), "next1").alias("feature"), F.lit(1).alias("kind"))
    counts = (
        ahead.select(*SESSION, F.explode(F.when(F.col("next1").isNull(), F.array(state)).otherwise(F.array(state, move))).alias("f"))
        .groupBy(*SESSION, "f.kind", "f.feature")
        .agg(F.count("*").alias("n"))
    )
    total = counts.groupBy(*SESSION, "kind").agg(F.sum("n").alias("total"))
    return counts.join(total, [*SESSION, "kind"]).select(*SESSION, "feature", (F.col("n") / F.col("total")).alias("value"))


def _entropy(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    return 0.5 * p * F.log(p / m) + 0.5 * q * F.log(q / m)


def to_centres(points: DataFrame, centres: DataFrame, point: list[str], centre: list[str]) -> DataFrame:
    """The four vector dissimilarities of every point to every centre of its game.

    points: game_id, the columns ``point``, feature, value; centres: game_id, the columns ``centre``, feature, value.
    All four follow from sums over the features both have and from the totals of each.
    """
    totals = [F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("n2")]
    x, c = points.groupBy("game_id", *point).agg(*totals), centres.groupBy("game_id", *centre).agg(*totals)
    every = x.withColumnsRenamed({"s": "sx", "n2": "nx"}).join(c.withColumnsRenamed({"s": "sc", "n2": "nc"}), "game_id")
    both = points.join(centres.withColumnRenamed("value", "cv"), ["game_id", "feature"])
    both = both.join(every.select("game_id", *point, *centre, "sx", "sc"), ["game_id", *point, *centre])
    p, q = F.col("value") / F.col("sx"), F.col("cv") / F.col("sc")
    both = both.groupBy("game_id", *point, *centre).agg(
        F.sum(F.col("value") * F.col("cv")).alias("dot"), F.sum(F.least("value", "cv")).alias("low"),
        F.sum(_entropy(p, q)).alias("js"), F.sum(p).alias("ps"), F.sum(q).alias("qs"),
    )
    d = every.join(both, ["game_id", *point, *centre], "left").fillna(0.0, ["dot", "low", "js", "ps", "qs"])
    spread = F.greatest(F.lit(0.0), F.col("js") + 0.5 * F.log(F.lit(2.0)) * (2 - F.col("ps") - F.col("qs")))
    return d.select(
        "game_id", *point, *centre,
        F.sqrt(F.greatest(F.lit(0.0), F.col("nx") + F.col("nc") - 2 * F.col("dot"))).alias("euclidean"),
        (F.col("sx") + F.col("sc") - 2 * F.col("low")).alias("manhattan"),
        F.coalesce(1 - F.try_divide(F.col("dot"), F.sqrt("nx") * F.sqrt("nc")), F.lit(1.0)).alias("cosine"),
        F.sqrt(spread / F.log(F.lit(2.0))).alias("jensenshannon"),
    )


def sequence(a: Column, b: Column) -> Column:
    """Edit distance of two step strings over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def signs(steps: DataFrame) -> DataFrame:
    """(game_id, type, sign): one character for each activity of a game."""
    names = ordered.numbered(steps.select("game_id", "type").distinct(), ["game_id"], ["type"], "ix")
    return names.select("game_id", "type", F.decode(F.unhex(F.lpad(F.hex(F.col("ix") + 0x10000), 8, "0")), "UTF-32").alias("sign"))


def step_strings(steps: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Each session as text with one character per step; equal activities share a character. names: the signs, if not those of steps."""
    rows = steps.join(signs(steps) if names is None else names, ["game_id", "type"])
    return (
        rows.groupBy(*SESSION)
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.col("sign").alias("c")))).alias("s"))
        .select(*SESSION, F.array_join(F.transform("s", lambda x: x["c"]), "").alias("text"))
    )


def _shares(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of texts as three flat arrays: row, feature, value. A feature is a sign, or a sign and the one before it."""
    size = np.array([len(x) for x in texts], np.int64)
    flat, row = np.concatenate([*texts, np.zeros(0, np.uint32)]).astype(np.int64), np.repeat(np.arange(len(texts)), size)
    inside = np.flatnonzero(row[1:] == row[:-1])
    feature = np.concatenate([flat, ((flat[inside] + 1) << 21) + flat[inside + 1]])
    names, code = np.unique(feature, return_inverse=True)
    cell, n = np.unique(np.concatenate([row, row[inside]]) * max(1, len(names)) + code, return_counts=True)
    at, code = np.divmod(cell, max(1, len(names)))
    return at, names[code], n / (size[at] - (names[code] >= 1 << 21))


def dissimilarities(texts: list[np.ndarray], centres: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """For each centre the five dissimilarities of all texts to it; all are given by the numbers of their signs.

    Those of vectors follow from sums over the features both have and from the totals of each.
    """
    row, feature, value = _shares(texts)
    size, n = np.array([len(x) for x in texts], np.int64), len(texts)
    add = lambda at, x: np.bincount(at, x, n)
    s, n2 = add(row, value), add(row, value * value)
    for centre, edits in zip(centres, medoids.edit_distances(texts, centres)):
        _, own, have = _shares([centre])  # in order of the feature
        place = np.minimum(np.searchsorted(own, feature), max(0, len(own) - 1))
        both = np.flatnonzero(own[place] == feature) if len(own) else np.zeros(0, np.int64)
        at, v, c = row[both], value[both], have[place[both]] if len(own) else np.zeros(0)
        sc, c2 = have.sum(), (have * have).sum()
        dot, p, q = add(at, v * c), v / s[at], c / max(sc, 1e-300)
        m = (p + q) / 2
        js = add(at, 0.5 * p * np.log(p / m) + 0.5 * q * np.log(q / m)) + 0.5 * np.log(2.0) * (2 - add(at, p) - add(at, q))
        length = np.sqrt(n2) * np.sqrt(c2)
        yield [
            np.sqrt(np.maximum(0.0, n2 + c2 - 2 * dot)),
            s + sc - 2 * add(at, np.minimum(v, c)),
            1 - np.divide(dot, length, out=np.zeros(n), where=length > 0),
            np.sqrt(np.maximum(0.0, js) / np.log(2.0)),
            edits / np.maximum(1, np.maximum(size, len(centre))),
        ]


def _to_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["game_id", "medoid", "session_id", *DISSIMILARITIES]
    numbers = lambda texts: [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in texts]
    for batch in batches:
        games = np.array(batch.column("game_id").to_pylist(), object)
        for game in dict.fromkeys(games.tolist()):
            own = np.flatnonzero(games == game)
            few = batch.column("few")[int(own[0])].as_py()
            centres, part = numbers(x["text"] for x in few), batch.take(pa.array(own))
            sizes = np.cumsum(pc.utf8_length(part.column("text")).to_numpy(zero_copy_only=False))
            for first in np.unique(sizes // STEPS, return_index=True)[1].tolist():
                last = int(np.searchsorted(sizes // STEPS, sizes[first] // STEPS, "right"))
                texts, ids = numbers(part.column("text").slice(first, last - first).to_pylist()), part.column("session_id").slice(first, last - first)
                for x, d in zip(few, dissimilarities(texts, centres)):
                    yield pa.RecordBatch.from_arrays([pa.array([game] * len(ids), pa.string()), pa.array([x["medoid"]] * len(ids), pa.string()), ids, *map(pa.array, d)], names)


def to_medoids(steps: DataFrame, medoids: DataFrame) -> DataFrame:
    """All five dissimilarities of every session to its game's medoids (game_id, medoid: a session).

    A session is one row, its text, from which all five follow. Games are cut by a hash of the session, so that a game is more than one task's work.
    """
    names = durable(signs(steps))
    chosen = medoids.select("game_id", F.col("medoid").alias("session_id"))
    few = step_strings(steps.join(chosen, SESSION, "left_semi"), names).groupBy("game_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("session_id").alias("medoid"), "text"))).alias("few")
    )
    salts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = durable(few).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = step_strings(steps, names).withColumn("_salt", F.pmod(F.xxhash64("session_id"), F.lit(salts)).cast("int"))
    kind = "game_id string, medoid string, session_id string, " + ", ".join(f"{m} double" for m in DISSIMILARITIES)
    return rows.join(few, ["game_id", "_salt"]).select(*SESSION, "text", "few").mapInArrow(_to_few, kind)
