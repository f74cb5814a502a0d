"""Behaviour features and targets of runs: the table the models train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.functions.scalars import finite, number_prefix, span_minutes
from playtrace.operators import ordered, sequences
from playtrace.operators.sequences import SESSION

# Size of the event mix, groups, targets and the smallest training set.
TOP_TYPES = 12
GROUPS = ("volume", "timing", "structure", "eventmix", "context")
TARGETS = ("score", "stars", "sessionLen", "pass")
MIN_RUNS = 12
DEFAULT_THRESHOLD = 0.6

FEATURES = {
    "volume": ("eventCount", "distinctTypes"),
    "timing": ("durationMin", "eventsPerMin"),
    "structure": ("transitions", "selfLoopRate"),
    "context": ("level", "priorRuns", "priorAvgScore"),
}


def top_types(steps: DataFrame, k: int = TOP_TYPES) -> DataFrame:
    """The event-mix vocabulary: most frequent activities of each game."""
    counts = steps.groupBy("game_id", "type").agg(F.count("*").alias("count"))
    return ordered.top_k(counts, ["game_id"], [F.desc("count"), "type"], k)


def session_features(steps: DataFrame) -> DataFrame:
    """Counts, span, transitions, self-loops and event mix of each session."""
    per_type = (
        sequences.with_next(steps, 1)
        .groupBy(*SESSION, "type")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("next1") == F.col("type")).alias("self"),
            F.min("t_ms").alias("t0"),
            F.max("t_ms").alias("t1"),
        )
    )
    mix = F.when(F.col("rank").isNotNull(), F.struct("type", "n"))
    marked = per_type.join(top_types(steps).select("game_id", "type", "rank"), ["game_id", "type"], "left")
    per = marked.groupBy(*SESSION).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("distinct_types"),
        F.sum("self").alias("self_loops"),
        F.min("t0").alias("t_min"),
        F.max("t1").alias("t_max"),
        F.map_from_entries(F.collect_list(mix)).alias("counts"),
    )
    minutes = F.coalesce(span_minutes("t_min", "t_max"), F.lit(0.0))
    return per.withColumns({"transitions": F.col("n") - 1, "minutes": minutes})


def level_ordinals(runs: DataFrame) -> DataFrame:
    """Levels of each game numbered from 0: by leading number, otherwise by text."""
    levels = runs.select("game_id", F.coalesce("level", F.lit("")).alias("level")).distinct()
    rn = ordered.numbered(levels.withColumn("_num", number_prefix("level")), ["game_id"], [F.asc_nulls_last("_num"), F.col("level")], "_rn")
    return rn.select("game_id", "level", (F.col("_rn") - 1).alias("level_ix"))


def history(runs: DataFrame) -> DataFrame:
    """Each run with the player's earlier runs and their mean score (overall mean if none)."""
    mean = runs.groupBy("game_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"))
    scored = F.col("score").isNotNull()
    before = ordered.running(
        runs,
        ["game_id", "player_id"],
        ["created_at", "id"],
        {"prior_runs": scored.cast("long"), "prior_sum": F.coalesce("score", F.lit(0.0))},
        inclusive=False,
    )
    avg = F.when(F.col("prior_runs") > 0, F.col("prior_sum") / F.col("prior_runs")).otherwise(F.col("mean_score"))
    return before.join(mean, "game_id").withColumn("prior_avg", avg).drop("prior_sum", "mean_score")


def design(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per run with a session and events: all features and raw targets."""
    known = runs.where(F.col("session_id").isNotNull()).select(
        "game_id", "session_id", "player_id", "id", "level", "score", "stars", "created_at"
    )
    levels = level_ordinals(known).withColumnRenamed("level", "_level")
    rows = history(known).withColumn("_level", F.coalesce("level", F.lit(""))).join(levels, ["game_id", "_level"])
    return rows.join(session_features(steps), SESSION).select(
        "game_id",
        "id",
        "session_id",
        "player_id",
        F.col("level").alias("level_name"),
        "score",
        "stars",
        F.col("n").cast("double").alias("eventCount"),
        F.col("distinct_types").cast("double").alias("distinctTypes"),
        F.col("minutes").alias("durationMin"),
        F.when(F.col("minutes") > 0, F.col("n") / F.col("minutes")).otherwise(0.0).alias("eventsPerMin"),
        F.col("transitions").cast("double").alias("transitions"),
        F.when(F.col("transitions") > 0, F.col("self_loops") / F.col("transitions")).otherwise(0.0).alias("selfLoopRate"),
        F.transform_values("counts", lambda _, v: v / F.col("n")).alias("mix"),
        F.col("level_ix").cast("double").alias("level"),
        F.col("prior_runs").cast("double").alias("priorRuns"),
        F.col("prior_avg").alias("priorAvgScore"),
    )


def enabled_groups(target: str, groups=None) -> list[str]:
    """Chosen groups in order; the timing group would give away the session length."""
    chosen = [g for g in (groups or GROUPS) if g in GROUPS] or list(GROUPS)
    return [g for g in chosen if not (g == "timing" and target == "sessionLen")]


def target_column(target: str, threshold: float = DEFAULT_THRESHOLD) -> Column:
    threshold = threshold if 0 < threshold < 1 else DEFAULT_THRESHOLD
    return {
        "stars": F.col("stars").cast("double"),
        "sessionLen": F.col("durationMin"),
        "pass": F.when(F.col("score").isNotNull(), (F.col("score") >= threshold).cast("double")),
    }.get(target, F.col("score"))


def long_features(design_df: DataFrame, steps: DataFrame, target: str = "score", groups=None) -> DataFrame:
    """Features as rows (game, run, group, feature, value); a mix share per game activity."""
    on = enabled_groups(target, groups)
    fixed = [
        F.struct(F.lit(g).alias("grp"), F.lit(f).alias("feature"), F.coalesce(finite(f), F.lit(0.0)).alias("value"))
        for g in on
        if g in FEATURES
        for f in FEATURES[g]
    ]
    wide = design_df
    parts = F.array(*fixed) if fixed else None
    if "eventmix" in on:
        vocabulary = top_types(steps).groupBy("game_id").agg(F.collect_list("type").alias("vocabulary"))  # at most 12
        wide = wide.join(vocabulary, "game_id")
        shares = F.transform(
            "vocabulary",
            lambda ty: F.struct(
                F.lit("eventmix").alias("grp"),
                F.concat(F.lit("share:"), ty).alias("feature"),
                F.coalesce(F.try_element_at("mix", ty), F.lit(0.0)).alias("value"),
            ),
        )
        parts = F.concat(parts, shares) if fixed else shares
    return wide.select("game_id", "id", F.inline(parts))


def target_availability(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Targets that vary and can therefore be trained on."""
    known = runs.where(F.col("session_id").isNotNull())
    varies = known.groupBy("game_id").agg(
        (F.min("score") < F.max("score")).alias("score"), (F.min("stars") < F.max("stars")).alias("stars")
    )
    have = steps.groupBy("game_id").agg((F.count("*") > 0).alias("sessionLen"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return varies.join(have, "game_id", "left").select(
        "game_id", no("score").alias("score"), no("stars").alias("stars"), no("sessionLen").alias("sessionLen"), no("score").alias("pass")
    )


def readiness(design_df: DataFrame, runs: DataFrame, target: str = "score") -> DataFrame:
    """Usable and total runs of each game and whether they are enough to train."""
    usable = design_df.where(target_column(target).isNotNull()).groupBy("game_id").agg(F.count("*").alias("usable"))
    total = runs.where(F.col("session_id").isNotNull()).groupBy("game_id").agg(F.count("*").alias("total"))
    n = F.coalesce("usable", F.lit(0))
    return total.join(usable, "game_id", "left").select("game_id", n.alias("usable"), "total", (n >= MIN_RUNS).alias("enough"))


def min_max(values: DataFrame) -> DataFrame:
    """Feature values scaled to 0..1 within each game and feature; no spread counts as 1."""
    span = values.groupBy("game_id", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return values.join(span, ["game_id", "feature"]).withColumn("scaled", (F.col("value") - F.col("lo")) / width).drop("lo", "hi")


def holdout(rows: DataFrame, seed: int = 42, cap: int | None = None) -> DataFrame:
    """Seeded shuffle: ``place`` per game, and the first four fifths marked for training.

    ``cap`` keeps a seeded sample of that many rows per game first.
    """
    shuffled = rows.withColumn("_h", F.xxhash64("id", F.lit(seed)))
    if cap is not None:
        shuffled = ordered.top_k(shuffled, ["game_id"], ["_h", "id"], cap, "_r").drop("_r")
    placed = ordered.numbered(shuffled, ["game_id"], ["_h", "id"], "place")
    size = placed.groupBy("game_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.8)).alias("_cut"))
    return placed.join(size, "game_id").withColumn("train", F.col("place") <= F.col("_cut")).drop("_h", "_cut")


def sample_sessions(sessions: DataFrame, cap: int, seed: int) -> DataFrame:
    """Seeded sample without replacement of at most ``cap`` sessions per game."""
    key = F.md5(F.concat_ws(":", "session_id", F.lit(str(seed))))
    picked = ordered.top_k(sessions.withColumn("_h", key), ["game_id"], ["_h", "session_id"], cap, "_r")
    return picked.drop("_h", "_r")
