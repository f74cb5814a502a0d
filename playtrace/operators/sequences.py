"""Session sequences: ordered steps, look-ahead, ends, arrays, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.functions.scalars import activity
from playtrace.operators import ordered

SESSION = ["game_id", "session_id"]
SEGMENT = 100_000  # steps of one session handled together
SEP = " > "


def steps(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per event with its 0-based position, ordered by (seq, id).

    Events without a session belong to no sequence; a missing type reads "?".
    """
    known = events.where(F.col("session_id").isNotNull()).select(
        *SESSION, "seq", "id", activity().alias("type"), "t_ms", *keep
    )
    rn = ordered.numbered(known, SESSION, ["seq", "id"], "_rn")
    return rn.withColumn("pos", F.col("_rn") - 1).drop("_rn", "seq")


def with_next(steps_df: DataFrame, n: int, segment: int = SEGMENT) -> DataFrame:
    """Add ``next1..nextN``: the activities that follow in the session.

    Windows run per segment of a session, so a very long session spreads over many
    tasks. The first ``n`` steps of a segment are repeated at the end of the one
    before, which makes look-ahead across the cut exact.
    """
    seg = F.floor(F.col("pos") / segment)
    ahead = (F.col("pos") % segment < n) & (F.col("pos") >= segment)
    spread = steps_df.withColumn("_seg", F.explode(F.when(ahead, F.array(seg, seg - 1)).otherwise(F.array(seg))))
    w = Window.partitionBy(*SESSION, "_seg").orderBy("pos")
    return (
        spread.withColumns({f"next{i}": F.lead("type", i).over(w) for i in range(1, n + 1)})
        .where(F.col("_seg") == seg)
        .drop("_seg")
    )


def transitions(steps_df: DataFrame) -> DataFrame:
    """Consecutive activity pairs, self-loops included."""
    return (
        with_next(steps_df, 1)
        .where(F.col("next1").isNotNull())
        .select(*SESSION, "pos", F.col("type").alias("src"), F.col("next1").alias("dst"))
    )


def session_ends(steps_df: DataFrame) -> DataFrame:
    """First and last activity and the length of each session."""
    return steps_df.groupBy(*SESSION).agg(
        F.min_by("type", "pos").alias("first_type"),
        F.max_by("type", "pos").alias("last_type"),
        F.count("*").alias("length"),
    )


def paths(steps_df: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Ordered activity arrays, one row per session and run of ``segment`` steps: a longer session goes on in the rows segment 1, 2, ..."""
    return (
        steps_df.groupBy(*SESSION, F.floor(F.col("pos") / segment).alias("segment"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("_s"))
        .select(*SESSION, "segment", F.transform("_s", lambda s: s["type"]).alias("path"))
    )


def clipped(steps_df: DataFrame, clip: int = 60) -> DataFrame:
    """The first ``clip`` activities of each session, the very first one, and the session's full length."""
    shown = F.array_sort(F.collect_list(F.when(F.col("pos") < clip, F.struct("pos", "type"))))  # nulls are left out
    per = steps_df.groupBy(*SESSION).agg(shown.alias("_s"), F.min_by("type", "pos").alias("head"), F.count("*").alias("length"))
    return per.select(*SESSION, F.array_join(F.transform("_s", lambda s: s["type"]), SEP).alias("clipped"), "head", "length")


def page(steps_df: DataFrame, offset: int = 0, limit: int = 28, clip: int = 60) -> DataFrame:
    """One page of each game's sessions in session order; a page past the end is the last one."""
    limit = max(1, min(200, limit))
    offset = max(0, offset)
    lengths = steps_df.groupBy(*SESSION).agg(F.count("*").alias("length"))
    order = ordered.numbered(lengths, ["game_id"], ["session_id"], "_rn")
    totals = lengths.groupBy("game_id").agg(F.count("*").alias("total"))
    start = F.when(F.lit(offset) >= F.col("total"), F.greatest(F.lit(0), F.col("total") - limit)).otherwise(offset)
    chosen = (
        order.join(totals, "game_id")
        .withColumn("i", F.col("_rn") - 1)
        .where((F.col("i") >= start) & (F.col("i") < start + limit))
        .select(*SESSION, "i", "length", "total")
    )
    shown = steps_df.where(F.col("pos") < clip).join(chosen, SESSION)
    return (
        shown.groupBy("game_id", "session_id", "i", "length", "total")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("_s"))
        .select(
            "game_id",
            "i",
            "session_id",
            "length",
            F.array_join(F.transform("_s", lambda s: s["type"]), SEP).alias("path"),
            (F.col("length") > clip).alias("clipped"),
            "total",
        )
    )
