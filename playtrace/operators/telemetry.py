"""Analyses that read one game's own payload fields, and the registry of such modules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.functions.scalars import finite, js_round, number, round_half_up
from playtrace.operators.engagement import bucket_index, fill_buckets

# Heatmap size, reaction histogram, warm-up and support limits.
GRID_X, GRID_Y = 16, 10
REACTION_EDGES = [250, 350, 450, 550, 650, 750]
REACTION_LABELS = ["<250", "250–350", "350–450", "450–550", "550–650", "650–750", "750+"]
MAX_ORDINAL = 40
MIN_SUPPORT = 3
MIN_TAPS = 5

FIELDS = "x string, y string, reaction_ms string, n string"
PAYLOAD = f"{FIELDS}, payload struct<{FIELDS.replace(' string', ': string')}>, _corrupt string"


def taps(events: DataFrame) -> DataFrame:
    """Hits, misses and expired targets with their fields, top-level or nested."""
    kinds = events.where(F.col("type").isin("hit", "miss", "expire") & F.col("payload").isNotNull())
    read = kinds.withColumn("p", F.from_json("payload", PAYLOAD, {"columnNameOfCorruptRecord": "_corrupt"}))
    field = lambda f: F.coalesce(F.col(f"p.{f}"), F.col(f"p.payload.{f}"))
    reaction = finite(number(field("reaction_ms")))
    ordinal = F.coalesce(F.nullif(js_round(finite(number(field("n")))), F.lit(0)), F.lit(1))
    return read.where(F.col("p").isNotNull() & F.col("p._corrupt").isNull()).select(
        "game_id",
        "player_id",
        F.col("type").alias("kind"),
        field("x").alias("x"),
        field("y").alias("y"),
        F.when((F.col("type") == "hit") & (reaction > 0), reaction).alias("reaction"),
        F.greatest(F.lit(1), F.least(F.lit(MAX_ORDINAL), ordinal)).cast("int").alias("n"),
    )


def totals(t: DataFrame) -> DataFrame:
    hits, misses, expires = (F.count_if(F.col("kind") == k) for k in ("hit", "miss", "expire"))
    return t.groupBy("game_id").agg(
        hits.alias("hits"),
        misses.alias("misses"),
        expires.alias("expires"),
        F.count("*").alias("taps"),
        round_half_up(hits / F.count("*")).alias("accuracy"),
        round_half_up((misses + expires) / F.count("*")).alias("miss_rate"),
        round_half_up(F.avg("reaction"), 1).alias("avg_reaction"),
        F.min("reaction").alias("fastest_reaction"),
        F.max("reaction").alias("slowest_reaction"),
    )


def heatmap(t: DataFrame) -> DataFrame:
    """Hit and miss counts on the 16 x 10 grid, empty cells included."""
    at = lambda c, size: F.greatest(
        F.lit(0), F.least(F.lit(size - 1), F.floor(F.coalesce(finite(number(c)), F.lit(0.0)) * size))
    ).cast("int")
    placed = t.where(F.col("kind").isin("hit", "miss") & F.col("x").isNotNull() & F.col("y").isNotNull())
    counts = (
        placed.select("game_id", "kind", at("x", GRID_X).alias("cx"), at("y", GRID_Y).alias("cy"))
        .groupBy("game_id", "cx", "cy")
        .agg(F.count_if(F.col("kind") == "hit").alias("hits"), F.count_if(F.col("kind") == "miss").alias("misses"))
    )
    spine = (
        t.select("game_id").distinct()
        .select("game_id", F.explode(F.sequence(F.lit(0), F.lit(GRID_X - 1))).alias("cx"))
        .select("game_id", "cx", F.explode(F.sequence(F.lit(0), F.lit(GRID_Y - 1))).alias("cy"))
    )
    peak = counts.groupBy("game_id").agg(F.max(F.greatest("hits", "misses")).alias("max"))
    return (
        spine.join(counts, ["game_id", "cx", "cy"], "left")
        .join(peak, "game_id", "left")
        .select("game_id", "cx", "cy", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "misses")], F.greatest(F.lit(1), "max").alias("max"))
    )


def reaction_histogram(t: DataFrame) -> DataFrame:
    counts = t.groupBy("game_id", bucket_index(F.col("reaction"), REACTION_EDGES).alias("b")).agg(F.count("*").alias("n"))
    return fill_buckets(counts, counts.select("game_id").distinct(), REACTION_LABELS)


def warm_up(t: DataFrame) -> DataFrame:
    """Mean reaction by the ordinal of the target in its round."""
    return (
        t.where(F.col("reaction").isNotNull())
        .groupBy("game_id", "n")
        .agg(F.count("*").alias("count"), F.avg("reaction").alias("r"))
        .where(F.col("count") >= MIN_SUPPORT)
        .select("game_id", "n", round_half_up("r", 1).alias("reaction"), "count")
    )


def player_speed(t: DataFrame, players: DataFrame) -> DataFrame:
    """Speed against accuracy of every player with enough taps."""
    per = (
        t.groupBy("game_id", "player_id")
        .agg(F.count("*").alias("taps"), F.count_if(F.col("kind") == "hit").alias("hits"), F.avg("reaction").alias("r"))
        .where(F.col("taps") >= MIN_TAPS)
    )
    return per.join(players.select(F.col("id").alias("player_id"), "username"), "player_id").select(
        "game_id", "username", "taps", "hits", round_half_up(F.col("hits") / F.col("taps")).alias("accuracy"), round_half_up("r", 1).alias("avg_reaction")
    )


def plotted_players(speed: DataFrame) -> DataFrame:
    """The scatter keeps players with both values."""
    return speed.where(F.col("accuracy").isNotNull() & F.col("avg_reaction").isNotNull())


@dataclass(frozen=True)
class Module:
    """An analysis for one game: ``compute(events, players)`` returns named results."""

    game_id: str
    label: str
    compute: Callable[[DataFrame, DataFrame], dict[str, DataFrame]]


MODULES: dict[str, Module] = {}


def register(module: Module) -> None:
    MODULES[module.game_id] = module


def specific(game_id: str, events: DataFrame, players: DataFrame) -> dict[str, DataFrame]:
    """Results of the game's own module; empty if it has none."""
    module = MODULES.get(game_id)
    return module.compute(events.where(F.col("game_id") == game_id), players) if module else {}


def tap_results(events: DataFrame, players: DataFrame) -> dict[str, DataFrame]:
    t = taps(events)
    return {
        "totals": totals(t),
        "heatmap": heatmap(t),
        "reaction_histogram": reaction_histogram(t),
        "warm_up": warm_up(t),
        "players": player_speed(t, players),
    }


register(Module("tap-game", "Tap insights", tap_results))
