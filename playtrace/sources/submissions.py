"""Event and run submissions of game clients (JSON bodies) as envelope rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.functions.scalars import finite, js_round, number, number_or

EVENT = "seq string, type string, t string, iso string, sessionId string"


def _events(bodies: DataFrame, last: int | None) -> DataFrame:
    """One row per stored event, of a submission's ``last`` ones if that is given; ``raw`` keeps the event as it was sent."""
    events = F.coalesce(F.from_json(F.get_json_object("body", "$.events"), "array<string>"), F.array().cast("array<string>"))
    if last is not None:
        events = F.slice(events, F.greatest(F.lit(1), F.size(events) - last + 1), last)
    return bodies.withColumn("raw", F.explode(events))


def event_rows(bodies: DataFrame, last: int | None = None) -> DataFrame:
    """``game_id, player_id, body`` -> events; the batch's session wins over the event's own."""
    ev = _events(bodies, last).withColumn("e", F.from_json("raw", EVENT))
    batch = F.nullif(F.get_json_object("body", "$.session_id"), F.lit(""))
    return ev.select(
        "game_id",
        "player_id",
        F.coalesce(batch, F.nullif("e.sessionId", F.lit(""))).alias("session_id"),
        F.col("e.seq").try_cast("int").alias("seq"),
        F.col("e.type").alias("type"),
        F.when(F.col("e.t").isNotNull(), js_round(F.coalesce(finite(number("e.t")), F.lit(0.0)))).alias("t_ms"),
        F.col("e.iso").alias("iso"),
        F.col("raw").alias("payload"),
    )


def run_rows(bodies: DataFrame) -> DataFrame:
    """``game_id, player_id, body`` -> runs."""
    get = lambda f: F.get_json_object("body", f"$.{f}")
    return bodies.select(
        "game_id",
        "player_id",
        get("level").alias("level"),
        number_or(get("score"), 0).alias("score"),
        F.when(get("stars").isNotNull(), js_round(number_or(get("stars"), 0))).cast("int").alias("stars"),
        get("session_id").alias("session_id"),
        get("meta").alias("meta"),
    )
