"""The given parquet tables read as an event log, runs and players.

Every table is derived by Spark from the whole of ``events`` or ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrace.operators import ordered, sequences


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event envelope without ``seq``: one game per player and day, one session per player-day."""
    ts, user = F.col("ts"), F.col("user_id")
    return _raw(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        user.alias("player_id"),
        F.concat(F.lit("g"), ((user + F.day(ts)) % 3).cast("string")).alias("game_id"),
        F.concat(user.cast("string"), F.lit("-"), F.to_date(ts).cast("string")).alias("session_id"),
        F.col("event_type").alias("type"),
        F.unix_millis(ts.cast("timestamp")).alias("t_ms"),
        F.col("props").alias("payload"),
        F.col("value"),
        ts.alias("created_at"),
    )


_prepared: dict[tuple, DataFrame] = {}


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event envelope with ``seq``."""
    rn = ordered.numbered(events(spark, sf_dir), ["session_id"], ["created_at", "id"], "_rn")
    return rn.withColumn("seq", F.col("_rn") - 1).drop("_rn")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered steps of all sessions, the shared input of every sequence analysis.

    Kept once per session and folder, in the few columns those analyses read, and
    partitioned by session; lost blocks are recomputed.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _prepared:
        _prepared[key] = sequences.steps(log(spark, sf_dir)).persist()
    return _prepared[key]


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _raw(spark, sf_dir)
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_seen_at"))
        .select("id", F.concat(F.lit("player_"), F.col("id").cast("string")).alias("username"), "created_at", "last_seen_at")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per session; its score is the session's last value."""
    first, last = F.struct("created_at", "id"), F.struct("created_at", "id")
    return (
        events(spark, sf_dir)
        .groupBy("game_id", "session_id", "player_id")
        .agg(
            F.min("id").alias("id"),
            F.min_by("type", first).alias("level"),
            (F.max_by("value", last) / F.lit(100.0)).alias("score"),
            F.least(F.lit(3), F.count_if(F.col("type") == "purchase")).cast("int").alias("stars"),
            F.min("created_at").alias("created_at"),
        )
        .withColumn("meta", F.to_json(F.struct("level", "stars")))
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as an event log: the role is the activity, the turn the order."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"),
        F.lit("chat").alias("game_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("seq"),
        F.col("role").alias("type"),
        (F.col("turn") * 1000).alias("t_ms"),
    )


def taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tap telemetry; every second event nests its fields under ``payload``."""
    k = F.get_json_object("payload", "$.k").cast("long")
    kind = F.create_map(*[F.lit(x) for x in ("click", "hit", "error", "miss", "view", "expire")])[F.col("type")]
    fields = F.struct(
        ((k % 10) / F.lit(10.0)).alias("x"),
        (F.floor(k / 10) / F.lit(10.0)).alias("y"),
        F.col("value").alias("reaction_ms"),
        (F.col("seq") + 1).alias("n"),
    )
    return (
        log(spark, sf_dir)
        .withColumn("type", F.coalesce(kind, F.col("type")))
        .withColumn(
            "payload",
            F.when(F.col("id") % 2 == 0, F.to_json(fields)).otherwise(F.to_json(F.struct(fields.alias("payload")))),
        )
    )


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as an untyped export of another tool, with blanks and unreadable values in known rows."""
    ident = F.col("id")
    return log(spark, sf_dir).select(
        F.when(ident % 41 == 0, "").otherwise(F.col("session_id")).alias("Case ID"),
        F.when(ident % 50 == 0, " ").otherwise(F.col("type")).alias("Activity"),
        F.when(ident % 37 == 0, "n/a")
        .when(ident % 3 == 0, F.col("t_ms").cast("string"))
        .otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .alias("Timestamp"),
        F.when(ident % 43 == 0, "").otherwise(F.concat(F.lit("Student "), F.col("player_id").cast("string"))).alias("Student"),
        F.col("seq").cast("string").alias("Order"),
        F.when(ident % 11 == 0, "oops").when(ident % 7 == 0, "").otherwise(F.col("value").cast("string")).alias("Score"),
        ident.alias("_row"),
    )
