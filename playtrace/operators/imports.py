"""Importing an event log: normalise, order, assign players, append; list and delete batches."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.functions import scalars as s
from playtrace.operators import ordered
from playtrace.sources.logs import ROW, ImportProblem, headers


@dataclass
class Batch:
    """What one import appends; all lazily evaluated."""

    events: DataFrame
    runs: DataFrame
    new_players: DataFrame
    registry: DataFrame
    settings: dict = field(default_factory=dict)


def check_request(game_id: str, mapping: dict) -> None:
    import re

    if not re.match(s.SLUG, game_id or ""):
        raise ImportProblem("game id must be a slug: lowercase letters, numbers, dashes")
    if game_id in s.RESERVED_SLUGS:
        raise ImportProblem(f"{game_id!r} is reserved")
    if not mapping.get("activity"):
        raise ImportProblem("an activity column is required")


def actor_mode(mapping: dict, mode: str | None = None) -> str:
    return mode or ("column" if mapping.get("actor") else "session")


def items(raw: DataFrame, mapping: dict, mode: str | None = None) -> DataFrame:
    """Typed rows with an activity: session, actor, order hints, outcomes, the row as JSON."""
    mode = actor_mode(mapping, mode)

    def at(role: str) -> Column:
        return F.col(f"`{mapping[role]}`") if mapping.get(role) else F.lit(None).cast("string")

    session = at("session").cast("string")
    session = F.when(F.trim(session) != "", session).otherwise("session-1")
    if mode == "single":
        actor = F.lit("imported")
    elif mode == "column" and mapping.get("actor"):
        actor = s.safe_name(s.safe_name(at("actor")))
    else:
        actor = s.safe_name(F.concat(F.lit("case-"), session))
    seq = F.when(at("seq").isNull(), 0.0).otherwise(s.number(at("seq"))) if mapping.get("seq") else F.lit(None).cast("double")
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in headers(raw)]), {"ignoreNullFields": "false"})
    activity = at("activity").cast("string")
    return raw.where(F.trim(activity) != "").select(
        session.alias("session_id"),
        actor.alias("actor"),
        activity.alias("type"),
        s.epoch_ms(at("timestamp")).alias("ms"),
        seq.alias("seq_hint"),
        s.outcome_number(at("score")).alias("score"),
        s.outcome_int(at("stars")).cast("int").alias("stars"),
        s.outcome_text(at("level")).alias("level"),
        whole.alias("payload"),
        F.col(ROW),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Position in the session: explicit sequence, then time, then file order."""
    order = [F.asc_nulls_last("seq_hint"), F.asc_nulls_last("ms"), F.col(ROW)]
    return ordered.numbered(rows, ["session_id"], order, "_rn").withColumn("seq", F.col("_rn") - 1).drop("_rn")


def sessions(rows: DataFrame) -> DataFrame:
    """Owner, start and outcome (last value that is present) of each session."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("session_id").agg(
        F.min_by("actor", "seq").alias("actor"),
        F.min_by("ms", F.when(F.col("ms").isNotNull(), F.col("seq"))).alias("start_ms"),
        F.min(ROW).alias("_first"),
        last("score"),
        last("stars"),
        last("level"),
    )


def resolve_players(owners: DataFrame, players: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Find each actor by name without case, or create a player with the next id.

    Returns ``(key, player_id)`` for every actor and the new players.
    """
    wanted = owners.groupBy(F.lower("actor").alias("key")).agg(
        F.min_by("actor", "_first").alias("username"),
        F.min_by("start_ms", "_first").alias("start_ms"),
        F.min("_first").alias("_first"),
    )
    known = players.select(F.lower("username").alias("key"), F.col("id").alias("player_id"))
    found = wanted.join(known, "key").select("key", "player_id")
    missing = wanted.join(known, "key", "left_anti").withColumn("_all", F.lit(0))
    top = players.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    fresh = ordered.durable(
        ordered.numbered(missing, ["_all"], ["_first"], "_rn")
        .join(F.broadcast(top))
        .select(
            (F.col("_top") + F.col("_rn")).alias("id"),
            "username",
            F.coalesce(s.sql_time("start_ms"), F.lit(now)).alias("created_at"),
        )
        .withColumn("last_seen_at", F.col("created_at"))
    )
    return found.unionByName(fresh.select(F.lower("username").alias("key"), F.col("id").alias("player_id"))), fresh


def commit(
    raw: DataFrame,
    players: DataFrame,
    game_id: str,
    mapping: dict,
    import_id: int,
    now: str,
    mode: str | None = None,
    filename: str | None = None,
    fmt: str = "csv",
) -> Batch:
    """Everything one import appends, tagged with ``import_id``; ``now`` stamps undated rows."""
    check_request(game_id, mapping)
    mode = actor_mode(mapping, mode)
    rows = ordered.durable(in_order(items(raw, mapping, mode)))
    per = ordered.durable(sessions(rows))
    ids, fresh = resolve_players(per.select("actor", "start_ms", "_first"), players, now)
    owned = per.withColumn("key", F.lower("actor")).join(ids, "key").drop("key")
    tag = [F.lit(game_id).alias("game_id"), F.lit(import_id).cast("long").alias("import_id")]
    events = rows.join(owned.select("session_id", "player_id"), "session_id").select(
        "player_id",
        *tag,
        "session_id",
        "seq",
        "type",
        F.coalesce("ms", F.col("seq") * 1000).alias("t_ms"),
        s.iso_ms("ms").alias("iso"),
        "payload",
        F.coalesce(s.sql_time("ms"), F.lit(now)).alias("created_at"),
    )
    runs = owned.select(
        "player_id",
        *tag,
        "level",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "stars",
        "session_id",
        F.to_json(F.struct(F.lit(True).alias("imported"), F.lit(import_id).alias("import_id"))).alias("meta"),
        F.coalesce(s.sql_time("start_ms"), F.lit(now)).alias("created_at"),
    )
    registry = summary(raw, rows, per, fresh, bool(mapping.get("timestamp"))).select(
        F.lit(import_id).cast("long").alias("id"),
        F.lit(game_id).alias("game_id"),
        F.lit(filename).cast("string").alias("filename"),
        F.lit(fmt).alias("format"),
        "*",
        F.lit(json.dumps(mapping)).alias("mapping"),
        F.lit(mode).alias("actor_mode"),
        F.lit(now).alias("created_at"),
    )
    has_outcome = bool(mapping.get("score") or mapping.get("stars"))
    return Batch(events, runs, fresh, registry, {"actor_mode": mode, "has_outcome": has_outcome})


def summary(raw: DataFrame, rows: DataFrame, per_session: DataFrame, fresh: DataFrame, dated: bool) -> DataFrame:
    """One row: sizes, unparsed timestamps and date range of an import."""
    undated = F.count_if(F.col("ms").isNull()) if dated else F.lit(0).cast("long")
    facts = rows.agg(
        F.count("*").alias("events"),
        F.count_distinct("type").alias("activities"),
        undated.alias("unparsed_timestamps"),
        s.sql_time(F.min("ms")).alias("date_from"),
        s.sql_time(F.max("ms")).alias("date_to"),
    )
    parts = [
        raw.agg(F.count("*").alias("rows")),
        per_session.agg(F.count("*").alias("sessions"), F.count("*").alias("runs")),
        fresh.agg(F.count("*").alias("players_created")),
    ]
    for p in parts:  # one row each
        facts = facts.join(F.broadcast(p))
    return facts.select(
        "rows", "events", "sessions", "runs", "players_created", "activities", "unparsed_timestamps", "date_from", "date_to"
    )


def list_batches(registry: DataFrame, game_id: str | None = None) -> DataFrame:
    """Import batches, newest first."""
    chosen = registry.where(F.col("game_id") == game_id) if game_id and game_id.strip() else registry
    return chosen.drop("mapping").orderBy(F.desc("id"))


@dataclass
class Deletion:
    events: DataFrame
    runs: DataFrame
    players: DataFrame
    registry: DataFrame
    report: DataFrame


def delete_batch(events: DataFrame, runs: DataFrame, players: DataFrame, registry: DataFrame, import_id: int) -> Deletion:
    """The tables without one import; players it touched go too if nothing of theirs is left."""
    mine = F.col("import_id").eqNullSafe(F.lit(import_id))
    left_events, left_runs = events.where(~mine), runs.where(~mine)
    touched = events.where(mine).select("player_id").union(runs.where(mine).select("player_id")).distinct()
    orphans = (
        touched.join(left_events.select("player_id"), "player_id", "left_anti")
        .join(left_runs.select("player_id"), "player_id", "left_anti")
        .withColumnRenamed("player_id", "id")
    )
    report = events.agg(F.count_if(mine).alias("events"))
    for one in (
        runs.agg(F.count_if(mine).alias("runs")),
        players.join(orphans, "id", "left_semi").agg(F.count("*").alias("players_removed")),
    ):  # one row each
        report = report.join(F.broadcast(one))
    return Deletion(
        left_events,
        left_runs,
        players.join(orphans, "id", "left_anti"),
        registry.where(F.col("id") != import_id),
        report.select(F.lit(import_id).cast("long").alias("id"), "events", "runs", "players_removed"),
    )
