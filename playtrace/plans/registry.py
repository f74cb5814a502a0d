"""Registered queries: a Spark function and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from playtrace.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The derivations of plans/tables.py, as SQL.
CTES = {
    "ev": """ev AS (
  SELECT event_id AS id, user_id AS player_id,
         'g' || CAST((user_id + day(ts)) % 3 AS VARCHAR) AS game_id,
         CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS seq,
         event_type AS type, epoch_us(ts) // 1000 AS t_ms, props AS payload, value, ts AS created_at
  FROM events)""",
    "runs": """runs AS (
  SELECT game_id, session_id, player_id, min(id) AS id, arg_min(type, seq) AS level,
         arg_max(value, seq) / 100.0 AS score,
         CAST(least(3, count(*) FILTER (WHERE type = 'purchase')) AS INTEGER) AS stars,
         min(created_at) AS created_at
  FROM ev GROUP BY ALL)""",
    "pl": """pl AS (
  SELECT user_id AS id, 'player_' || CAST(user_id AS VARCHAR) AS username,
         min(ts) AS created_at, max(ts) AS last_seen_at FROM events GROUP BY user_id)""",
    "chat": """chat AS (
  SELECT 'chat' AS game_id, CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role AS type
  FROM conversations)""",
    "sess": """sess AS (
  SELECT game_id, session_id, count(*) AS events,
         greatest(0, max(t_ms) - min(t_ms)) / 60000.0 AS minutes FROM ev GROUP BY ALL)""",
    "tr": """tr AS (
  SELECT game_id, session_id, seq AS pos, type AS src, nxt AS dst FROM (
    SELECT *, lead(type) OVER (PARTITION BY game_id, session_id ORDER BY seq) AS nxt FROM ev)
  WHERE nxt IS NOT NULL)""",
    "paths": """paths AS (
  SELECT game_id, session_id, string_agg(type, ' > ' ORDER BY seq) AS path, count(*) AS length
  FROM ev GROUP BY ALL)""",
}


def with_(*names: str) -> str:
    """The WITH clause for the named derivations, in order."""
    return "WITH RECURSIVE " + ",\n".join(CTES[n] for n in names) + "\n"


def r(expr: str, digits: int = 4) -> str:
    """Round half up, as functions.scalars.round_half_up does."""
    f = f"{10 ** (digits or 4)}.0::DOUBLE"
    return f"(floor(({expr}) * {f} + 0.500000001::DOUBLE) / {f})"


def clock(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def shipped(fn):
    """fn, with this package on the workers."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = shipped(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    from playtrace.plans import cluster_queries, engagement_queries, import_queries, model_queries, prediction_queries, sequence_queries, streaming_queries  # noqa: F401
