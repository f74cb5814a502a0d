"""The filter every analysis applies: whole-day date range, players, activity."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_list(raw) -> list[str]:
    """A comma list or repeated values -> trimmed names, unique without case."""
    if raw is None or raw == "":
        return []
    text = ",".join(raw) if isinstance(raw, (list, tuple)) else str(raw)
    names: dict[str, str] = {}
    for part in (p.strip() for p in text.split(",")):
        if part:
            names.setdefault(part.lower(), part)
    return list(names.values())


@dataclass(frozen=True)
class Scope:
    start: str | None = None  # first day, YYYY-MM-DD
    end: str | None = None  # last day, inclusive
    users: tuple[str, ...] = ()
    type: str | None = None

    @staticmethod
    def last_days(days: int, anchor: dt.date) -> "Scope":
        """The date preset "last N days"; 0 means everything."""
        if not days:
            return Scope()
        return Scope(str(anchor - dt.timedelta(days=days)), str(anchor))


def selected_players(players: DataFrame, users) -> DataFrame:
    """Ids of the named players; names are unique without case."""
    wanted = [u.lower() for u in users]
    return players.where(F.lower("username").isin(wanted)).select(F.col("id").alias("player_id"))


def in_scope(df: DataFrame, scope: Scope | None, players: DataFrame | None = None) -> DataFrame:
    """Rows of a fact table inside ``scope``; joins players only if names are given."""
    if scope is None:
        return df
    if scope.start:
        df = df.where(F.col("created_at") >= F.to_timestamp_ntz(F.lit(scope.start[:10])))
    if scope.end:
        after = dt.date.fromisoformat(scope.end[:10]) + dt.timedelta(days=1)
        df = df.where(F.col("created_at") < F.to_timestamp_ntz(F.lit(str(after))))
    if scope.type is not None:
        df = df.where(F.col("type") == scope.type)
    users = user_list(list(scope.users))
    if users:
        df = df.join(selected_players(players, users), "player_id", "left_semi")
    return df
