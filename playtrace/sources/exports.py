"""Filtered exports and feeds of events and runs, and their CSV and JSON writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrace.functions.scalars import clock, iso_ms
from playtrace.operators import ordered
from playtrace.operators.scope import Scope, in_scope
from playtrace.session import durable

PAGE_ROWS = 50_000  # a page is cut from a range of ids with at most so many events of a game
RANGES = 1024  # ranges of a game's ids that are counted at once

# The columns of an export, in order.
EVENT_COLUMNS = ["id", "created_at", "iso", "username", "game_id", "session_id", "seq", "type", "t_ms", "payload"]
RUN_COLUMNS = ["id", "created_at", "username", "game_id", "level", "score", "stars", "session_id", "meta"]


def _named(df: DataFrame, players: DataFrame) -> DataFrame:
    return df.join(players.select(F.col("id").alias("player_id"), "username"), "player_id")


def _with_iso(events: DataFrame) -> DataFrame:
    return events if "iso" in events.columns else events.withColumn("iso", iso_ms("t_ms"))


def export_events(events: DataFrame, players: DataFrame, scope: Scope | None = None) -> DataFrame:
    rows = _named(_with_iso(in_scope(events, scope, players)), players)
    return rows.withColumn("created_at", clock("created_at")).select(*EVENT_COLUMNS).orderBy("id")


def export_runs(runs: DataFrame, players: DataFrame, scope: Scope | None = None) -> DataFrame:
    scope = scope and Scope(scope.start, scope.end, scope.users)
    rows = _named(in_scope(runs, scope, players), players)
    return rows.withColumn("created_at", clock("created_at")).select(*RUN_COLUMNS).orderBy("id")


def _spans(keys: DataFrame, first: int, last: int) -> tuple[DataFrame, int | None, int | None]:
    """For each game with events numbered first + 1 to last from the newest on: a range of ids (low to high) that holds them, how many events
    are newer, and the total; and the bounds of all these ranges.

    Ids are counted by ranges, and the ranges in which the page begins and ends are counted again more finely, until few events are left.
    """
    total = keys.groupBy("game_id").agg(F.count("id").alias("total"), F.min("id").alias("low"), F.max("id").alias("high"))
    spans = durable(total.where(F.col("total") > first).withColumn("newer", F.lit(0).cast("long")).withColumn("events", F.col("total")))
    before = None
    while True:
        width = F.sum((F.col("high") - F.col("low")).cast("double"))
        low, high, most, *size = spans.agg(F.min("low"), F.max("high"), F.max("events"), F.sum("events"), width).first()
        if low is None or most <= PAGE_ROWS or size == before:  # the last: both ends of a page in crowded ranges far apart
            return spans, low, high
        before = size
        step = F.ceil((F.col("high") - F.col("low") + 1) / F.lit(RANGES))
        inside = keys.where(F.col("id").between(low, high)).join(spans, "game_id").where(F.col("id").between(F.col("low"), F.col("high")))
        counts = inside.groupBy("game_id", "total", "low", "high", "newer", F.floor((F.col("id") - F.col("low")) / step).alias("range")).agg(F.count("*").alias("n"))
        newer = Window.partitionBy("game_id").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
        counts = counts.withColumn("newer", F.col("newer") + F.coalesce(F.sum("n").over(newer), F.lit(0)))
        counts = counts.where((F.col("newer") < last) & (F.col("newer") + F.col("n") > first)).withColumns({"a": F.col("low") + F.col("range") * step, "b": F.least("high", F.col("low") + (F.col("range") + 1) * step - 1)})
        spans = durable(counts.groupBy("game_id", "total").agg(F.min("a").alias("low"), F.max("b").alias("high"), F.min("newer").alias("newer"), F.sum("n").alias("events")))


def feed(
    events: DataFrame,
    players: DataFrame,
    type: str | None = None,
    since: int | None = None,
    username: str | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """One page of each game's events, newest first, and how many match in all; only a range of ids around the page is ordered."""
    limit, offset = max(1, min(500, limit)), max(0, offset)
    scope = Scope(users=(username,) if username else (), type=type)
    chosen = in_scope(events, scope, players)
    if since is not None:
        chosen = chosen.where(F.col("id") > max(0, since))
    chosen = _named(_with_iso(chosen), players)
    spans, low, high = _spans(chosen.select("game_id", "id"), offset, offset + limit)
    near = chosen.where(F.col("id").between(low, high)).join(spans.drop("events"), "game_id").where(F.col("id").between(F.col("low"), F.col("high")))
    page = ordered.numbered(near, ["game_id"], [F.desc("id")], "rank").withColumn("rank", F.col("rank") + F.col("newer"))
    return page.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).select(
        "game_id", F.col("rank").cast("int").alias("rank"), "id", "username", "session_id", "seq", "type", "t_ms", "iso", clock("created_at").alias("created_at"), "payload", "total"
    )


def existing_events(events: DataFrame) -> DataFrame:
    """Events already stored under each game, asked before an import adds to it."""
    return events.groupBy("game_id").agg(F.count("*").alias("events"))


def write_csv(df: DataFrame, path: str) -> None:
    """Header, empty text for missing values, objects as JSON, quotes only where needed."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    flat = df.withColumns({f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, nested)})
    flat.write.options(
        header=True, escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_json(df: DataFrame, path: str, nested: tuple[str, ...] = ("payload", "meta")) -> None:
    """JSON objects, one per line; JSON text columns become nested objects."""
    objects = {c: F.try_parse_json(c) for c in nested if c in df.columns}
    df.withColumns(objects).write.option("ignoreNullFields", False).json(path)
