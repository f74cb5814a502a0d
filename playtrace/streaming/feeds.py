"""Event streams: deduplicated ingest, last seen, live feed, running totals, transition counts."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from playtrace.functions.scalars import activity
from playtrace.operators.sequences import SESSION
from playtrace.session import shared_dir

# What a client sends along with an event, so a resent one has the same.
RESEND_KEY = ("game_id", "player_id", "session_id", "seq", "t_ms")
FAN = 8  # tables of one level that are merged into one of the next
BUCKETS = 1 << 10  # of a game's sessions, each with one state
IDLE_MS = 24 * 3_600_000  # a session silent for so long behind the watermark is over


def open_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as a stream; ``created_at`` becomes the event time."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("created_at", F.col("created_at").cast("timestamp"))


def deduplicated(stream: DataFrame, delay: str, key: tuple[str, ...] = RESEND_KEY) -> DataFrame:
    """Clients resend what was not confirmed; keep the first copy seen within ``delay``.

    An event without one of the key's parts cannot be told from another, so all of those are kept.
    """
    marked = stream.withWatermark("created_at", delay)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return marked.where(known).dropDuplicatesWithinWatermark(list(key)).unionByName(marked.where(~known))


def since(stream: DataFrame, cursor: int) -> DataFrame:
    """The live feed: events after a cursor id."""
    return stream.where(F.col("id") > max(0, cursor))


def _drain(writer, spark) -> int:
    """Process everything that is there, then stop; progress is kept in the shared folder. Returns the rows dropped as too late."""
    query = writer.option("checkpointLocation", f"{shared_dir(spark)}/{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def append_to(stream: DataFrame, path: str, late: list[int] | None = None) -> DataFrame:
    """Append the stream to a parquet table exactly once and read that table; ``late`` receives the number of rows dropped as too late."""
    spark = stream.sparkSession
    dropped = _drain(stream.writeStream.format("parquet").option("path", path).outputMode("append"), spark)
    if late is not None:
        late.append(dropped)
    return spark.read.schema(stream.schema).parquet(path)


def _complete_tables(spark, path: str) -> list[tuple[int, int]]:
    """(level, first batch) of every table below ``path`` that was written to its end."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*/*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    parents = [f.getPath().getParent() for f in found]
    return sorted((int(p.getParent().getName()), int(p.getName())) for p in parents)


def _covering(tables: list[tuple[int, int]], number: int) -> int:
    """The highest level whose table holds this batch, or -1."""
    return max((level for level, start in tables if start <= number < start + FAN**level), default=-1)


def _add_batch(batch: DataFrame, number: int, path: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Keep a batch as a table of level 0; FAN neighbouring tables of a level become one of the next.

    A table's name says which batches it holds, so a repeated batch replaces itself or is known to be merged already.
    Tables that were merged before this batch are deleted, so a reader has the time of a batch to finish.
    """
    spark = batch.sparkSession
    before = _complete_tables(spark, path)
    level = _covering(before, number)
    if level < 1:
        merge(batch).write.mode("overwrite").parquet(f"{path}/0/{number}")
        level = 0
    while (number + 1) % FAN ** (level + 1) == 0:
        start = number + 1 - FAN ** (level + 1)
        parts = [f"{path}/{level}/{at}" for of, at in _complete_tables(spark, path) if of == level and start <= at <= number]
        level += 1
        merge(spark.read.parquet(*parts)).write.mode("overwrite").parquet(f"{path}/{level}/{start}")
    for low, start in before:
        if _covering(before, start) > low:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{low}/{start}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _read_merged(spark, path: str, merge: Callable[[DataFrame], DataFrame], schema) -> DataFrame:
    """All batches, each from the table of the highest level that holds it."""
    tables = _complete_tables(spark, path)
    top = [f"{path}/{level}/{start}" for level, start in tables if _covering(tables, start) == level]
    return merge(spark.read.schema(schema).parquet(*top) if top else spark.createDataFrame([], schema))


def last_seen(stream: DataFrame, path: str) -> DataFrame:
    """Latest event time of each player: every batch adds its maxima, readers merge them. ``path`` belongs to this stream."""
    spark = stream.sparkSession
    latest = lambda df: df.groupBy("player_id").agg(F.max("last_seen_at").alias("last_seen_at"))
    seen = stream.select("player_id", F.col("created_at").alias("last_seen_at"))
    _drain(seen.writeStream.foreachBatch(lambda batch, number: _add_batch(batch, number, path, latest)), spark)
    return _read_merged(spark, path, latest, seen.schema)


def running_totals(stream: DataFrame, path: str) -> DataFrame:
    """Events per game, refreshed by every batch; the newest figure of each game counts. ``path`` belongs to this stream."""
    spark = stream.sparkSession
    newest = lambda df: df.groupBy("game_id").agg(F.max_by("events", "batch").alias("events"), F.max("batch").alias("batch"))
    counts = stream.groupBy("game_id").agg(F.count("*").alias("events"))
    save = lambda batch, number: _add_batch(batch.withColumn("batch", F.lit(number).cast("long")), number, path, newest)
    _drain(counts.writeStream.foreachBatch(save).outputMode("update"), spark)
    return _read_merged(spark, path, newest, "game_id string, events long, batch long").select("game_id", "events")


def _pairs(steps: list[tuple]) -> Counter:
    return Counter((a[2], b[2]) for a, b in zip(steps, steps[1:]))


def _edge_changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Insert new events into the recent steps of a bucket's sessions and emit which pairs came and went.

    Leading steps of a session older than the watermark are final; of them only the last one is kept,
    to connect to the next step. A session that stays silent for IDLE_MS is forgotten.
    """
    final = state.getCurrentWatermarkMs()
    kept: dict[str, list[tuple]] = {}
    until: dict[str, int] = {}
    for session, end, *step in zip(*state.get) if state.exists else ():
        kept.setdefault(session, []).append(tuple(step))
        until[session] = end
    fresh: dict[str, list[tuple]] = {}
    for pdf in () if state.hasTimedOut else batches:
        for session, *step in zip(*(pdf[c].tolist() for c in ("session_id", "seq", "id", "type", "at"))):
            fresh.setdefault(session, []).append(tuple(step))
    rows = []
    for session, new in fresh.items():
        old, late = kept.get(session, []), 0
        if old and old[0][3] < final:  # in time, but before a step that is settled
            late = sum(s[:2] <= old[0][:2] for s in new)
            new = [s for s in new if s[:2] > old[0][:2]]
        merged = sorted(old + new)
        change = _pairs(merged)
        change.subtract(_pairs(old))
        rows += [(key[0], session, a, b, n, 0) for (a, b), n in change.items() if n] + [(key[0], session, None, None, 0, late)] * bool(late)
        settled = next((i for i, s in enumerate(merged) if s[3] >= final), len(merged))
        kept[session] = merged[max(0, settled - 1) :]
        until[session] = max(final, max(s[3] for s in merged)) + IDLE_MS
    steps = [(session, until[session], *s) for session, own in kept.items() if session in fresh or until[session] > final for s in own]
    if steps:
        state.update(tuple(list(c) for c in zip(*steps)))
        state.setTimeoutTimestamp(min(s[1] for s in steps))
    else:
        state.remove()
    if rows:
        yield pd.DataFrame(rows, columns=["game_id", "session_id", "src", "dst", "delta", "late"])


def transition_changes(stream: DataFrame, delay: str) -> DataFrame:
    """Signed changes of directly-follows counts; their sum is the batch result, in any arrival order.

    The state of a game's sessions lies in BUCKETS buckets, as a call for every single session takes longer than its work.
    Steps older than the watermark are left out and counted by ``append_to``; rows without src count steps that came in
    time but belong before a settled one.
    """
    first = F.lit(-(1 << 31)).cast("long")  # events without a sequence number come first
    known = stream.where(F.col("session_id").isNotNull()).select(
        *SESSION,
        F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).alias("bucket"),
        "created_at",
        F.coalesce(F.col("seq").cast("long"), first).alias("seq"),
        "id",
        activity().alias("type"),
        F.unix_millis("created_at").alias("at"),
    )
    return (
        known.withWatermark("created_at", delay)
        .groupBy("game_id", "bucket")
        .applyInPandasWithState(
            _edge_changes,
            "game_id string, session_id string, src string, dst string, delta long, late long",
            "session_id array<string>, until array<long>, seq array<long>, id array<long>, type array<string>, at array<long>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def transition_counts(changes: DataFrame) -> DataFrame:
    known = changes.where("src IS NOT NULL")
    return known.groupBy("game_id", "src", "dst").agg(F.sum("delta").alias("count")).where(F.col("count") != 0)


def late_steps(changes: DataFrame) -> DataFrame:
    """Steps of each game that came in time, but after their place was settled, and are in no count."""
    return changes.groupBy("game_id").agg(F.sum("late").alias("late"))
