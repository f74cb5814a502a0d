"""Streaming queries: the event table replayed in files, run until all of it is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from playtrace.functions.scalars import clock
from playtrace.plans import tables as t
from playtrace.plans.registry import clock as clock_sql
from playtrace.plans.registry import query, with_
from playtrace.session import shared_dir
from playtrace.streaming import feeds

DELAY = "40 days"  # the replayed files cover a month in no fixed order


def _fresh(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _replay(spark, d, copies: int = 1, change=lambda log: log):
    """The whole log as files of a stream, in about four batches; ``copies`` > 1 resends every event."""
    path = _fresh(spark)
    log = change(t.log(spark, d).select("id", "player_id", "game_id", "session_id", "seq", "type", "t_ms", "payload", "created_at"))
    for _ in range(copies):
        for part in (0, 1):
            log.where(F.col("id") % 2 == part).write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return feeds.open_stream(spark, path, log.schema, max(1, files // 4))


@query("stream_ingest_deduplicated", with_("ev") + "SELECT game_id, count(*) AS events, count(DISTINCT session_id) AS sessions FROM ev GROUP BY 1")
def stream_ingest_deduplicated(spark, d):
    stored = feeds.append_to(feeds.deduplicated(_replay(spark, d, copies=2), DELAY), _fresh(spark))
    return stored.groupBy("game_id").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))


@query(
    "stream_ingest_without_seq",
    with_("ev") + "SELECT game_id, CAST(sum(CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS events, count(DISTINCT id) AS ids FROM ev GROUP BY 1",
)
def stream_ingest_without_seq(spark, d):
    """Every seventh event has no number, so its two copies cannot be told from two events and both stay."""
    blank = lambda log: log.withColumn("seq", F.when(F.col("id") % 7 != 0, F.col("seq")))
    stored = feeds.append_to(feeds.deduplicated(_replay(spark, d, 2, blank), DELAY), _fresh(spark))
    return stored.groupBy("game_id").agg(F.count("*").alias("events"), F.count_distinct("id").alias("ids"))


@query("stream_last_seen", with_("pl") + f"SELECT id AS player_id, {clock_sql('last_seen_at')} AS last_seen_at FROM pl")
def stream_last_seen(spark, d):
    return feeds.last_seen(_replay(spark, d), _fresh(spark)).withColumn("last_seen_at", clock("last_seen_at"))


@query("stream_live_feed", with_("ev") + "SELECT id, game_id, session_id, type FROM ev WHERE id > 9000")
def stream_live_feed(spark, d):
    return feeds.append_to(feeds.since(_replay(spark, d), 9000), _fresh(spark)).select("id", "game_id", "session_id", "type")


@query("stream_running_totals", with_("ev") + "SELECT game_id, count(*) AS events FROM ev GROUP BY 1")
def stream_running_totals(spark, d):
    return feeds.running_totals(_replay(spark, d), _fresh(spark))


@query("stream_transition_counts", with_("ev", "tr") + 'SELECT game_id, src, dst, count(*) AS "count" FROM tr GROUP BY ALL')
def stream_transition_counts(spark, d):
    changes = feeds.append_to(feeds.transition_changes(_replay(spark, d), DELAY), _fresh(spark))
    return feeds.transition_counts(changes)
