import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from playtrace.operators import sequences
from playtrace.streaming import feeds

SCHEMA = "id long, player_id long, game_id string, session_id string, seq long, type string, t_ms long, created_at timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def _files(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return feeds.open_stream(spark, path, spark.createDataFrame([], SCHEMA).schema)


def _event(i, session, kind):
    return (i, i % 3, "g", session, i, kind, i * 1000, DAY + dt.timedelta(seconds=i))


def test_transitions_from_any_arrival_order(spark, tmp_path):
    rnd = random.Random(2)
    rows = [_event(i, rnd.choice("xyz"), rnd.choice("abc")) for i in range(60)]
    mixed = rnd.sample(rows, len(rows))
    stream = _files(spark, str(tmp_path / "in"), [mixed[i::4] for i in range(4)])
    changes = feeds.append_to(feeds.transition_changes(stream, "1 day"), str(tmp_path / "out"))
    got = {(r["src"], r["dst"]): r["count"] for r in feeds.transition_counts(changes).collect()}
    batch = sequences.transitions(sequences.steps(spark.createDataFrame(rows, SCHEMA)))
    want = {(r["src"], r["dst"]): r["count"] for r in batch.groupBy("src", "dst").count().collect()}
    assert got == want


def test_transitions_with_settled_steps(spark, tmp_path):
    rows = [_event(i, "x", "ab"[i % 2]) for i in range(40)]
    stream = _files(spark, str(tmp_path / "in"), [rows[i : i + 10] for i in range(0, 40, 10)])
    changes = feeds.append_to(feeds.transition_changes(stream, "2 seconds"), str(tmp_path / "out"))
    got = {(r["src"], r["dst"]): r["count"] for r in feeds.transition_counts(changes).collect()}
    assert got == {("a", "b"): 20, ("b", "a"): 19}


def test_resent_events_are_stored_once(spark, tmp_path):
    rows = [_event(i, "x", "a") for i in range(20)]
    stream = _files(spark, str(tmp_path / "in"), [rows[:12], rows[6:], rows])
    stored = feeds.append_to(feeds.deduplicated(stream, "1 hour"), str(tmp_path / "out"))
    assert sorted(r["id"] for r in stored.collect()) == list(range(20))


def test_events_without_key_parts_are_all_stored(spark, tmp_path):
    rows = [(*_event(i, "x", "a")[:4], None, "a", 0, DAY) for i in range(5)]
    two = [(9, 1, "g", "s", 1, "a", 7, DAY), (10, 2, "g", "s", 1, "a", 7, DAY), (9, 1, "g", "s", 1, "a", 7, DAY)]  # two players in one session id
    stream = _files(spark, str(tmp_path / "in"), [rows, two])
    stored = feeds.append_to(feeds.deduplicated(stream, "1 hour"), str(tmp_path / "out"))
    assert sorted(r["id"] for r in stored.collect()) == [0, 1, 2, 3, 4, 9, 10]


def test_late_steps_are_counted(spark, tmp_path):
    rows = [_event(i, "x", "ab"[i % 2]) for i in range(0, 40)]
    late = [rows[3], rows[5]]
    rest = [r for r in rows if r not in late]
    stream = _files(spark, str(tmp_path / "in"), [rest[:18], rest[18:30], rest[30:34], late + rest[34:]])
    dropped = []
    changes = feeds.append_to(feeds.transition_changes(stream, "2 seconds"), str(tmp_path / "out"), dropped)
    assert dropped == [2]
    assert sum(r["count"] for r in feeds.transition_counts(changes).collect()) == len(rest) - 1


def test_last_seen_and_totals(spark, tmp_path):
    rows = [_event(i, "x", "a") for i in range(30)]
    stream = _files(spark, str(tmp_path / "in"), [rows[:10], rows[20:], rows[10:20]])
    seen = {r["player_id"]: r["last_seen_at"] for r in feeds.last_seen(stream, str(tmp_path / "seen")).collect()}
    assert seen == {p: DAY + dt.timedelta(seconds=27 + p) for p in range(3)}
    assert feeds.running_totals(stream, str(tmp_path / "totals")).first()["events"] == 30


def test_batches_are_merged_into_few_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "FAN", 3)
    path = str(tmp_path / "t")
    newest = lambda df: df.groupBy("k").agg(F.max_by("v", "batch").alias("v"), F.max("batch").alias("batch"))
    schema = "k long, v long, batch long"
    add = lambda n: feeds._add_batch(spark.createDataFrame([(n % 4, n * 10, n)], schema), n, path, newest)
    for n in range(20):
        add(n)
        if n in (2, 8, 9):  # the stream stops before it has noted the batch, and repeats it
            add(n)
        want = {k: max(i * 10 for i in range(n + 1) if i % 4 == k) for k in range(min(4, n + 1))}
        assert {r["k"]: r["v"] for r in feeds._read_merged(spark, path, newest, schema).collect()} == want
    tables = feeds._complete_tables(spark, path)
    assert (2, 0) in tables and (2, 9) in tables and (1, 18) not in tables and len(tables) <= 2 + 2 + 2 * 3
    assert feeds._read_merged(spark, str(tmp_path / "none"), newest, schema).count() == 0


class _State:
    """The state of one bucket, without Spark."""

    exists, hasTimedOut, get, watermark, timeout = False, False, None, 0, None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.timeout = at

    def remove(self):
        self.exists, self.get = False, None


def test_sessions_of_a_bucket_share_a_state():
    state = _State()
    rows = lambda *r: iter([pd.DataFrame(r, columns=["session_id", "seq", "id", "type", "at"])])
    call = lambda new: sorted((r.session_id, r.src, r.dst, r.delta) for pdf in feeds._edge_changes(("g", 7), new, state) for r in pdf.itertuples())
    assert call(rows(("x", 0, 0, "a", 0), ("y", 0, 1, "a", 5), ("x", 2, 2, "c", 9))) == [("x", "a", "c", 1)]
    assert call(rows(("x", 1, 3, "b", 7), ("y", 1, 4, "b", 8))) == [("x", "a", "b", 1), ("x", "a", "c", -1), ("x", "b", "c", 1), ("y", "a", "b", 1)]
    state.watermark = feeds.IDLE_MS + 8  # y is over, x is not
    assert state.timeout == state.watermark
    state.hasTimedOut = True
    assert call(iter([])) == [] and set(state.get[0]) == {"x"} and state.timeout == feeds.IDLE_MS + 9
    state.hasTimedOut = False
    assert call(rows(("y", 2, 5, "c", state.watermark))) == [] and set(state.get[0]) == {"x", "y"}
    state.watermark, state.hasTimedOut = 3 * feeds.IDLE_MS, True
    assert call(iter([])) == [] and not state.exists
