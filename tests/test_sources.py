import json

import pytest
from pyspark.sql import functions as F

from playtrace.operators import imports, profile
from playtrace.operators.scope import Scope
from playtrace.sources import exports, logs, submissions

NOW = "2024-02-01 00:00:00"
MAPPING = {"session": "case", "activity": "act", "timestamp": "at", "actor": "who", "seq": None, "score": "points", "stars": "stars", "level": "lvl"}


def _write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def _rows(df):
    return [tuple(r[c] for c in logs.headers(df)) for r in df.orderBy(logs.ROW).collect()]


def test_csv_quotes_breaks_and_short_rows(spark, tmp_path):
    path = _write(tmp_path, "log.csv", '﻿case,act , note\r\n1,"a,b","say ""hi"""\r\n\r\n2,"two\nlines"\r\n3,c, x ,extra\r\n')
    df = logs.read_log(spark, path, multiline=True)
    assert logs.headers(df) == ["case", "act", "note"]
    assert _rows(df) == [("1", "a,b", 'say "hi"'), ("2", "two\nlines", ""), ("3", "c", " x ")]


@pytest.mark.parametrize("shape", ["array", "events", "rows", "lines", "wrapped", "spread"])
def test_json_shapes(spark, tmp_path, shape):
    objects = [{"session_id": "s", "type": "a", "n": 1, "more": {"k": [1]}}, {"session_id": "s", "type": "b", "seq": 2}]
    text = {"array": json.dumps(objects), "lines": "\n".join(map(json.dumps, objects)), "wrapped": json.dumps({"exported": "2024 \"n\"", "events": objects}), "spread": json.dumps({"exported": "2024", "rows": objects}, indent=1)}.get(shape) or json.dumps({shape: objects})
    df = logs.read_log(spark, _write(tmp_path, "log.json", text))
    assert logs.headers(df) == ["session_id", "type", "n", "more", "seq"]
    assert _rows(df) == [("s", "a", "1", '{"k":["1"]}', None), ("s", "b", None, None, "2")]


def test_format_by_name_or_first_character(spark, tmp_path):
    assert logs.log_format(spark, _write(tmp_path, "a.txt", ' [{"a":1}]')) == "json"
    assert logs.log_format(spark, _write(tmp_path, "b.txt", "a,b\n1,2")) == "csv"
    assert logs.log_format(spark, _write(tmp_path, "c.JSON", "x")) == "json"


def test_roles_are_guessed_once_per_column():
    m = logs.guess_mapping(["Case ID", "Activity", "Complete Timestamp", "org:resource", "Order", "Points", "Rating", "Level"])
    assert m == dict(zip(logs.ROLES, ["Case ID", "Activity", "Complete Timestamp", "org:resource", "Order", "Points", "Rating", "Level"]))
    own = logs.guess_mapping(exports.EVENT_COLUMNS)
    assert (own["session"], own["activity"], own["seq"]) == ("session_id", "type", "seq") and logs.is_own_export(exports.EVENT_COLUMNS)
    assert not logs.is_own_export(["case", "type"])


def _raw(spark, rows):
    cols = ["case", "act", "at", "who", "points", "stars", "lvl"]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in cols) + ", _row long")


def _players(spark):
    return spark.createDataFrame([(5, "ANN"), (9, "zoe")], "id long, username string")


def test_import_orders_folds_and_assigns(spark):
    raw = _raw(spark, [
        ("s1", "late", "2024-01-02", "ann", "7", "", "2"),
        ("s1", "early", "2024-01-01T00:00:00Z", "bob b", "x", "2.5", ""),
        ("", "lost", "bad", "", "", "", ""),
        ("s1", "  ", "2024-01-03", "ann", "9", "9", "9"),
        ("s2", "one", "1704067200", "BOB_B", "", "", " top "),
    ])
    b = imports.commit(raw, _players(spark), "my-study", MAPPING, 3, NOW)
    ev = [(r["session_id"], r["seq"], r["type"], r["player_id"], r["created_at"]) for r in b.events.orderBy("session_id", "seq").collect()]
    bob = 10
    assert ev == [
        ("s1", 0, "early", bob, "2024-01-01 00:00:00"),
        ("s1", 1, "late", bob, "2024-01-02 00:00:00"),
        ("s2", 0, "one", bob, "2024-01-01 00:00:00"),
        ("session-1", 0, "lost", 11, NOW),
    ]
    runs = {r["session_id"]: (r["score"], r["stars"], r["level"]) for r in b.runs.collect()}
    assert runs == {"s1": (7.0, 3, "2"), "s2": (0.0, None, "top"), "session-1": (0.0, None, None)}
    assert sorted((r["id"], r["username"]) for r in b.new_players.collect()) == [(10, "bob_b"), (11, "anon")]
    reg = b.registry.first()
    assert (reg["rows"], reg["events"], reg["sessions"], reg["players_created"], reg["activities"], reg["unparsed_timestamps"]) == (5, 4, 3, 2, 4, 1)
    assert b.settings == {"actor_mode": "column", "has_outcome": True}


def test_actor_modes(spark):
    raw = _raw(spark, [("s 1", "a", "", "x", "", "", "")])
    name = lambda mode: imports.items(raw, MAPPING, mode).first()["actor"]
    assert (name("single"), name("column"), name("session")) == ("imported", "x", "case-s_1")


def test_explicit_order_beats_time(spark):
    raw = spark.createDataFrame([("s", "b", "2", 0), ("s", "c", "x", 1), ("s", "a", None, 2)], "case string, act string, nr string, _row long")
    rows = imports.in_order(imports.items(raw, {"session": "case", "activity": "act", "seq": "nr"})).orderBy("seq").collect()
    assert [r["type"] for r in rows] == ["a", "b", "c"]  # missing counts as 0, unreadable goes last


def test_bad_requests():
    for game, mapping in (("Bad Slug", MAPPING), ("admin", MAPPING), ("ok", {})):
        with pytest.raises(logs.ImportProblem):
            imports.check_request(game, mapping)


def test_delete_removes_the_batch_and_its_orphans(spark):
    ev = spark.createDataFrame([(1, None), (1, 4), (2, 4), (3, 5)], "player_id long, import_id long")
    runs = spark.createDataFrame([(2, 5), (4, 4)], "player_id long, import_id long")
    pl = spark.createDataFrame([(i, f"p{i}") for i in range(1, 7)], "id long, username string")
    reg = spark.createDataFrame([(4, "g"), (5, "g")], "id long, game_id string")
    left = imports.delete_batch(ev, runs, pl, reg, 4)
    assert left.report.first().asDict() == {"id": 4, "events": 2, "runs": 1, "players_removed": 1}
    assert sorted(r["id"] for r in left.players.collect()) == [1, 2, 3, 5, 6]
    assert left.events.count() == 2 and left.runs.count() == 1 and [r["id"] for r in left.registry.collect()] == [5]


def test_export_reads_back_as_an_import(spark, tmp_path):
    ev = spark.createDataFrame(
        [(1, 5, "g", "s", 0, "a", 1704067200000, '{"q":"x,\\"y\\""}'), (2, 9, "g", "s", 1, "b", 1704067201000, None)],
        "id long, player_id long, game_id string, session_id string, seq int, type string, t_ms long, payload string",
    ).withColumn("created_at", F.timestamp_millis("t_ms").cast("timestamp_ntz"))
    out = exports.export_events(ev, _players(spark))
    for write, path in ((exports.write_csv, str(tmp_path / "out")), (exports.write_json, str(tmp_path / "out.json"))):
        write(out, path)
        raw = logs.read_log(spark, path)
        mapping = logs.guess_mapping(logs.headers(raw))
        again = imports.commit(raw, _players(spark), "copy", mapping, 1, NOW).events.orderBy("seq").collect()
        assert [(r["session_id"], r["seq"], r["type"], r["t_ms"]) for r in again] == [("s", 0, "a", 1704067200000), ("s", 1, "b", 1704067201000)]


def test_feed_pages_newest_first(spark):
    ev = spark.range(30).select("id", F.lit(5).cast("long").alias("player_id"), F.lit("g").alias("game_id"), F.lit("s").alias("session_id"), F.col("id").alias("seq"), F.lit("a").alias("type"), F.col("id").alias("t_ms"), F.lit(None).cast("string").alias("payload"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    page = exports.feed(ev, _players(spark), limit=5, offset=10).orderBy("rank").collect()
    assert [r["id"] for r in page] == [19, 18, 17, 16, 15] and page[0]["total"] == 30
    assert exports.feed(ev, _players(spark), since=27).count() == 2 and exports.feed(ev, _players(spark), username="ZOE").count() == 0
    assert exports.export_events(ev, _players(spark), Scope(users=("ann",))).count() == 30


def test_submissions(spark):
    events = [{"seq": i, "type": "t", "t": i + 0.5, "iso": "z", "sessionId": "own"} for i in range(4)]
    body = json.dumps({"events": events})
    df = spark.createDataFrame([("g", 1, body), ("g", 2, json.dumps({"session_id": "batch", "events": events})), ("g", 3, "{}")], "game_id string, player_id long, body string")
    rows = submissions.event_rows(df, last=3).orderBy("player_id", "seq").collect()
    assert [(r["player_id"], r["session_id"], r["seq"], r["t_ms"]) for r in rows] == [(p, s, i, i + 1) for p, s in ((1, "own"), (2, "batch")) for i in (1, 2, 3)]
    assert json.loads(rows[0]["payload"]) == events[1]
    run = submissions.run_rows(spark.createDataFrame([("g", 1, '{"level":3,"score":"no","stars":2.5,"meta":{"a":1}}')], "game_id string, player_id long, body string")).first()
    assert (run["level"], run["score"], run["stars"], run["session_id"], run["meta"]) == ("3", 0.0, 3, None, '{"a":1}')


def test_readiness_findings(spark):
    raw = _raw(spark, [(f"s{i}", "same", "x", "w", "1", "", "") for i in range(30)])
    p = profile.columns(profile.values(raw))
    found = {(r["role"], r["level"]) for r in profile.readiness(p, MAPPING).collect()}
    assert found == {("activity", "warn"), ("session", "warn"), ("timestamp", "warn"), ("outcome", "ok")}
    none = profile.readiness(p, {"activity": None})
    assert profile.verdict(none).first()["level"] == "blocked"
    kinds = {r["column"]: r["type"] for r in p.collect()}
    assert kinds["points"] == "number" and kinds["stars"] == "empty" and kinds["case"] == "text"
    facts, _, sample = profile.pre_check(raw)
    assert facts["warnings"] and sample.count() == 8


@pytest.mark.parametrize("offset,limit", [(0, 3), (40, 20), (110, 100), (10**9, 5)])
def test_a_page_is_cut_from_few_ranges_of_ids(spark, monkeypatch, offset, limit):
    """Crowded and empty stretches of ids, games of very unequal size, an event of an unknown player."""
    monkeypatch.setattr(exports, "PAGE_ROWS", 8)
    monkeypatch.setattr(exports, "RANGES", 4)
    ids = {"a": [*range(60), *range(10_000, 10_050), 2**40], "b": [5, 2**33], "c": [7]}
    rows = [(i, 9 if g == "c" else 1, g, "s", 0, "t", 1000, "{}", None) for g, own in ids.items() for i in own]
    events = spark.createDataFrame(rows, "id long, player_id long, game_id string, session_id string, seq int, type string, t_ms long, payload string, created_at timestamp_ntz")
    players = spark.createDataFrame([(1, "ann")], "id long, username string")
    got = [(r["game_id"], r["rank"], r["id"], r["total"]) for r in exports.feed(events, players, limit=limit, offset=offset).collect()]
    want = [(g, k, i, len(own)) for g, own in ids.items() if g != "c" for k, i in enumerate(sorted(own, reverse=True), 1) if offset < k <= offset + limit]
    assert sorted(got) == want
    if offset == 40:  # the ranges that are ordered hold little more than the page
        spans, _, _ = exports._spans(events.select("game_id", "id"), 40, 46)
        assert [r["game_id"] for r in spans.collect()] == ["a"] and spans.first()["events"] < 40


def test_a_page_of_no_events(spark):
    events = spark.createDataFrame([], "id long, player_id long, game_id string, session_id string, seq int, type string, t_ms long, payload string, created_at timestamp_ntz")
    assert exports.feed(events, spark.createDataFrame([(1, "ann")], "id long, username string")).isEmpty()
