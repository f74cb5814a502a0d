"""Ingest, export, import and log-profile queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from playtrace.functions import scalars as s
from playtrace.functions.scalars import round_half_up
from playtrace.operators import imports, profile, sequences
from playtrace.operators.scope import Scope
from playtrace.plans import tables as t
from playtrace.plans.registry import clock, query, r, with_
from playtrace.session import shared_dir
from playtrace.sources import exports, logs, submissions

NOW = "2024-02-01 00:00:00"
ISO = "strftime(make_timestamp(t_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
MAPPING = {
    "session": "Case ID", "activity": "Activity", "timestamp": "Timestamp", "actor": "Student",
    "seq": "Order", "score": "Score", "stars": None, "level": "Activity",
}

# ---- exports and feeds ---------------------------------------------------------------------

EXPORT_SCOPE = "created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-22'"


@query(
    "export_events",
    with_("ev", "pl") + f"""SELECT ev.id, {clock('ev.created_at')} AS created_at, {ISO} AS iso, username, game_id, session_id, seq, type, t_ms, payload
    FROM ev JOIN pl ON pl.id = player_id WHERE ev.{EXPORT_SCOPE.replace('AND created_at', 'AND ev.created_at')} AND type = 'purchase'""",
)
def export_events(spark, d):
    return exports.export_events(t.log(spark, d), t.players(spark, d), Scope("2024-01-08", "2024-01-21", type="purchase"))


@query(
    "export_runs",
    with_("ev", "runs", "pl") + f"""SELECT runs.id, {clock('runs.created_at')} AS created_at, username, game_id, level, score, stars, session_id
    FROM runs JOIN pl ON pl.id = player_id""",
)
def export_runs(spark, d):
    return exports.export_runs(t.runs(spark, d), t.players(spark, d)).drop("meta")


def _feed(where: str, start: int, stop: int) -> str:
    return with_("ev", "pl") + f"""SELECT game_id, rank, f.id, username, session_id, seq, type, t_ms, {ISO} AS iso, {clock('f.created_at')} AS created_at, payload, total FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY game_id ORDER BY id DESC) AS INTEGER) AS rank, count(*) OVER (PARTITION BY game_id) AS total
      FROM ev WHERE {where}) f JOIN pl ON pl.id = player_id WHERE rank > {start} AND rank <= {stop}"""


@query("event_feed", _feed("type = 'click'", 200, 300))
def event_feed(spark, d):
    return exports.feed(t.log(spark, d), t.players(spark, d), type="click", limit=100, offset=200)


@query("live_feed", _feed("id > 500 AND player_id = 3", 0, 100))
def live_feed(spark, d):
    return exports.feed(t.log(spark, d), t.players(spark, d), since=500, username="Player_3")


@query("existing_event_count", with_("ev") + "SELECT game_id, count(*) AS events FROM ev GROUP BY 1")
def existing_event_count(spark, d):
    return exports.existing_events(t.events(spark, d))


# ---- submissions ---------------------------------------------------------------------------


@query(
    "ingest_events",
    with_("ev") + f"SELECT game_id, player_id, session_id, CAST(seq AS INTEGER) AS seq, type, t_ms, {ISO} AS iso FROM ev",
)
def ingest_events(spark, d):
    """The log sent as client batches of at most 1000 events and read back."""
    one = F.to_json(F.struct("seq", "type", F.col("t_ms").alias("t"), s.iso_ms("t_ms").alias("iso"), "session_id"))
    batch = (
        t.log(spark, d)
        .groupBy("game_id", "player_id", "session_id", F.floor(F.col("seq") / 1000).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", one.alias("e")))).alias("es"))
    )
    events = F.concat(F.lit("["), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]"))
    body = F.concat(F.lit('{"session_id":"'), F.col("session_id"), F.lit('","events":'), events, F.lit("}"))
    return submissions.event_rows(batch.select("game_id", "player_id", body.alias("body"))).drop("payload")


@query("ingest_large_submissions", with_("ev") + "SELECT CAST(id // 6000 AS BIGINT) AS batch, count(*) AS events, count(DISTINCT seq) AS seqs, CAST(sum(t_ms) AS BIGINT) AS clock FROM ev GROUP BY 1")
def ingest_large_submissions(spark, d):
    """6000 events in one submission."""
    one = F.to_json(F.struct("seq", "type", F.col("t_ms").alias("t"), F.col("session_id").alias("sessionId")))
    batch = t.log(spark, d).groupBy(F.floor(F.col("id") / 6000).alias("player_id")).agg(F.collect_list(one).alias("es"))
    body = F.concat(F.lit('{"events":['), F.array_join("es", ","), F.lit("]}"))
    stored = submissions.event_rows(batch.select(F.lit("g").alias("game_id"), "player_id", body.alias("body")))
    return stored.groupBy(F.col("player_id").alias("batch")).agg(F.count("*").alias("events"), F.count_distinct("seq").alias("seqs"), F.sum("t_ms").alias("clock"))


DATE_FORMATS = ("M/d/yyyy h:mm a", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "MMMM d, yyyy", "MMM d, yyyy h:mm a", "dd-MMM-yyyy", "yyyy/M/d HH:mm")
UNITS = ("minute", "second", "day", "minute", "day", "minute")


@query(
    "date_texts",
    with_("ev") + "SELECT id, CASE id % 6 " + " ".join(f"WHEN {i} THEN epoch_ms(date_trunc('{u}', created_at))" for i, u in enumerate(UNITS)) + " END AS ms FROM ev",
)
def date_texts(spark, d):
    """Times as spreadsheets and mail write them, read back."""
    text = F.element_at(F.array(*[F.date_format("created_at", f) for f in DATE_FORMATS]), (F.col("id") % 6 + 1).cast("int"))
    return t.events(spark, d).select("id", s.epoch_ms(text).alias("ms"))


@query(
    "ingest_runs",
    with_("ev", "runs") + """SELECT game_id, player_id, level, CASE WHEN id % 11 = 0 THEN 0 ELSE score END AS score,
      CASE WHEN id % 5 = 0 THEN NULL ELSE stars END AS stars, session_id FROM runs""",
)
def ingest_runs(spark, d):
    """Runs sent as JSON, some with a score that is no number or without stars."""
    score = F.when(F.col("id") % 11 == 0, F.lit("oops")).otherwise(F.col("score").cast("string"))
    stars = F.when(F.col("id") % 5 != 0, F.col("stars"))
    body = F.to_json(F.struct("level", score.alias("score"), stars.alias("stars"), "session_id", F.struct("level").alias("meta")))
    return submissions.run_rows(t.runs(spark, d).select("game_id", "player_id", body.alias("body"))).drop("meta")


# ---- log files -----------------------------------------------------------------------------

RAW = with_("ev") + """, raw AS (SELECT id AS _row, CASE WHEN id % 41 = 0 THEN '' ELSE session_id END AS "Case ID",
    CASE WHEN id % 50 = 0 THEN ' ' ELSE type END AS "Activity",
    CASE WHEN id % 37 = 0 THEN 'n/a' WHEN id % 3 = 0 THEN CAST(t_ms AS VARCHAR) ELSE """ + ISO + """ END AS "Timestamp",
    CASE WHEN id % 43 = 0 THEN '' ELSE 'Student ' || player_id END AS "Student", CAST(seq AS VARCHAR) AS "Order",
    CASE WHEN id % 11 = 0 THEN 'oops' WHEN id % 7 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS "Score", t_ms, value, seq, player_id FROM ev) """
RAW_COLUMNS = '"Case ID", "Activity", "Timestamp", "Student", "Order", "Score"'


def _fresh(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("csv_log_round_trip", RAW + f"SELECT {RAW_COLUMNS} FROM raw")
def csv_log_round_trip(spark, d):
    path = _fresh(spark)
    exports.write_csv(t.raw_log(spark, d).drop("_row"), path)
    return logs.read_log(spark, path).drop("_row")


@query("json_log_round_trip", RAW + f"SELECT {RAW_COLUMNS} FROM raw")
def json_log_round_trip(spark, d):
    path = _fresh(spark) + ".json"
    exports.write_json(t.raw_log(spark, d).drop("_row"), path)
    return logs.read_log(spark, path).drop("_row")


UNPIVOT = RAW + """, cells AS (SELECT _row, "column", trim(v) AS v FROM (UNPIVOT (SELECT _row, """ + RAW_COLUMNS + """ FROM raw) ON """ + RAW_COLUMNS + """ INTO NAME "column" VALUE v)),
    flags AS (SELECT *, regexp_full_match(v, '-?\\d+(\\.\\d+)?') AS is_number,
      regexp_full_match(v, '\\d+(\\.\\d+)?') OR (v LIKE '20%T%Z') AS is_date FROM cells) """


@query(
    "column_profile",
    UNPIVOT + f"""SELECT "column", count(*) AS rows, {r("(count(*) FILTER (WHERE v <> ''))::DOUBLE / count(*)", 6)} AS fill,
      count(DISTINCT v) FILTER (WHERE v <> '') AS distinct, {r("(count(DISTINCT v) FILTER (WHERE v <> ''))::DOUBLE / (count(*) FILTER (WHERE v <> ''))", 6)} AS distinct_ratio,
      {r("(count(*) FILTER (WHERE is_number))::DOUBLE / (count(*) FILTER (WHERE v <> ''))", 6)} AS numeric_rate,
      {r("(count(*) FILTER (WHERE is_date))::DOUBLE / (count(*) FILTER (WHERE v <> ''))", 6)} AS ts_parse_rate,
      CASE WHEN bool_and(is_number OR v = '') THEN 'number' ELSE 'text' END AS type FROM flags GROUP BY 1""",
)
def column_profile(spark, d):
    p = profile.columns(profile.values(t.raw_log(spark, d)))
    return p.withColumns({c: round_half_up(c, 6) for c in ("fill", "distinct_ratio", "numeric_rate", "ts_parse_rate")})


@query(
    "column_samples",
    UNPIVOT + """SELECT "column", rank, v FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY first_at) AS INTEGER) AS rank
      FROM (SELECT "column", v, min(_row) AS first_at FROM cells WHERE v <> '' GROUP BY ALL)) WHERE rank <= 3""",
)
def column_samples(spark, d):
    return profile.sample_values(profile.values(t.raw_log(spark, d)))


@query("mapping_readiness", UNPIVOT + """SELECT 'ok' AS level, 'outcome' AS role, 'outcome mapped' AS finding FROM flags WHERE "column" = 'Score' HAVING count(*) FILTER (WHERE is_number) * 2 >= count(*) FILTER (WHERE v <> '')""")
def mapping_readiness(spark, d):
    return profile.readiness(profile.columns(profile.values(t.raw_log(spark, d))), MAPPING)


@query("mapping_verdict", UNPIVOT + "SELECT CASE WHEN count(*) > 0 THEN 'ok' ELSE 'blocked' END AS level FROM flags")
def mapping_verdict(spark, d):
    return profile.verdict(mapping_readiness(spark, d))


@query(
    "log_pre_check",
    RAW + """SELECT 'Case ID' AS session, 'Activity' AS activity, 'Timestamp' AS timestamp, 'Student' AS actor, 'Order' AS seq, 'Score' AS score,
      count(*) AS rows, false AS own_export FROM raw""",
)
def log_pre_check(spark, d):
    facts, _, _ = profile.pre_check(t.raw_log(spark, d))
    roles = {k: F.lit(facts["mapping"][k]) for k in ("session", "activity", "timestamp", "actor", "seq", "score")}
    return t.raw_log(spark, d).agg(F.count("*").alias("rows")).withColumns(roles).withColumn("own_export", F.lit(facts["own_export"]))


# ---- import --------------------------------------------------------------------------------

IMPORT = RAW + f""", had AS (SELECT user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'STUDENT_' ELSE 'player_' END || user_id AS username FROM events GROUP BY user_id),
    it AS (SELECT CASE WHEN "Case ID" = '' THEN 'session-1' ELSE "Case ID" END AS session_id, CASE WHEN "Student" = '' THEN 'anon' ELSE 'Student_' || player_id END AS actor,
      "Activity" AS type, CASE WHEN "Timestamp" = 'n/a' THEN NULL ELSE t_ms END AS ms, seq AS hint, CASE WHEN "Score" IN ('', 'oops') THEN NULL ELSE value END AS score, _row
      FROM raw WHERE trim("Activity") <> ''),
    od AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hint, ms NULLS LAST, _row) - 1 AS seq FROM it),
    se AS (SELECT session_id, arg_min(actor, seq) AS actor, arg_min(ms, seq) FILTER (WHERE ms IS NOT NULL) AS start_ms, min(_row) AS first_at,
      arg_max(score, seq) FILTER (WHERE score IS NOT NULL) AS score, arg_max(type, seq) AS level FROM od GROUP BY 1),
    ac AS (SELECT lower(actor) AS key, arg_min(actor, first_at) AS username, min(first_at) AS first_at FROM se GROUP BY 1),
    ids AS (SELECT key, had.id AS player_id FROM ac JOIN had ON lower(had.username) = key
      UNION ALL SELECT key, (SELECT max(id) FROM had) + row_number() OVER (ORDER BY first_at) FROM ac WHERE key NOT IN (SELECT lower(username) FROM had)),
    ow AS (SELECT se.*, player_id FROM se JOIN ids ON ids.key = lower(se.actor)) """
AT = "coalesce(strftime(make_timestamp({} * 1000), '%Y-%m-%d %H:%M:%S'), '" + NOW + "')"


def _existing(spark, d):
    name = F.when(F.col("id") % 2 == 0, "STUDENT_").otherwise("player_")
    return t.players(spark, d).withColumn("username", F.concat(name, F.col("id").cast("string")))


def _import(spark, d, import_id=1):
    return imports.commit(t.raw_log(spark, d), _existing(spark, d), "my-study", MAPPING, import_id, NOW, filename="study.csv")


@query(
    "import_events",
    IMPORT + f"""SELECT player_id, 'my-study' AS game_id, 1 AS import_id, session_id, seq, type, coalesce(ms, seq * 1000) AS t_ms, {AT.format('ms')} AS created_at
    FROM od JOIN ow USING (session_id)""".replace("SELECT player_id,", "SELECT ow.player_id,").replace("session_id, seq, type", "session_id, od.seq, od.type").replace("coalesce(ms, seq", "coalesce(ms, od.seq"),
)
def import_events(spark, d):
    return _import(spark, d).events.drop("payload", "iso")


@query(
    "import_runs",
    IMPORT + f"""SELECT player_id, 'my-study' AS game_id, 1 AS import_id, level, coalesce(score, 0) AS score, session_id, {AT.format('start_ms')} AS created_at FROM ow""",
)
def import_runs(spark, d):
    return _import(spark, d).runs.drop("meta", "stars")


@query("import_new_players", IMPORT + "SELECT player_id AS id, username FROM ids JOIN ac USING (key) WHERE key NOT IN (SELECT lower(username) FROM had)")
def import_new_players(spark, d):
    return _import(spark, d).new_players.select("id", "username")


@query(
    "import_summary",
    IMPORT + """SELECT (SELECT count(*) FROM raw) AS rows, count(*) AS events, (SELECT count(*) FROM se) AS sessions, (SELECT count(*) FROM se) AS runs,
      (SELECT count(*) FROM ac WHERE key NOT IN (SELECT lower(username) FROM had)) AS players_created, count(DISTINCT type) AS activities,
      count(*) FILTER (WHERE ms IS NULL) AS unparsed_timestamps, strftime(make_timestamp(min(ms) * 1000), '%Y-%m-%d %H:%M:%S') AS date_from,
      strftime(make_timestamp(max(ms) * 1000), '%Y-%m-%d %H:%M:%S') AS date_to FROM od""",
)
def import_summary(spark, d):
    reg = _import(spark, d).registry
    return reg.select("rows", "events", "sessions", "runs", "players_created", "activities", "unparsed_timestamps", "date_from", "date_to")


@query("import_batches", IMPORT + "SELECT i AS id, 'my-study' AS game_id, count(*) AS events FROM od CROSS JOIN range(1, 3) x(i) GROUP BY i")
def import_batches(spark, d):
    registry = _import(spark, d, 1).registry.unionByName(_import(spark, d, 2).registry)
    return imports.list_batches(registry, "my-study").select("id", "game_id", "events")


def _stored(spark, d):
    """The native tables with one imported batch appended."""
    batch = _import(spark, d)
    none = F.lit(None).cast("long").alias("import_id")
    cols = ["player_id", "game_id", "session_id", "seq", "type", "t_ms"]
    events = t.log(spark, d).select(*cols, none).unionByName(batch.events.select(*cols, "import_id"))
    run_cols = ["player_id", "game_id", "session_id", "score"]
    runs = t.runs(spark, d).select(*run_cols, none).unionByName(batch.runs.select(*run_cols, "import_id"))
    players = _existing(spark, d).select("id", "username").unionByName(batch.new_players.select("id", "username"))
    return imports.delete_batch(events, runs, players, batch.registry, 1)


@query(
    "import_delete_report",
    IMPORT + """SELECT 1 AS id, (SELECT count(*) FROM od) AS events, (SELECT count(*) FROM se) AS runs,
      (SELECT count(*) FROM ids WHERE player_id NOT IN (SELECT id FROM had)) AS players_removed""",
)
def import_delete_report(spark, d):
    return _stored(spark, d).report


@query("import_delete_remaining", IMPORT + """SELECT game_id, count(*) AS events, (SELECT count(*) FROM had) AS players FROM ev GROUP BY 1""")
def import_delete_remaining(spark, d):
    left = _stored(spark, d)
    return left.events.groupBy("game_id").agg(F.count("*").alias("events")).join(F.broadcast(left.players.agg(F.count("*").alias("players"))))


# ---- scalar functions over whole columns ---------------------------------------------------


@query(
    "scalar_functions",
    with_("ev", "pl") + f"""SELECT ev.id, {r('value', 1)} AS rounded, CAST(floor(value + 0.5) AS BIGINT) AS whole,
      CASE WHEN id % 7 = 0 THEN 0 ELSE value END AS number_or, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%d %H:%M:%S') AS at,
      {r('1 / (1 + exp(-value))', 6)} AS squashed, {r('ln((k / 100.0 + 1e-6) / (1 - k / 100.0 + 1e-6))', 6)} AS odds,
      upper(type[1]) || type[2:] || ' G' || game_id[2:] AS title, k AS k, 'Player_' || player_id AS safe, game_id || '-' || type AS slug, true AS slug_ok
    FROM (SELECT *, CAST(json_extract_string(payload, '$.k') AS INTEGER) AS k FROM ev) ev""",
)
def scalar_functions(spark, d):
    k = F.get_json_object("payload", "$.k").cast("int")
    text = F.when(F.col("id") % 7 == 0, "x1").otherwise(F.col("value").cast("string"))
    slug = s.slug_from_filename(F.concat(F.lit("__"), "game_id", F.lit("  "), F.upper("type"), F.lit("!.csv")))
    return t.log(spark, d).select(
        "id",
        round_half_up("value", 1).alias("rounded"),
        s.js_round("value").alias("whole"),
        s.number_or(text, 0).alias("number_or"),
        s.sql_time("t_ms").alias("at"),
        round_half_up(s.sigmoid("value"), 6).alias("squashed"),
        round_half_up(s.log_odds(k / F.lit(100.0)), 6).alias("odds"),
        s.title_case(F.concat("type", F.lit("__"), "game_id")).alias("title"),
        k.alias("k"),
        s.safe_name(F.concat(F.lit(" _Player "), F.col("player_id").cast("string"), F.lit("!"))).alias("safe"),
        slug.alias("slug"),
        s.is_slug(slug).alias("slug_ok"),
    )


@query(
    "day_and_hour",
    with_("ev") + """SELECT CAST(hour(created_at) AS INTEGER) AS hour, strftime(created_at, '%Y-%m-%d') AS day,
      CAST(date_diff('day', DATE '2024-01-01', CAST(created_at AS DATE)) AS INTEGER) AS days, count(*) AS events FROM ev GROUP BY ALL""",
)
def day_and_hour(spark, d):
    day = F.to_date("created_at")
    return t.events(spark, d).groupBy(
        F.hour("created_at").alias("hour"),
        F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        F.date_diff(day, F.lit("2024-01-01").cast("date")).alias("days"),
    ).agg(F.count("*").alias("events"))


@query(
    "clipped_paths",
    with_("ev", "paths") + "SELECT game_id, session_id, array_to_string(str_split(path, ' > ')[1:60], ' > ') AS clipped, str_split(path, ' > ')[1] AS head, length FROM paths",
)
def clipped_paths(spark, d):
    return sequences.clipped(t.steps(spark, d))


@query(
    "clipped_user_paths",
    """WITH u AS (SELECT user_id AS session_id, event_type AS type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
    SELECT 'all' AS game_id, CAST(session_id AS VARCHAR) AS session_id, string_agg(type, ' > ' ORDER BY pos) FILTER (WHERE pos <= 60) AS clipped, arg_min(type, pos) AS head, count(*) AS length FROM u GROUP BY ALL""",
)
def clipped_user_paths(spark, d):
    """A player's whole log as one session, longer than the clip."""
    whole = t.events(spark, d).withColumns({"game_id": F.lit("all"), "session_id": F.col("player_id").cast("string"), "seq": F.unix_micros(F.col("created_at").cast("timestamp"))})
    return sequences.clipped(sequences.steps(whole))
