"""Scans, filters, engagement and ranking queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from playtrace.functions.scalars import clock as clock_of
from playtrace.operators import engagement as g
from playtrace.operators import ordered
from playtrace.operators.scope import Scope, in_scope, user_list
from playtrace.plans import tables as t
from playtrace.plans.registry import clock, query, r, with_

SCOPE = Scope("2024-01-08", "2024-01-21", ("player_3", "PLAYER_7", "player_11", "player_12"))
SCOPE_SQL = "created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-22'"
USERS_SQL = "player_id IN (SELECT id FROM pl WHERE lower(username) IN ('player_3','player_7','player_11','player_12'))"
EVENT_COLS = ["game_id", "id", "player_id", "session_id", "seq", "type", "t_ms", "payload"]


@query("scan_events", with_("ev") + f"SELECT {', '.join(EVENT_COLS)}, {clock('created_at')} AS created_at FROM ev")
def scan_events(spark, d):
    return t.log(spark, d).select(*EVENT_COLS, clock_of("created_at").alias("created_at"))


@query("scan_runs", with_("ev", "runs") + f"SELECT game_id, session_id, player_id, id, level, score, stars, {clock('created_at')} AS created_at FROM runs")
def scan_runs(spark, d):
    return t.runs(spark, d).drop("meta").withColumn("created_at", clock_of("created_at"))


@query("scan_players", with_("pl") + f"SELECT id, username, {clock('created_at')} AS created_at, {clock('last_seen_at')} AS last_seen_at FROM pl")
def scan_players(spark, d):
    return t.players(spark, d).withColumns({c: clock_of(c) for c in ("created_at", "last_seen_at")})


@query(
    "events_in_scope",
    with_("ev", "pl") + f"SELECT game_id, id, session_id, type FROM ev WHERE {SCOPE_SQL} AND {USERS_SQL} AND type = 'click'",
)
def events_in_scope(spark, d):
    scope = Scope(SCOPE.start, SCOPE.end, SCOPE.users, "click")
    return in_scope(t.events(spark, d), scope, t.players(spark, d)).select("game_id", "id", "session_id", "type")


@query(
    "users_from_list",
    with_("ev", "pl") + "SELECT username, count(*) AS events FROM ev JOIN pl ON pl.id = ev.player_id "
    "WHERE lower(username) IN ('player_5', 'player_6', 'player_14') GROUP BY ALL",
)
def users_from_list(spark, d):
    names = user_list(["player_5, PLAYER_6", "Player_5", " player_14,"])
    ev = in_scope(t.events(spark, d), Scope(users=tuple(names)), t.players(spark, d))
    who = t.players(spark, d).select(F.col("id").alias("player_id"), "username")
    return ev.join(who, "player_id").groupBy("username").agg(F.count("*").alias("events"))


NAMES = ", ".join(f"'player_{i}'" for i in range(60))


@query("users_from_long_list", with_("ev", "pl") + f"SELECT username, count(*) AS events FROM ev JOIN pl ON pl.id = ev.player_id WHERE username IN ({NAMES}) GROUP BY ALL")
def users_from_long_list(spark, d):
    names = user_list(",".join(f" Player_{i}" for i in range(60)))
    ev = in_scope(t.events(spark, d), Scope(users=tuple(names)), t.players(spark, d))
    who = t.players(spark, d).select(F.col("id").alias("player_id"), "username")
    return ev.join(who, "player_id").groupBy("username").agg(F.count("*").alias("events"))


@query(
    "events_last_7_days",
    with_("ev") + "SELECT game_id, count(*) AS events FROM ev "
    "WHERE created_at >= TIMESTAMP '2024-01-23' AND created_at < TIMESTAMP '2024-01-31' GROUP BY ALL",
)
def events_last_7_days(spark, d):
    scope = Scope.last_days(7, dt.date(2024, 1, 30))
    return in_scope(t.events(spark, d), scope).groupBy("game_id").agg(F.count("*").alias("events"))


@query(
    "overview_games",
    with_("ev", "runs") + f"""SELECT e.game_id, events, players, sessions, runs,
      {clock('first_seen')} AS first_seen, {clock('last_seen')} AS last_seen, e.game_id = 'g0' AS has_specific
    FROM (SELECT game_id, count(*) AS events, count(DISTINCT player_id) AS players, count(DISTINCT session_id) AS sessions,
                 min(created_at) AS first_seen, max(created_at) AS last_seen FROM ev GROUP BY 1) e
    JOIN (SELECT game_id, count(*) AS runs FROM runs GROUP BY 1) r USING (game_id)""",
)
def overview_games(spark, d):
    return g.overview(t.events(spark, d), t.runs(spark, d), special=("g0",))


@query(
    "suite_totals",
    with_("ev", "runs", "pl") + """SELECT count(DISTINCT game_id) AS games, count(*) AS events,
      (SELECT count(*) FROM runs) AS runs, (SELECT count(*) FROM (SELECT DISTINCT game_id, session_id FROM ev)) AS sessions,
      (SELECT count(*) FROM pl) AS players FROM ev""",
)
def suite_totals(spark, d):
    return g.suite_totals(t.events(spark, d), t.runs(spark, d), t.players(spark, d))


@query(
    "summary_tiles",
    with_("ev", "runs", "sess") + f"""SELECT e.game_id, players, sessions, events, runs, {r('score')} AS avg_score, {r('stars', 2)} AS avg_stars,
      {r('minutes', 1)} AS avg_session_min, {r('events::DOUBLE / sessions', 1)} AS events_per_session,
      {r('sessions::DOUBLE / players', 1)} AS sessions_per_player, returning_players,
      {r('returning_players::DOUBLE / players', 3)} AS returning_rate
    FROM (SELECT game_id, count(*) AS events, count(DISTINCT player_id) AS players, count(DISTINCT session_id) AS sessions FROM ev GROUP BY 1) e
    JOIN (SELECT game_id, count(*) AS runs, avg(score) AS score, avg(stars) AS stars FROM runs GROUP BY 1) USING (game_id)
    JOIN (SELECT game_id, avg(minutes) AS minutes FROM sess GROUP BY 1) USING (game_id)
    JOIN (SELECT game_id, count(*) FILTER (WHERE n > 1) AS returning_players FROM
           (SELECT game_id, player_id, count(DISTINCT session_id) AS n FROM ev GROUP BY ALL) GROUP BY 1) USING (game_id)""",
)
def summary_tiles(spark, d):
    return g.tiles(t.events(spark, d), t.runs(spark, d))


@query(
    "summary_tiles_one_sided",
    with_("ev", "runs") + f"""SELECT game_id, coalesce(events, 0) AS events, coalesce(players, 0) AS players, coalesce(runs, 0) AS runs, {r('score')} AS avg_score
    FROM (SELECT game_id, count(*) AS events, count(DISTINCT player_id) AS players FROM ev WHERE game_id <> 'g1' GROUP BY 1)
    FULL JOIN (SELECT game_id, count(*) AS runs, avg(score) AS score FROM runs WHERE game_id <> 'g2' GROUP BY 1) USING (game_id)""",
)
def summary_tiles_one_sided(spark, d):
    """One game has runs only, another events only."""
    tiles = g.tiles(t.events(spark, d).where("game_id <> 'g1'"), t.runs(spark, d).where("game_id <> 'g2'"))
    return tiles.select("game_id", "events", "players", "runs", "avg_score")


@query(
    "summary_tiles_in_scope",
    with_("ev", "runs", "pl") + f"""SELECT game_id, count(*) AS events, count(DISTINCT player_id) AS players,
      count(DISTINCT session_id) AS sessions FROM ev WHERE {SCOPE_SQL} AND {USERS_SQL} GROUP BY 1""",
)
def summary_tiles_in_scope(spark, d):
    pl = t.players(spark, d)
    tiles = g.tiles(in_scope(t.events(spark, d), SCOPE, pl), in_scope(t.runs(spark, d), SCOPE, pl))
    return tiles.select("game_id", "events", "players", "sessions")


def _buckets(table: str, labels: list[str], index: str) -> str:
    values = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    return f"""SELECT g.game_id, s.i, s.bucket, count(x.b) AS value
      FROM (SELECT DISTINCT game_id FROM ev) g CROSS JOIN (VALUES {values}) s(i, bucket)
      LEFT JOIN (SELECT game_id, {index} AS b FROM {table}) x ON x.game_id = g.game_id AND x.b = s.i GROUP BY ALL"""


LENGTH_CASE = "CASE WHEN minutes < 2 THEN 0 WHEN minutes < 5 THEN 1 WHEN minutes < 10 THEN 2 WHEN minutes < 20 THEN 3 WHEN minutes < 40 THEN 4 ELSE 5 END"


@query("session_length_histogram", with_("ev", "sess") + _buckets("sess", g.LENGTH_LABELS, LENGTH_CASE))
def session_length_histogram(spark, d):
    return g.session_length_histogram(t.events(spark, d))


@query("score_histogram", with_("ev", "runs") + _buckets("runs", g.SCORE_LABELS, "least(9, greatest(0, trunc(score * 10)))"))
def score_histogram(spark, d):
    return g.score_histogram(t.runs(spark, d))


@query("event_type_counts", with_("ev") + 'SELECT game_id, type, count(*) AS "count" FROM ev GROUP BY ALL')
def event_type_counts(spark, d):
    return g.event_type_counts(t.events(spark, d))


@query(
    "hourly_activity",
    with_("ev") + """SELECT g.game_id, CAST(h.hour AS INTEGER) AS hour, count(e.id) AS value
    FROM (SELECT DISTINCT game_id FROM ev) g CROSS JOIN range(24) h(hour)
    LEFT JOIN ev e ON e.game_id = g.game_id AND hour(e.created_at) = h.hour GROUP BY ALL""",
)
def hourly_activity(spark, d):
    return g.hourly(t.events(spark, d))


@query(
    "top_players",
    with_("ev", "pl") + """SELECT game_id, rank, username, events FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY game_id ORDER BY events DESC, username) AS INTEGER) AS rank FROM
        (SELECT game_id, username, count(*) AS events FROM ev JOIN pl ON pl.id = player_id GROUP BY ALL)) WHERE rank <= 8""",
)
def top_players(spark, d):
    return g.top_players(t.events(spark, d), t.players(spark, d))


def _daily(where: str, start: str, end: str) -> str:
    return f"""SELECT s.game_id, strftime(s.day, '%Y-%m-%d') AS day, coalesce(events, 0) AS events, coalesce(sessions, 0) AS sessions,
      coalesce(players, 0) AS players, CASE WHEN e.day IS NULL THEN 0 ELSE coalesce(new_players, 0) END AS new_players,
      coalesce(runs, 0) AS runs, {r('score')} AS avg_score
    FROM (SELECT game_id, CAST(unnest(generate_series({start}, {end}, INTERVAL 1 DAY)) AS DATE) AS day
          FROM ev WHERE {where} GROUP BY game_id) s
    LEFT JOIN (SELECT game_id, CAST(created_at AS DATE) AS day, count(*) AS events, count(DISTINCT session_id) AS sessions,
                 count(DISTINCT player_id) AS players FROM ev WHERE {where} GROUP BY ALL) e ON e.game_id = s.game_id AND e.day = s.day
    LEFT JOIN (SELECT game_id, CAST(created_at AS DATE) AS day, count(*) AS runs, avg(score) AS score FROM runs WHERE {where} GROUP BY ALL) r
      ON r.game_id = s.game_id AND r.day = s.day
    LEFT JOIN (SELECT game_id, day, count(*) AS new_players FROM
        (SELECT game_id, player_id, min(CAST(created_at AS DATE)) AS day FROM ev GROUP BY ALL) GROUP BY ALL) n
      ON n.game_id = s.game_id AND n.day = s.day"""


@query(
    "daily_series",
    with_("ev", "runs") + _daily("true", "min(CAST(created_at AS DATE))::TIMESTAMP", "max(CAST(created_at AS DATE))::TIMESTAMP"),
)
def daily_series(spark, d):
    return g.daily_series(t.events(spark, d), t.runs(spark, d))


LATER = "created_at + to_days(CAST(player_id % 10 * 500 AS INTEGER))"


@query(
    "daily_series_over_years",
    with_("ev") + f""", late AS (SELECT * REPLACE ({LATER} AS created_at) FROM ev)
    SELECT s.game_id, strftime(s.day, '%Y-%m-%d') AS day, coalesce(events, 0) AS events
    FROM (SELECT game_id, CAST(unnest(generate_series(min(CAST(created_at AS DATE))::TIMESTAMP, max(CAST(created_at AS DATE))::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM late GROUP BY 1) s
    LEFT JOIN (SELECT game_id, CAST(created_at AS DATE) AS day, count(*) AS events FROM late GROUP BY ALL) e ON e.game_id = s.game_id AND e.day = s.day""",
)
def daily_series_over_years(spark, d):
    """Players' events moved apart, so that the days span more than ten years."""
    move = lambda df: df.withColumn("created_at", F.col("created_at") + F.make_dt_interval((F.col("player_id") % 10 * 500).cast("int")))
    return g.daily_series(move(t.events(spark, d)), move(t.runs(spark, d))).select("game_id", "day", "events")


@query(
    "daily_series_in_scope",
    with_("ev", "runs", "pl") + _daily(f"{SCOPE_SQL} AND {USERS_SQL}", "TIMESTAMP '2024-01-08'", "TIMESTAMP '2024-01-21'"),
)
def daily_series_in_scope(spark, d):
    return g.daily_series(t.events(spark, d), t.runs(spark, d), SCOPE, t.players(spark, d))


@query(
    "attempt_index",
    with_("ev", "runs") + """SELECT game_id, player_id, id,
      row_number() OVER (PARTITION BY game_id, player_id ORDER BY created_at, id) AS attempt FROM runs""",
)
def attempt_index(spark, d):
    return g.attempts(t.runs(spark, d)).select("game_id", "player_id", "id", "attempt")


@query(
    "learning_curve",
    with_("ev", "runs") + f"""SELECT game_id, attempt, {r('avg(score)')} AS avg, {r('avg(stars)', 3)} AS avg_stars, count(*) AS n FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY game_id, player_id ORDER BY created_at, id) AS INTEGER) AS attempt FROM runs)
    WHERE attempt <= 20 GROUP BY ALL HAVING count(*) >= 3""",
)
def learning_curve(spark, d):
    return g.learning_curve(t.runs(spark, d))


EFFORT = with_("ev", "runs", "sess") + ", pts AS (SELECT r.*, events, coalesce(minutes, 0) AS minutes FROM runs r JOIN sess USING (game_id, session_id)) "


@query("session_effort", EFFORT + f"SELECT game_id, session_id, events, {r('minutes', 3)} AS minutes, {r('score')} AS score FROM pts")
def session_effort(spark, d):
    pts = g.effort(t.events(spark, d), t.runs(spark, d))
    return pts.select("game_id", "session_id", "events", g.round_half_up("minutes", 3).alias("minutes"), g.round_half_up("score").alias("score"))


@query(
    "effort_correlation",
    EFFORT + f"""SELECT game_id, count(*) AS n, {r('corr(minutes, score)')} AS r_duration_score,
      {r('corr(events, score)')} AS r_events_score FROM pts GROUP BY 1""",
)
def effort_correlation(spark, d):
    return g.effort_correlation(g.effort(t.events(spark, d), t.runs(spark, d)))


@query(
    "effort_trend",
    EFFORT + f"SELECT game_id, {r('regr_slope(score, minutes)', 6)} AS slope, {r('regr_intercept(score, minutes)', 6)} AS intercept FROM pts GROUP BY 1",
)
def effort_trend(spark, d):
    return g.effort_trend(g.effort(t.events(spark, d), t.runs(spark, d)))


@query(
    "effort_scatter",
    EFFORT + f"""SELECT game_id, id, {r('minutes', 3)} AS minutes, events, {r('score')} AS score FROM pts""",
)
def effort_scatter(spark, d):
    return g.effort_scatter(g.effort(t.events(spark, d), t.runs(spark, d)))


@query(
    "retention_curve",
    with_("ev") + f""", sp AS (SELECT game_id, player_id, date_diff('day', min(CAST(created_at AS DATE)), max(CAST(created_at AS DATE))) AS span FROM ev GROUP BY ALL),
    days AS (SELECT game_id, CAST(unnest(range(least(max(span), 60) + 1)) AS INTEGER) AS day, count(*) AS n FROM sp GROUP BY game_id)
    SELECT d.game_id, d.day, {r('count(s.span)::DOUBLE / max(d.n)')} AS retained
    FROM days d LEFT JOIN sp s ON s.game_id = d.game_id AND s.span >= d.day GROUP BY ALL""",
)
def retention_curve(spark, d):
    return g.retention(t.events(spark, d))


PER_PLAYER = with_("ev") + """, pp AS (SELECT game_id, player_id, count(*) AS x FROM ev GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY x, player_id) AS i, sum(x) OVER (PARTITION BY game_id ORDER BY x, player_id) AS cum,
      count(*) OVER (PARTITION BY game_id) AS n, sum(x) OVER (PARTITION BY game_id) AS total FROM pp) """


@query(
    "engagement_gini",
    PER_PLAYER + f"SELECT game_id, max(n) AS players, {r('2.0 * sum(i * x)::DOUBLE / (max(n)::DOUBLE * max(total)) - (max(n) + 1.0) / max(n)')} AS gini FROM rk GROUP BY 1",
)
def engagement_gini(spark, d):
    return g.gini(t.events(spark, d))


@query(
    "engagement_lorenz",
    PER_PLAYER + f""", st AS (SELECT game_id, max(n) AS n, max(total) AS total, CAST(unnest(range(1, least(100, max(n)) + 1)) AS INTEGER) AS step, least(100, max(n)) AS steps FROM rk GROUP BY 1),
    up AS (SELECT *, CAST(floor(step::DOUBLE / steps * n + 0.5) AS BIGINT) AS upto FROM st)
    SELECT u.game_id, u.step, {r('u.upto::DOUBLE / u.n')} AS p, {r('rk.cum::DOUBLE / u.total')} AS cum FROM up u JOIN rk ON rk.game_id = u.game_id AND rk.i = u.upto
    UNION ALL SELECT DISTINCT game_id, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM rk""",
)
def engagement_lorenz(spark, d):
    return g.lorenz(t.events(spark, d))


@query(
    "player_table",
    with_("ev", "runs", "pl") + f"""SELECT e.game_id, username, sessions, events, {clock('last_seen')} AS last_seen, runs, {r('best')} AS best_score, best_stars
    FROM (SELECT game_id, player_id, count(DISTINCT session_id) AS sessions, count(*) AS events, max(created_at) AS last_seen FROM ev GROUP BY ALL) e
    LEFT JOIN (SELECT game_id, player_id, count(*) AS runs, max(score) AS best, max(stars) AS best_stars FROM runs GROUP BY ALL) r USING (game_id, player_id)
    JOIN pl ON pl.id = e.player_id""",
)
def player_table(spark, d):
    return g.player_table(t.events(spark, d), t.runs(spark, d), t.players(spark, d))


@query(
    "player_roster",
    with_("ev", "pl") + f"""SELECT game_id, player_id, username, count(DISTINCT session_id) AS sessions, count(*) AS events, {clock('max(ev.created_at)')} AS last_seen
    FROM ev JOIN pl ON pl.id = player_id GROUP BY game_id, player_id, username""",
)
def player_roster(spark, d):
    return g.roster(t.events(spark, d), t.players(spark, d))


@query(
    "player_games",
    with_("ev", "runs", "pl") + f"""SELECT username, e.game_id, events, sessions, coalesce(runs, 0) AS runs, {r('best')} AS best
    FROM (SELECT game_id, player_id, count(DISTINCT session_id) AS sessions, count(*) AS events FROM ev GROUP BY ALL) e
    LEFT JOIN (SELECT game_id, player_id, count(*) AS runs, max(score) AS best FROM runs GROUP BY ALL) r USING (game_id, player_id)
    JOIN pl ON pl.id = e.player_id""",
)
def player_games(spark, d):
    return g.player_games(t.events(spark, d), t.runs(spark, d), t.players(spark, d))


@query("player_event_types", with_("ev", "pl") + 'SELECT username, game_id, type, count(*) AS "count" FROM ev JOIN pl ON pl.id = player_id GROUP BY ALL')
def player_event_types(spark, d):
    return g.player_event_types(t.events(spark, d), t.players(spark, d))


def _board(where: str) -> str:
    return with_("ev", "runs", "pl") + f"""SELECT game_id, rank, username, score, stars, level, {clock('b.created_at')} AS created_at FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY game_id ORDER BY score DESC, created_at, id) AS INTEGER) AS rank FROM runs WHERE {where}) b
    JOIN pl ON pl.id = b.player_id WHERE rank <= 20"""


@query("leaderboard", _board("true"))
def leaderboard(spark, d):
    return g.leaderboard(t.runs(spark, d), t.players(spark, d))


@query("leaderboard_by_level", _board("level = 'click'"))
def leaderboard_by_level(spark, d):
    return g.leaderboard(t.runs(spark, d), t.players(spark, d), level="click")


@query(
    "leaderboard_of_known_players",
    with_("ev", "runs", "pl") + """SELECT * FROM (SELECT game_id, CAST(row_number() OVER (PARTITION BY game_id ORDER BY score DESC, created_at, id) AS INTEGER) AS rank, username, score
      FROM runs b JOIN (SELECT id AS pid, username FROM pl WHERE id % 3 <> 0) ON pid = player_id) WHERE rank <= 5""",
)
def leaderboard_of_known_players(spark, d):
    """Players whose row is gone take no place."""
    return g.leaderboard(t.runs(spark, d), t.players(spark, d).where("id % 3 <> 0"), 5).select("game_id", "rank", "username", "score")


def _recent(keys: str, k: int) -> str:
    return with_("ev", "runs", "pl") + f"""SELECT username, game_id, rank, level, score, stars, session_id, {clock('b.created_at')} AS created_at FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank FROM runs) b
    JOIN pl ON pl.id = b.player_id WHERE rank <= {k}"""


@query("player_runs_in_game", _recent("player_id, game_id", 50))
def player_runs_in_game(spark, d):
    return g.player_runs(t.runs(spark, d), t.players(spark, d)).drop("meta")


@query("player_recent_runs", _recent("player_id", 100))
def player_recent_runs(spark, d):
    return g.player_runs(t.runs(spark, d), t.players(spark, d), 100, per_game=False).drop("meta")


@query(
    "players_sorted",
    with_("ev", "runs", "pl") + f"""SELECT username, best_score, CAST(row_number() OVER (ORDER BY best_score ASC NULLS FIRST, username) AS BIGINT) AS place FROM (
      SELECT username, max({r('score')}) AS best_score FROM pl LEFT JOIN runs ON runs.player_id = pl.id GROUP BY 1)""",
)
def players_sorted(spark, d):
    """Sort by a column, missing values lowest; the place is a global row number."""
    best = t.runs(spark, d).groupBy(F.col("player_id").alias("id")).agg(F.max("score").alias("best"))
    named = t.players(spark, d).join(best, "id", "left").select("username", g.round_half_up("best").alias("best_score"))
    whole = named.withColumn("all", F.lit(0))
    return ordered.numbered(whole, ["all"], [F.asc_nulls_first("best_score"), "username"], "place").drop("all")
