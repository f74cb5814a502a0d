"""Engagement, learning and retention measures, for all games in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.functions.scalars import clock, round_half_up, span_minutes
from playtrace.operators import ordered
from playtrace.operators.scope import Scope, in_scope

# Histogram labels and limits shown in reports.
SCORE_LABELS = ["0–10%", "10–20%", "20–30%", "30–40%", "40–50%", "50–60%", "60–70%", "70–80%", "80–90%", "90–100%"]
LENGTH_LABELS = ["0–2m", "2–5m", "5–10m", "10–20m", "20–40m", "40m+"]
LENGTH_EDGES = [2, 5, 10, 20, 40]
MAX_ATTEMPTS = 20
MIN_SUPPORT = 3
MAX_RETENTION_DAY = 60
LORENZ_STEPS = 100


def bucket_index(v: Column, edges: list) -> Column:
    """Index of the first upper edge above ``v``; the last bucket is open."""
    expr = F.when(v < edges[0], 0)
    for i, e in enumerate(edges[1:], 1):
        expr = expr.when(v < e, i)
    return expr.when(v.isNotNull(), len(edges))


def fill_buckets(counts: DataFrame, games: DataFrame, labels: list[str]) -> DataFrame:
    """Per-game bucket counts with the missing buckets as zeros."""
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("b") + 1)
    spine = games.select("game_id", F.explode(F.sequence(F.lit(0), F.lit(len(labels) - 1))).alias("b"))
    return (
        spine.join(counts, ["game_id", "b"], "left")
        .select("game_id", F.col("b").alias("i"), label.alias("bucket"), F.coalesce("n", F.lit(0)).alias("value"))
    )


def session_stats(events: DataFrame) -> DataFrame:
    """Event count and span of each session; events without a session form one group."""
    return (
        events.groupBy("game_id", "session_id")
        .agg(F.count("*").alias("events"), F.min("t_ms").alias("t_min"), F.max("t_ms").alias("t_max"))
        .withColumn("minutes", span_minutes("t_min", "t_max"))
    )


def overview(events: DataFrame, runs: DataFrame, special: tuple[str, ...] = ()) -> DataFrame:
    """Every game with events or runs."""
    ev = events.groupBy("game_id").agg(
        F.count("*").alias("events"),
        F.count_distinct("player_id").alias("players"),
        F.count_distinct("session_id").alias("sessions"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )
    rn = runs.groupBy("game_id").agg(F.count("*").alias("runs"))
    return ev.join(rn, "game_id", "full_outer").select(
        "game_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "players", "sessions", "runs")],
        clock("first_seen").alias("first_seen"),
        clock("last_seen").alias("last_seen"),
        F.col("game_id").isin(*special).alias("has_specific") if special else F.lit(False).alias("has_specific"),
    )


def suite_totals(events: DataFrame, runs: DataFrame, players: DataFrame) -> DataFrame:
    ov = overview(events, runs)
    return ov.agg(
        F.count("*").alias("games"),
        F.sum("events").alias("events"),
        F.sum("runs").alias("runs"),
        F.sum("sessions").alias("sessions"),
    ).crossJoin(players.agg(F.count("*").alias("players")))


def tiles(events: DataFrame, runs: DataFrame) -> DataFrame:
    """The headline numbers of each game with events or runs."""
    ev = events.groupBy("game_id").agg(
        F.count("*").alias("events"),
        F.count_distinct("player_id").alias("players"),
        F.count_distinct("session_id").alias("sessions"),
    )
    rn = runs.groupBy("game_id").agg(
        F.count("*").alias("runs"), F.avg("score").alias("score"), F.avg("stars").alias("stars")
    )
    back = returning(events)
    minutes = session_stats(events).groupBy("game_id").agg(F.avg("minutes").alias("minutes"))
    per = lambda a, b, n: round_half_up(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), n)
    return (
        ev.join(rn, "game_id", "full_outer")
        .fillna(0, ["events", "players", "sessions"])
        .join(back, "game_id", "left")
        .join(minutes, "game_id", "left")
        .select(
            "game_id",
            "players",
            "sessions",
            "events",
            F.coalesce("runs", F.lit(0)).alias("runs"),
            round_half_up("score", 4).alias("avg_score"),
            round_half_up("stars", 2).alias("avg_stars"),
            round_half_up("minutes", 1).alias("avg_session_min"),
            per("events", "sessions", 1).alias("events_per_session"),
            per("sessions", "players", 1).alias("sessions_per_player"),
            F.coalesce("returning_players", F.lit(0)).alias("returning_players"),
            per("returning_players", "players", 3).alias("returning_rate"),
        )
    )


def returning(events: DataFrame) -> DataFrame:
    """Players with more than one session."""
    return (
        events.groupBy("game_id", "player_id")
        .agg(F.count_distinct("session_id").alias("sessions"))
        .groupBy("game_id")
        .agg(F.count_if(F.col("sessions") > 1).alias("returning_players"))
    )


def session_length_histogram(events: DataFrame) -> DataFrame:
    st = session_stats(events).select("game_id", bucket_index(F.col("minutes"), LENGTH_EDGES).alias("b"))
    counts = st.groupBy("game_id", "b").agg(F.count("*").alias("n"))
    return fill_buckets(counts, counts.select("game_id").distinct(), LENGTH_LABELS)


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("game_id", "type").agg(F.count("*").alias("count"))


def score_histogram(runs: DataFrame, scale: float = 1.0) -> DataFrame:
    """Ten buckets over [0, scale]; values outside go to the end buckets."""
    tenth = F.least(F.lit(9.0), F.greatest(F.lit(0.0), F.col("score") / F.lit(scale) * 10)).cast("int")
    scored = runs.where(F.col("score").isNotNull())
    counts = scored.select("game_id", tenth.alias("b")).groupBy("game_id", "b").agg(F.count("*").alias("n"))
    return fill_buckets(counts, counts.select("game_id").distinct(), SCORE_LABELS)


def hourly(events: DataFrame) -> DataFrame:
    counts = events.groupBy("game_id", F.hour("created_at").alias("hour")).agg(F.count("*").alias("n"))
    spine = counts.select("game_id").distinct().select("game_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return spine.join(counts, ["game_id", "hour"], "left").select(
        "game_id", "hour", F.coalesce("n", F.lit(0)).alias("value")
    )


def top_players(events: DataFrame, players: DataFrame, k: int = 8) -> DataFrame:
    counts = events.groupBy("game_id", "player_id").agg(F.count("*").alias("events"))
    named = counts.join(players.select(F.col("id").alias("player_id"), "username"), "player_id")
    return ordered.top_k(named, ["game_id"], [F.desc("events"), "username"], k).select(
        "game_id", "rank", "username", "events"
    )


def daily_series(events: DataFrame, runs: DataFrame, scope: Scope | None = None, players: DataFrame | None = None) -> DataFrame:
    """One row per game and day without gaps; first-ever days ignore the scope."""
    day = F.to_date("created_at").alias("day")
    ev = in_scope(events, scope, players).groupBy("game_id", day).agg(
        F.count("*").alias("events"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("player_id").alias("players"),
    )
    rn = in_scope(runs, scope, players).groupBy("game_id", day).agg(
        F.count("*").alias("runs"), F.avg("score").alias("score")
    )
    new = (
        events.groupBy("game_id", "player_id")
        .agg(F.min(F.to_date("created_at")).alias("day"))
        .groupBy("game_id", "day")
        .agg(F.count("*").alias("new_players"))
    )
    days = ev.join(rn, ["game_id", "day"], "full_outer").join(new, ["game_id", "day"], "left")
    start = F.to_date(F.lit(scope.start[:10])) if scope and scope.start else F.min("day")
    end = F.to_date(F.lit(scope.end[:10])) if scope and scope.end else F.max("day")
    span = days.groupBy("game_id").agg(start.alias("d0"), end.alias("d1")).where("d0 <= d1")
    spine = span.select("game_id", F.explode(F.sequence("d0", "d1")).alias("day"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(days, ["game_id", "day"], "left").select(
        "game_id",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        *[zero(c) for c in ("events", "sessions", "players", "new_players", "runs")],
        round_half_up("score", 4).alias("avg_score"),
    )


def attempts(runs: DataFrame) -> DataFrame:
    """Every run with a session and its attempt number for that player."""
    return ordered.numbered(
        runs.where(F.col("session_id").isNotNull()), ["game_id", "player_id"], ["created_at", "id"], "attempt"
    )


def learning_curve(runs: DataFrame) -> DataFrame:
    """Mean result by attempt, for the first attempts with enough players."""
    known = runs.where(F.col("session_id").isNotNull()).select("game_id", "player_id", "created_at", "id", "score", "stars")
    first = ordered.top_k(known, ["game_id", "player_id"], ["created_at", "id"], MAX_ATTEMPTS, "attempt")
    return (
        first.groupBy("game_id", "attempt")
        .agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("stars").alias("stars"))
        .where(F.col("n") >= MIN_SUPPORT)
        .select("game_id", "attempt", round_half_up("score", 4).alias("avg"), round_half_up("stars", 3).alias("avg_stars"), "n")
    )


def effort(events: DataFrame, runs: DataFrame) -> DataFrame:
    """One point per run: events and minutes of its session against its score."""
    st = session_stats(events.where(F.col("session_id").isNotNull()))
    return runs.join(st, ["game_id", "session_id"]).select(
        "game_id", "session_id", "id", "created_at", "events", F.coalesce("minutes", F.lit(0.0)).alias("minutes"), "score"
    )


def _pearson(x: str, y: str) -> Column:
    """Pearson r; null below three points or without variance."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when((F.count("*") >= 3) & varies, round_half_up(F.corr(x, y), 4))


def effort_correlation(points: DataFrame) -> DataFrame:
    return points.groupBy("game_id").agg(
        F.count("*").alias("n"),
        _pearson("minutes", "score").alias("r_duration_score"),
        _pearson("events", "score").alias("r_events_score"),
    )


def effort_trend(points: DataFrame) -> DataFrame:
    """Least-squares line of score on minutes; null without spread in minutes."""
    varies = F.min("minutes") < F.max("minutes")
    return points.groupBy("game_id").agg(
        F.when(varies, round_half_up(F.regr_slope("score", "minutes"), 6)).alias("slope"),
        F.when(varies, round_half_up(F.regr_intercept("score", "minutes"), 6)).alias("intercept"),
    )


def effort_scatter(points: DataFrame) -> DataFrame:
    """Every point as reports show it."""
    return points.select("game_id", "id", round_half_up("minutes", 3).alias("minutes"), "events", round_half_up("score", 4).alias("score"))


def retention(events: DataFrame) -> DataFrame:
    """Share of players still active at least d days after their first day."""
    day = F.to_date("created_at")
    spans = (
        events.groupBy("game_id", "player_id")
        .agg(F.date_diff(F.max(day), F.min(day)).alias("span"))
        .groupBy("game_id", F.least("span", F.lit(MAX_RETENTION_DAY + 1)).alias("b"))
        .agg(F.count("*").alias("n"))
    )
    game = Window.partitionBy("game_id")  # at most 62 rows per game
    last = F.least(F.max("b").over(game), F.lit(MAX_RETENTION_DAY))
    reach = spans.withColumns({"last": last, "total": F.sum("n").over(game)}).select(
        "game_id", "n", "total", F.explode(F.sequence(F.lit(0), F.least("b", "last"))).alias("day")
    )
    return reach.groupBy("game_id", "day").agg(
        round_half_up(F.sum("n") / F.max("total"), 4).alias("retained")
    )


def _count_blocks(events: DataFrame) -> DataFrame:
    """Players grouped by how many events they have, in ascending order.

    Players with equal counts are one block, so a game with any number of players has
    at most about sqrt(2 x events) blocks.
    """
    per = events.groupBy("game_id", "player_id").agg(F.count("*").alias("x"))
    blocks = per.groupBy("game_id", "x").agg(F.count("*").alias("m"))
    before = Window.partitionBy("game_id").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    game = Window.partitionBy("game_id")
    return blocks.withColumns(
        {
            "c0": F.coalesce(F.sum("m").over(before), F.lit(0)),
            "s0": F.coalesce(F.sum(F.col("m") * F.col("x")).over(before), F.lit(0)),
            "players": F.sum("m").over(game),
            "total": F.sum(F.col("m") * F.col("x")).over(game),
        }
    )


def gini(events: DataFrame) -> DataFrame:
    """Inequality of events per player."""
    d = lambda c: F.col(c).cast("double")
    ranks = d("m") * d("c0") + d("m") * (d("m") + 1) / 2  # sum of the ranks inside a block
    return (
        _count_blocks(events)
        .groupBy("game_id")
        .agg(F.sum(d("x") * ranks).alias("w"), F.max("players").alias("players"), F.max("total").alias("total"))
        .select(
            "game_id",
            "players",
            round_half_up(2 * F.col("w") / (d("players") * d("total")) - (d("players") + 1) / d("players"), 4).alias("gini"),
        )
    )


def lorenz(events: DataFrame) -> DataFrame:
    """Cumulative share of events by cumulative share of players, at most 101 points."""
    b = _count_blocks(events).withColumn("steps", F.least(F.lit(LORENZ_STEPS), F.col("players")))
    lo = F.greatest(F.lit(1), F.floor(F.col("c0") * F.col("steps") / F.col("players")) - 1)
    hi = F.least(F.col("steps"), F.ceil((F.col("c0") + F.col("m")) * F.col("steps") / F.col("players")) + 1)
    upto = F.floor(F.col("s") / F.col("steps") * F.col("players") + 0.5)
    points = (
        b.withColumn("s", F.explode(F.sequence(lo, hi)))
        .withColumn("upto", upto)
        .where((F.col("upto") > F.col("c0")) & (F.col("upto") <= F.col("c0") + F.col("m")))
        .select(
            "game_id",
            F.col("s").cast("int").alias("step"),
            round_half_up(F.col("upto") / F.col("players"), 4).alias("p"),
            round_half_up((F.col("s0") + (F.col("upto") - F.col("c0")) * F.col("x")) / F.col("total"), 4).alias("cum"),
        )
    )
    origin = b.select("game_id").distinct().select(
        "game_id", F.lit(0).alias("step"), F.lit(0.0).alias("p"), F.lit(0.0).alias("cum")
    )
    return origin.unionByName(points)


def _named(df: DataFrame, players: DataFrame) -> DataFrame:
    return df.join(players.select(F.col("id").alias("player_id"), "username"), "player_id")


def roster(events: DataFrame, players: DataFrame) -> DataFrame:
    per = events.groupBy("game_id", "player_id").agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count("*").alias("events"),
        F.max("created_at").alias("last_seen"),
    )
    return _named(per, players).select("game_id", "player_id", "username", "sessions", "events", clock("last_seen").alias("last_seen"))


def player_table(events: DataFrame, runs: DataFrame, players: DataFrame) -> DataFrame:
    """Players with events, and their best results; players with runs only are left out."""
    rn = runs.groupBy("game_id", "player_id").agg(
        F.count("*").alias("runs"), F.max("score").alias("best"), F.max("stars").alias("best_stars")
    )
    return roster(events, players).join(rn, ["game_id", "player_id"], "left").select(
        "game_id",
        "username",
        "sessions",
        "events",
        "last_seen",
        F.coalesce("runs", F.lit(0)).alias("runs"),
        round_half_up("best", 4).alias("best_score"),
        "best_stars",
    )


def player_games(events: DataFrame, runs: DataFrame, players: DataFrame) -> DataFrame:
    """Each player's activity by game."""
    ev = events.groupBy("player_id", "game_id").agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions")
    )
    rn = runs.groupBy("player_id", "game_id").agg(F.count("*").alias("runs"), F.max("score").alias("best"))
    return _named(ev.join(rn, ["player_id", "game_id"], "left"), players).select(
        "username", "game_id", "events", "sessions", F.coalesce("runs", F.lit(0)).alias("runs"), round_half_up("best", 4).alias("best")
    )


def player_event_types(events: DataFrame, players: DataFrame) -> DataFrame:
    per = events.groupBy("player_id", "game_id", "type").agg(F.count("*").alias("count"))
    return _named(per, players).select("username", "game_id", "type", "count")


def leaderboard(runs: DataFrame, players: DataFrame, limit: int = 20, level: str | None = None) -> DataFrame:
    """Best runs of each game; the earlier of two equal scores ranks first."""
    limit = max(1, min(100, limit))
    chosen = runs if level is None else runs.where(F.col("level") == level)
    known = _named(chosen.select("game_id", "player_id", "id", "score", "stars", "level", "created_at"), players)
    return ordered.top_k(known, ["game_id"], [F.desc("score"), F.asc("created_at"), F.asc("id")], limit).select(
        "game_id", "rank", "username", "score", "stars", "level", clock("created_at").alias("created_at")
    )


def player_runs(runs: DataFrame, players: DataFrame, limit: int = 50, per_game: bool = True) -> DataFrame:
    """Newest runs of each player, per game or over all games."""
    limit = max(1, min(200, limit))
    keys = ["player_id", "game_id"] if per_game else ["player_id"]
    return ordered.top_k(_named(runs, players), keys, [F.desc("created_at"), F.desc("id")], limit).select(
        "username", "game_id", "rank", "level", "score", "stars", "session_id", "meta", clock("created_at").alias("created_at")
    )
