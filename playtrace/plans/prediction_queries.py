"""Telemetry, feature-table and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrace.functions.scalars import round_half_up
from playtrace.operators import features, metrics, telemetry
from playtrace.plans import tables as t
from playtrace.plans.engagement_queries import _buckets
from playtrace.plans.registry import query, r, with_

# ---- telemetry ---------------------------------------------------------------------------

TAPS = with_("ev", "pl") + """, tp AS (SELECT game_id, player_id, CASE type WHEN 'click' THEN 'hit' WHEN 'error' THEN 'miss' ELSE 'expire' END AS kind,
      (k % 10) / 10.0::DOUBLE AS x, floor(k / 10) / 10.0::DOUBLE AS y, CASE WHEN type = 'click' AND value > 0 THEN value END AS reaction, least(40, seq + 1) AS n
    FROM (SELECT *, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM ev) WHERE type IN ('click', 'error', 'view')) """


@query(
    "tap_totals",
    TAPS + f"""SELECT game_id, count(*) FILTER (WHERE kind = 'hit') AS hits, count(*) FILTER (WHERE kind = 'miss') AS misses,
      count(*) FILTER (WHERE kind = 'expire') AS expires, count(*) AS taps, {r("avg(CASE WHEN kind = 'hit' THEN 1.0 ELSE 0.0 END)")} AS accuracy,
      {r("avg(CASE WHEN kind <> 'hit' THEN 1.0 ELSE 0.0 END)")} AS miss_rate, {r('avg(reaction)', 1)} AS avg_reaction,
      min(reaction) AS fastest_reaction, max(reaction) AS slowest_reaction FROM tp GROUP BY 1""",
)
def tap_totals(spark, d):
    return telemetry.totals(telemetry.taps(t.taps(spark, d)))


@query(
    "tap_heatmap",
    TAPS + """, c AS (SELECT game_id, CAST(least(15, floor(x * 16)) AS INTEGER) AS cx, CAST(least(9, floor(y * 10)) AS INTEGER) AS cy,
      count(*) FILTER (WHERE kind = 'hit') AS hits, count(*) FILTER (WHERE kind = 'miss') AS misses FROM tp WHERE kind IN ('hit', 'miss') GROUP BY ALL)
    SELECT g.game_id, CAST(a.v AS INTEGER) AS cx, CAST(b.v AS INTEGER) AS cy, coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses, g.max
    FROM (SELECT game_id, max(greatest(hits, misses)) AS max FROM c GROUP BY 1) g CROSS JOIN range(16) a(v) CROSS JOIN range(10) b(v)
    LEFT JOIN c ON c.game_id = g.game_id AND c.cx = a.v AND c.cy = b.v""",
)
def tap_heatmap(spark, d):
    return telemetry.heatmap(telemetry.taps(t.taps(spark, d)))


REACTION_CASE = "CASE WHEN reaction < 250 THEN 0 WHEN reaction < 350 THEN 1 WHEN reaction < 450 THEN 2 WHEN reaction < 550 THEN 3 WHEN reaction < 650 THEN 4 WHEN reaction < 750 THEN 5 WHEN reaction IS NOT NULL THEN 6 END"


@query("tap_reaction_histogram", TAPS + _buckets("tp", telemetry.REACTION_LABELS, REACTION_CASE))
def tap_reaction_histogram(spark, d):
    return telemetry.reaction_histogram(telemetry.taps(t.taps(spark, d)))


@query(
    "tap_warm_up",
    TAPS + f"""SELECT game_id, CAST(n AS INTEGER) AS n, {r('avg(reaction)', 1)} AS reaction, count(*) AS "count" FROM tp
    WHERE reaction IS NOT NULL GROUP BY game_id, n HAVING count(*) >= 3""",
)
def tap_warm_up(spark, d):
    return telemetry.warm_up(telemetry.taps(t.taps(spark, d)))


@query(
    "tap_player_speed",
    TAPS + f"""SELECT game_id, username, count(*) AS taps, count(*) FILTER (WHERE kind = 'hit') AS hits,
      {r("avg(CASE WHEN kind = 'hit' THEN 1.0 ELSE 0.0 END)")} AS accuracy, {r('avg(reaction)', 1)} AS avg_reaction
    FROM tp JOIN pl ON pl.id = player_id GROUP BY game_id, username HAVING count(*) >= 5""",
)
def tap_player_speed(spark, d):
    return telemetry.player_speed(telemetry.taps(t.taps(spark, d)), t.players(spark, d))


@query(
    "registered_module_totals",
    TAPS + """SELECT 'tap-game' AS game_id, count(*) FILTER (WHERE kind = 'hit') AS hits, count(*) AS taps FROM tp""",
)
def registered_module_totals(spark, d):
    """All taps as the events of the one game that has its own module."""
    ev = t.taps(spark, d).withColumn("game_id", F.lit("tap-game"))
    return telemetry.specific("tap-game", ev, t.players(spark, d))["totals"].select("game_id", "hits", "taps")


# ---- features ----------------------------------------------------------------------------

FEATURES = with_("ev", "runs", "tr") + """, tt AS (SELECT game_id, type, row_number() OVER (PARTITION BY game_id ORDER BY count(*) DESC, type) AS rank FROM ev GROUP BY game_id, type),
    sf AS (SELECT e.*, coalesce(s.self, 0) AS self FROM (SELECT game_id, session_id, count(*) AS n, count(DISTINCT type) AS distinct_types,
        greatest(0, max(t_ms) - min(t_ms)) / 60000.0 AS minutes, count(*) - 1 AS transitions FROM ev GROUP BY ALL) e
      LEFT JOIN (SELECT game_id, session_id, count(*) AS self FROM tr WHERE src = dst GROUP BY ALL) s USING (game_id, session_id)),
    lv AS (SELECT game_id, level, row_number() OVER (PARTITION BY game_id ORDER BY level) - 1 AS level_ix FROM (SELECT DISTINCT game_id, level FROM runs)),
    hs AS (SELECT *, count(score) OVER w AS prior_runs, coalesce(avg(score) OVER w, avg(score) OVER (PARTITION BY game_id)) AS prior_avg FROM runs
      WINDOW w AS (PARTITION BY game_id, player_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ds AS (SELECT h.game_id, h.id, h.session_id, h.player_id, h.level, h.score, h.stars, h.prior_runs, h.prior_avg, n, distinct_types, minutes, transitions,
      CASE WHEN minutes > 0 THEN n / minutes ELSE 0 END AS per_min, CASE WHEN transitions > 0 THEN self / transitions ELSE 0 END AS loop_rate, level_ix
      FROM hs h JOIN sf USING (game_id, session_id) JOIN lv ON lv.game_id = h.game_id AND lv.level = h.level) """


def _fixed(groups: tuple[str, ...]) -> str:
    columns = {
        "volume": [("eventCount", "n"), ("distinctTypes", "distinct_types")],
        "timing": [("durationMin", "minutes"), ("eventsPerMin", "per_min")],
        "structure": [("transitions", "transitions"), ("selfLoopRate", "loop_rate")],
        "context": [("level", "level_ix"), ("priorRuns", "prior_runs"), ("priorAvgScore", "prior_avg")],
    }
    return " UNION ALL ".join(
        f"SELECT game_id, id, '{g}' AS grp, '{f}' AS feature, {r(c + '::DOUBLE', 6)} AS value FROM ds" for g in groups for f, c in columns[g]
    )


MIX = f"""SELECT ds.game_id, ds.id, 'eventmix' AS grp, 'share:' || tt.type AS feature, {r('(count(e.id) / any_value(ds.n))::DOUBLE', 6)} AS value
    FROM ds JOIN tt ON tt.game_id = ds.game_id AND tt.rank <= 12
    LEFT JOIN ev e ON e.game_id = ds.game_id AND e.session_id = ds.session_id AND e.type = tt.type GROUP BY ds.game_id, ds.id, tt.type"""


def _design(spark, d):
    return features.design(t.runs(spark, d), t.steps(spark, d))


@query(
    "session_features",
    FEATURES + f"SELECT game_id, session_id, n, distinct_types, transitions, self AS self_loops, {r('minutes', 6)} AS minutes FROM sf",
)
def session_features(spark, d):
    f = features.session_features(t.steps(spark, d))
    return f.select("game_id", "session_id", "n", "distinct_types", "transitions", "self_loops", round_half_up("minutes", 6).alias("minutes"))


@query("event_mix_vocabulary", FEATURES + "SELECT game_id, type, CAST(rank AS INTEGER) AS rank FROM tt WHERE rank <= 12")
def event_mix_vocabulary(spark, d):
    return features.top_types(t.steps(spark, d)).select("game_id", "type", "rank")


@query("run_features", FEATURES + _fixed(("volume", "timing", "structure", "context")) + " UNION ALL " + MIX)
def run_features(spark, d):
    f = features.long_features(_design(spark, d), t.steps(spark, d))
    return f.withColumn("value", round_half_up("value", 6))


@query("session_length_features", FEATURES + _fixed(("volume", "structure", "context")) + " UNION ALL " + MIX)
def session_length_features(spark, d):
    """For the session-length target the timing group is left out."""
    f = features.long_features(_design(spark, d), t.steps(spark, d), "sessionLen")
    return f.withColumn("value", round_half_up("value", 6))


@query(
    "run_targets",
    FEATURES + f"""SELECT game_id, id, score, stars::DOUBLE AS stars, {r('minutes', 6)} AS "sessionLen", CASE WHEN score >= 0.6 THEN 1.0 ELSE 0.0 END::DOUBLE AS pass FROM ds""",
)
def run_targets(spark, d):
    cols = [features.target_column(x).alias(x) for x in features.TARGETS]
    return _design(spark, d).select("game_id", "id", *cols).withColumn("sessionLen", round_half_up("sessionLen", 6))


@query(
    "target_availability",
    FEATURES + """SELECT game_id, count(DISTINCT score) > 1 AS score, count(DISTINCT stars) > 1 AS stars, true AS "sessionLen", count(DISTINCT score) > 1 AS pass FROM runs GROUP BY 1""",
)
def target_availability(spark, d):
    return features.target_availability(t.runs(spark, d), t.steps(spark, d))


@query("training_readiness", FEATURES + "SELECT game_id, count(*) AS usable, count(*) AS total, count(*) >= 12 AS enough FROM ds GROUP BY 1")
def training_readiness(spark, d):
    return features.readiness(_design(spark, d), t.runs(spark, d))


@query("level_ordinals", FEATURES + "SELECT game_id, level, level_ix FROM lv")
def level_ordinals(spark, d):
    return features.level_ordinals(t.runs(spark, d))


@query("run_history", FEATURES + f"SELECT game_id, id, prior_runs, {r('prior_avg', 6)} AS prior_avg FROM hs")
def run_history(spark, d):
    return features.history(t.runs(spark, d)).select("game_id", "id", "prior_runs", round_half_up("prior_avg", 6).alias("prior_avg"))


@query(
    "min_max_features",
    FEATURES + f""", fx AS ({_fixed(("volume", "structure"))})
    SELECT game_id, id, feature, {r("(value - min(value) OVER w) / CASE WHEN max(value) OVER w > min(value) OVER w THEN max(value) OVER w - min(value) OVER w ELSE 1 END", 5)} AS scaled
    FROM fx WINDOW w AS (PARTITION BY game_id, feature)""",
)
def min_max_features(spark, d):
    f = features.long_features(_design(spark, d), t.steps(spark, d), groups=["volume", "structure"]).withColumn("value", round_half_up("value", 6))
    return features.min_max(f).select("game_id", "id", "feature", round_half_up("scaled", 5).alias("scaled"))


# ---- metrics, on a prediction SQL can repeat: the player's mean score so far ---------------

PRED = FEATURES + f", pr AS (SELECT game_id, id, score AS y, {r('prior_avg', 6)} AS p FROM ds) "
CLASS = FEATURES + f", pr AS (SELECT game_id, id, CASE WHEN score >= 0.6 THEN 1 ELSE 0 END AS y, least(1.0::DOUBLE, {r('prior_avg', 6)}) AS p FROM ds) "


def _predicted(spark, d, target="score"):
    p = round_half_up("priorAvgScore", 6)
    if target == "pass":
        p = F.least(F.lit(1.0), p)
    return _design(spark, d).select("game_id", "id", features.target_column(target).alias("y"), p.alias("p"))


REG = f"""SELECT game_id, count(*) AS n, {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 6)} AS r2,
    {r('sqrt(avg((y - p) * (y - p)))', 6)} AS rmse, {r('avg(abs(y - p))', 6)} AS mae FROM pr GROUP BY 1"""


@query("regression_metrics", PRED + REG)
def regression_metrics(spark, d):
    return metrics.regression(_predicted(spark, d))


@query("constant_baseline_metrics", FEATURES + ", pr AS (SELECT game_id, id, score AS y, avg(score) OVER (PARTITION BY game_id) AS p FROM ds) " + REG)
def constant_baseline_metrics(spark, d):
    rows = _predicted(spark, d)
    return metrics.regression(metrics.constant_baseline(rows, rows))


@query("tied_ranks", CLASS + "SELECT game_id, p, count(*) AS n, avg(i) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY p) AS i FROM pr) GROUP BY ALL")
def tied_ranks(spark, d):
    return metrics.tied_ranks(_predicted(spark, d, "pass"))


@query(
    "classification_metrics",
    CLASS + f""", rk AS (SELECT *, avg(i) OVER (PARTITION BY game_id, p) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY p) AS i FROM pr)),
    q AS (SELECT *, least(1 - 1e-9, greatest(1e-9, p)) AS q FROM rk)
    SELECT game_id, count(*) AS n, {r('avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)', 6)} AS accuracy,
      {r('(sum(CASE WHEN y = 1 THEN rank ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))::DOUBLE', 6)} AS auc,
      {r('avg(-(y * ln(q) + (1 - y) * ln(1 - q)))', 6)} AS log_loss,
      count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn,
      count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM q GROUP BY 1""",
)
def classification_metrics(spark, d):
    return metrics.classification(_predicted(spark, d, "pass"))


@query(
    "roc_curve",
    CLASS + f""", sw AS (SELECT game_id, row_number() OVER w AS i, sum(y) OVER w AS tp, sum(1 - y) OVER w AS fp, sum(y) OVER (PARTITION BY game_id) AS pp,
        count(*) OVER (PARTITION BY game_id) AS n FROM pr WINDOW w AS (PARTITION BY game_id ORDER BY p DESC, id))
    SELECT game_id, i, {r('(fp / (n - pp))::DOUBLE', 6)} AS fpr, {r('(tp / pp)::DOUBLE', 6)} AS tpr FROM sw WHERE i % greatest(1, (n + 1) // 40) = 0 OR i = n
    UNION ALL SELECT DISTINCT game_id, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM pr""",
)
def roc_curve(spark, d):
    return metrics.roc(_predicted(spark, d, "pass"))
