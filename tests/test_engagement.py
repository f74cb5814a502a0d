import datetime as dt

from pyspark.sql import functions as F

from playtrace.functions import scalars as s
from playtrace.operators import engagement as g
from playtrace.operators import features, metrics, telemetry
from playtrace.operators.scope import Scope, in_scope, user_list


def _events(spark, rows):
    """(player, session, day offset, t_ms)"""
    day = dt.datetime(2024, 1, 1)
    data = [("g", p, ss, i, t, day + dt.timedelta(days=d), "a") for i, (p, ss, d, t) in enumerate(rows)]
    return spark.createDataFrame(data, "game_id string, player_id long, session_id string, id long, t_ms long, created_at timestamp_ntz, type string")


def test_gini_and_lorenz(spark):
    even = _events(spark, [(p, "s", 0, 0) for p in range(4)])
    skewed = _events(spark, [(p, "s", 0, 0) for p in [0, 1, 2] + [3] * 97])
    assert g.gini(even).first()["gini"] == 0 and g.gini(skewed).first()["gini"] == 0.72
    curve = [(r["p"], r["cum"]) for r in g.lorenz(skewed).orderBy("step").collect()]
    assert curve == [(0, 0), (0.25, 0.01), (0.5, 0.02), (0.75, 0.03), (1, 1)]


def test_retention_counts_long_spans_at_the_limit(spark):
    ev = _events(spark, [(1, "a", 0, 0), (2, "a", 5, 0), (3, "a", 0, 0), (3, "b", 3, 0), (4, "a", 0, 0), (4, "b", 70, 0)])
    r = {x["day"]: x["retained"] for x in g.retention(ev).collect()}
    assert len(r) == 61 and r[0] == 1 and r[1] == 0.5 and r[3] == 0.5 and r[4] == 0.25 and r[60] == 0.25


def test_events_without_session_or_time(spark):
    ev = _events(spark, [(1, None, 0, 0), (1, None, 0, 180000), (1, "s", 0, None)])
    st = {r["session_id"]: r["minutes"] for r in g.session_stats(ev).collect()}
    assert st == {None: 3.0, "s": None}
    hist = {r["bucket"]: r["value"] for r in g.session_length_histogram(ev).collect()}
    assert hist["2–5m"] == 1 and sum(hist.values()) == 1


def test_history_and_attempts(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("g", 1, "s", i, sc, day + dt.timedelta(days=d)) for i, (d, sc) in enumerate([(0, 1.0), (1, 3.0), (1, 5.0), (2, 7.0)])]
    runs = spark.createDataFrame(rows, "game_id string, player_id long, session_id string, id long, score double, created_at timestamp_ntz")
    h = {r["id"]: (r["prior_runs"], r["prior_avg"]) for r in features.history(runs).collect()}
    assert h == {0: (0, 4.0), 1: (1, 1.0), 2: (2, 2.0), 3: (3, 3.0)}
    assert {r["id"]: r["attempt"] for r in g.attempts(runs).collect()} == {0: 1, 1: 2, 2: 3, 3: 4}


def test_score_histogram_clamps(spark):
    runs = spark.createDataFrame([("g", v) for v in (-1.0, 0.05, 0.999, 1.0, 250.0)], "game_id string, score double")
    assert [r["value"] for r in g.score_histogram(runs).orderBy("i").collect()] == [2] + [0] * 8 + [3]


def test_scope(spark):
    ev = _events(spark, [(1, "s", 0, 0), (2, "s", 1, 0), (1, "s", 2, 0)])
    players = spark.createDataFrame([(1, "Ann"), (2, "bob")], "id long, username string")
    assert in_scope(ev, Scope("2024-01-01", "2024-01-02"), players).count() == 2
    assert in_scope(ev, Scope(users=("ANN",)), players).count() == 2
    assert in_scope(ev, Scope(type="b")).count() == 0
    assert user_list("a, B ,b,,A,c") == ["a", "B", "c"] and user_list(None) == []
    assert len(user_list(",".join(f"u{i}" for i in range(80)))) == 80
    assert Scope.last_days(0, dt.date(2024, 1, 9)) == Scope() and Scope.last_days(7, dt.date(2024, 1, 9)).start == "2024-01-02"


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first()["v"]
    lit = F.lit
    assert val(s.round_half_up(lit(-2.5), 4)) == -2.5 and val(s.js_round(lit(-2.5))) == -2 and val(s.js_round(lit(2.5))) == 3
    assert val(s.number_or(lit("oops"), 7)) == 7 and val(s.number_or(lit(" "), 7)) == 0 and val(s.number_or(lit("1e3"), 7)) == 1000
    assert val(s.outcome_number(lit(""))) is None and val(s.outcome_int(lit("2.5"))) == 3 and val(s.outcome_text(lit("  x "))) == "x"
    assert val(s.epoch_ms(lit("1700000000"))) == 1700000000000 and val(s.epoch_ms(lit("1700000000123"))) == 1700000000123
    assert val(s.epoch_ms(lit("2024-01-02T03:04:05.678Z"))) == 1704164645678 and val(s.epoch_ms(lit("1/2/2024"))) == 1704153600000
    for text in ("1/2/2024 3:04 PM", "Tue, 02 Jan 2024 15:04:00 GMT", "January 2, 2024 3:04 PM", "Jan 2, 2024 3:04 pm", "02-Jan-2024 15:04"):
        assert val(s.epoch_ms(lit(text))) == 1704207840000, text
    assert val(s.epoch_ms(lit("nope"))) is None and val(s.epoch_ms(lit("12:30"))) is None
    assert val(s.safe_name(lit(" _a b!_"))) == "a_b" and val(s.safe_name(lit("!!"))) == "anon" and len(val(s.safe_name(lit("x" * 99)))) == 99
    assert val(s.title_case(lit("solve_puzzle-two"))) == "Solve Puzzle Two" and val(s.number_prefix(lit("3a"))) == 3
    assert val(s.is_slug(lit("my-study"))) and not val(s.is_slug(lit("admin"))) and not val(s.is_slug(lit("-x")))
    assert val(s.slug_from_filename(lit("My Log (1).csv"))) == "my-log-1"


def test_auc_with_ties_and_one_class(spark):
    rows = [("g", 0.5, 1), ("g", 0.5, 0), ("g", 0.9, 1), ("g", 0.1, 0), ("g", 0.5, 1), ("h", 0.4, 1)]
    df = spark.createDataFrame(rows, "game_id string, p double, y int")
    a = {r["game_id"]: r["auc"] for r in metrics.auc(df).collect()}
    pos, neg = [0.5, 0.9, 0.5], [0.5, 0.1]
    assert abs(a["g"] - sum((x > y) + (x == y) / 2 for x in pos for y in neg) / 6) < 1e-6 and a["h"] is None


def test_taps_in_both_shapes_and_broken_payloads(spark):
    rows = [("hit", '{"x":0.99,"y":1.5,"reaction_ms":300,"n":2}'), ("hit", '{"payload":{"x":0,"y":0,"reaction_ms":"-5"}}'), ("miss", "{broken"), ("expire", "{}"), ("hit", None), ("note", "{}")]
    ev = spark.createDataFrame([("g", 1, t, p) for t, p in rows], "game_id string, player_id long, type string, payload string")
    t = telemetry.taps(ev)
    total = telemetry.totals(t).first()
    assert (total["hits"], total["misses"], total["expires"], total["avg_reaction"]) == (2, 0, 1, 300.0)
    cells = {(r["cx"], r["cy"]): r["hits"] for r in telemetry.heatmap(t).collect()}
    assert len(cells) == 160 and cells[15, 9] == 1 and cells[0, 0] == 1 and sum(cells.values()) == 2
