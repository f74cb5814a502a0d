"""Sequence, process-mining and transition-network queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from playtrace.functions.scalars import round_half_up
from playtrace.operators import bootstrap, network, ordered, process, sequences
from playtrace.plans import tables as t
from playtrace.plans.registry import query, r, with_

SEQ = with_("ev", "paths")


@query("session_sequences", SEQ + "SELECT game_id, session_id, 0::BIGINT AS segment, path, length FROM paths")
def session_sequences(spark, d):
    p = sequences.paths(t.steps(spark, d))
    return p.select("game_id", "session_id", "segment", F.array_join("path", sequences.SEP).alias("path"), F.size("path").cast("long").alias("length"))


@query(
    "session_sequences_in_segments",
    with_("ev") + "SELECT game_id, session_id, seq // 2 AS segment, string_agg(type, ' > ' ORDER BY seq) AS path, count(*) AS length FROM ev GROUP BY ALL",
)
def session_sequences_in_segments(spark, d):
    """Rows of at most two steps, so that most sessions go on in further rows."""
    p = sequences.paths(t.steps(spark, d), segment=2)
    return p.select("game_id", "session_id", "segment", F.array_join("path", sequences.SEP).alias("path"), F.size("path").cast("long").alias("length"))


@query("chat_sequences", with_("chat") + "SELECT game_id, session_id, string_agg(type, ' > ' ORDER BY seq) AS path FROM chat GROUP BY ALL")
def chat_sequences(spark, d):
    p = sequences.paths(sequences.steps(t.chat(spark, d)))
    return p.select("game_id", "session_id", F.array_join("path", sequences.SEP).alias("path"))


@query(
    "sequence_page",
    SEQ + """, o AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY session_id) - 1 AS i, count(*) OVER (PARTITION BY game_id) AS total FROM paths)
    SELECT game_id, i, session_id, length, path, length > 60 AS clipped, total FROM o WHERE i >= 56 AND i < 84""",
)
def sequence_page(spark, d):
    return sequences.page(t.steps(spark, d), offset=56, limit=28)


@query(
    "sequence_last_page",
    SEQ + """, o AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY session_id) - 1 AS i, count(*) OVER (PARTITION BY game_id) AS total FROM paths)
    SELECT game_id, i, session_id, length, path, length > 60 AS clipped, total FROM o WHERE i >= total - 28""",
)
def sequence_last_page(spark, d):
    return sequences.page(t.steps(spark, d), offset=10**12, limit=28)


@query("usable_sessions", SEQ + "SELECT game_id, count(*) FILTER (WHERE length >= 2) AS usable, count(*) AS total FROM paths GROUP BY 1")
def usable_sessions(spark, d):
    ends = sequences.session_ends(t.steps(spark, d))
    return ends.groupBy("game_id").agg(F.count_if(F.col("length") >= 2).alias("usable"), F.count("*").alias("total"))


@query(
    "null_activity_reads_unknown",
    "WITH x AS (SELECT CASE WHEN event_type = 'error' THEN '?' ELSE event_type END AS type FROM events) "
    'SELECT type, count(*) AS "count" FROM x GROUP BY 1',
)
def null_activity_reads_unknown(spark, d):
    ev = t.events(spark, d).withColumn("type", F.nullif("type", F.lit("error")))
    return ev.groupBy(sequences.activity().alias("type")).agg(F.count("*").alias("count"))


@query(
    "activity_frequency",
    with_("ev") + 'SELECT game_id, type, count(*) AS "count", count(*) / sum(count(*)) OVER (PARTITION BY game_id) AS share FROM ev GROUP BY game_id, type',
)
def activity_frequency(spark, d):
    return process.activity_frequency(t.steps(spark, d))


@query("directly_follows", with_("ev", "tr") + 'SELECT game_id, src, dst, count(*) AS "count" FROM tr GROUP BY ALL')
def directly_follows(spark, d):
    return process.directly_follows(t.steps(spark, d))


def _top(inner: str, part: str, order: str, k: int, cols: str) -> str:
    return f"SELECT {cols}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS INTEGER) AS rank FROM ({inner})) WHERE rank <= {k}"


@query(
    "top_transitions",
    with_("ev", "tr") + _top('SELECT game_id, src, dst, count(*) AS "count" FROM tr GROUP BY ALL', "game_id", '"count" DESC, src, dst', 14, 'game_id, src, dst, "count"'),
)
def top_transitions(spark, d):
    return process.top_transitions(t.steps(spark, d))


ENDS = """, se AS (SELECT game_id, session_id, arg_min(type, seq) AS first_type, arg_max(type, seq) AS last_type, count(*) AS length FROM ev GROUP BY ALL) """


@query("session_ends", with_("ev") + ENDS + "SELECT * FROM se")
def session_ends(spark, d):
    return sequences.session_ends(t.steps(spark, d))


@query(
    "start_end_activities",
    with_("ev") + ENDS + _top(
        """SELECT game_id, 'start' AS "end", first_type AS type, count(*) AS "count" FROM se GROUP BY ALL
           UNION ALL SELECT game_id, 'end', last_type, count(*) FROM se GROUP BY ALL""",
        'game_id, "end"', '"count" DESC, type', 8, 'game_id, "end", type, "count"'),
)
def start_end_activities(spark, d):
    return process.end_activities(t.steps(spark, d))


@query(
    "self_loop_rate",
    with_("ev", "tr") + f"""SELECT game_id, count(*) FILTER (WHERE src = dst) AS self_loops, count(*) AS transitions,
      {r("(count(*) FILTER (WHERE src = dst))::DOUBLE / count(*)", 3)} AS rate FROM tr GROUP BY 1""",
)
def self_loop_rate(spark, d):
    return process.self_loop_rate(t.steps(spark, d))


GRAMS = with_("ev") + """, ld AS (SELECT game_id, type AS a, lead(type, 1) OVER w AS b, lead(type, 2) OVER w AS c, lead(type, 3) OVER w AS e
      FROM ev WINDOW w AS (PARTITION BY game_id, session_id ORDER BY seq)),
    gr AS (SELECT game_id, 2 AS n, a || ' > ' || b AS chain FROM ld WHERE b IS NOT NULL
      UNION ALL SELECT game_id, 3, a || ' > ' || b || ' > ' || c FROM ld WHERE c IS NOT NULL
      UNION ALL SELECT game_id, 4, a || ' > ' || b || ' > ' || c || ' > ' || e FROM ld WHERE e IS NOT NULL) """


@query("top_chains", GRAMS + _top('SELECT game_id, n, chain, count(*) AS "count" FROM gr GROUP BY ALL', "game_id, n", '"count" DESC, chain', 14, 'game_id, n, chain, "count"'))
def top_chains(spark, d):
    return process.top_chains(t.steps(spark, d))


@query("four_step_chains", GRAMS + 'SELECT game_id, n, chain, count(*) AS "count" FROM gr WHERE n = 4 GROUP BY ALL')
def four_step_chains(spark, d):
    return process.chains(t.steps(spark, d), 4)


# Folding as stated: remove the second copy of the first repeat, shortest block first, start over.
FOLD = """, fold AS (
  SELECT game_id, session_id, p, p AS raw FROM lists
  UNION ALL
  SELECT game_id, session_id, p[1:(k % 1000000) + k // 1000000 - 1] || p[(k % 1000000) + 2 * (k // 1000000):], raw FROM (
    SELECT *, list_min(list_filter(flatten(list_transform(range(1, 7), lambda l:
        list_transform(range(1, len(p) - 2 * l + 2), lambda i:
          CASE WHEN p[i:i + l - 1] = p[i + l:i + 2 * l - 1] THEN l * 1000000 + i END))), lambda x: x IS NOT NULL)) AS k FROM fold)
  WHERE k IS NOT NULL),
  folded AS (SELECT game_id, session_id, arg_min(p, len(p)) AS p, any_value(len(raw)) AS length FROM fold GROUP BY ALL) """
LISTS = ", lists AS (SELECT game_id, session_id, list(type ORDER BY seq) AS p FROM ev GROUP BY ALL)"
CHAT_LISTS = ", lists AS (SELECT game_id, session_id, list(type ORDER BY seq) AS p FROM chat GROUP BY ALL)"


@query("folded_paths", with_("ev") + LISTS + FOLD + "SELECT game_id, session_id, length, array_to_string(p, ' > ') AS path FROM folded")
def folded_paths(spark, d):
    f = process.folded_paths(t.steps(spark, d))
    return f.withColumn("path", F.array_join("path", sequences.SEP))


@query("chat_folded_paths", with_("chat") + CHAT_LISTS + FOLD + "SELECT game_id, session_id, length, array_to_string(p, ' > ') AS path FROM folded")
def chat_folded_paths(spark, d):
    f = process.folded_paths(sequences.steps(t.chat(spark, d)))
    return f.withColumn("path", F.array_join("path", sequences.SEP))


VARIANTS = """SELECT game_id, path, count(*) AS "count", count(*) / sum(count(*)) OVER (PARTITION BY game_id) AS coverage FROM {} GROUP BY game_id, path"""


@query(
    "trace_variants",
    with_("ev") + LISTS + FOLD + ", fp AS (SELECT game_id, array_to_string(p, ' > ') AS path FROM folded) "
    + _top(VARIANTS.format("fp"), "game_id", '"count" DESC, path', 12, 'game_id, path, "count", coverage'),
)
def trace_variants(spark, d):
    return process.variants(process.folded_paths(t.steps(spark, d)))


@query("unfolded_variants", SEQ + VARIANTS.format("paths"))
def unfolded_variants(spark, d):
    return process.raw_variants(t.steps(spark, d), None)


@query(
    "process_stats",
    with_("ev", "tr") + LISTS + FOLD + f"""SELECT s.game_id, sessions, events, variants, avg_steps, avg_events, self_loop_rate, distinct_activities
    FROM (SELECT game_id, count(*) AS sessions, count(DISTINCT p) AS variants, {r('avg(len(p))', 1)} AS avg_steps, {r('avg(length)', 1)} AS avg_events FROM folded GROUP BY 1) s
    JOIN (SELECT game_id, count(*) AS events, count(DISTINCT type) AS distinct_activities FROM ev GROUP BY 1) USING (game_id)
    JOIN (SELECT game_id, {r('avg(CASE WHEN src = dst THEN 1.0 ELSE 0.0 END)', 3)} AS self_loop_rate FROM tr GROUP BY 1) USING (game_id)""",
)
def process_stats(spark, d):
    steps = t.steps(spark, d)
    return process.stats(steps, process.folded_paths(steps))


# ---- transition networks ---------------------------------------------------------------

NETWORK = """, ed AS (SELECT game_id, src, dst, count(*) AS "count",
      count(*) / sum(count(*)) OVER (PARTITION BY game_id, src) AS probability FROM tr GROUP BY game_id, src, dst),
    nd AS (SELECT game_id, type AS state, count(*) AS frequency, count(*) FILTER (WHERE seq = 0) AS starts FROM ev GROUP BY ALL) """
NET = with_("ev", "tr") + NETWORK


@query("network_edges", NET + 'SELECT *, probability AS weight FROM ed')
def network_edges(spark, d):
    return network.edges(sequences.transitions(t.steps(spark, d)))


@query("network_edges_by_frequency", NET + 'SELECT *, "count"::DOUBLE AS weight FROM ed')
def network_edges_by_frequency(spark, d):
    return network.edges(sequences.transitions(t.steps(spark, d)), "frequency")


@query("network_strong_edges", NET + "SELECT game_id, src, dst, probability FROM ed WHERE probability >= 0.2")
def network_strong_edges(spark, d):
    e = network.edges(sequences.transitions(t.steps(spark, d)))
    return e.where(F.col("probability") >= 0.2).select("game_id", "src", "dst", "probability")


@query("network_nodes", NET + "SELECT game_id, state, frequency, starts, starts / sum(starts) OVER (PARTITION BY game_id) AS initial FROM nd")
def network_nodes(spark, d):
    return network.nodes(t.steps(spark, d))


@query(
    "network_stats",
    NET + """SELECT n.game_id, sessions, states, events, transitions, distinct_transitions, self_loops
    FROM (SELECT game_id, CAST(sum(starts) AS BIGINT) AS sessions, count(*) AS states, CAST(sum(frequency) AS BIGINT) AS events FROM nd GROUP BY 1) n
    JOIN (SELECT game_id, CAST(sum("count") AS BIGINT) AS transitions, count(*) AS distinct_transitions,
      CAST(sum(CASE WHEN src = dst THEN "count" ELSE 0 END) AS BIGINT) AS self_loops FROM ed GROUP BY 1) USING (game_id)""",
)
def network_stats(spark, d):
    return network.stats(*network.model(t.steps(spark, d)))


@query(
    "network_strengths",
    NET + f"""SELECT n.game_id, n.state, {r('coalesce(o, 0)')} AS out_strength, {r('coalesce(i, 0)')} AS in_strength FROM nd n
    LEFT JOIN (SELECT game_id, src AS state, sum(probability) AS o FROM ed GROUP BY ALL) USING (game_id, state)
    LEFT JOIN (SELECT game_id, dst AS state, sum(probability) AS i FROM ed GROUP BY ALL) USING (game_id, state)""",
)
def network_strengths(spark, d):
    s = network.strengths(*network.model(t.steps(spark, d)))
    return s.select("game_id", "state", *[round_half_up(c).alias(c) for c in ("out_strength", "in_strength")])


def _walks(weight: str) -> str:
    """All simple paths of the (small) network, the shortest ones, and how many pass each state."""
    return f""", walk AS (
      SELECT game_id, src AS s, dst AS v, 1.0::DOUBLE / {weight} AS d, [src, dst] AS seen FROM ed WHERE src <> dst
      UNION ALL
      SELECT w.game_id, w.s, e.dst, w.d + 1.0::DOUBLE / e.{weight}, list_append(w.seen, e.dst) FROM walk w
      JOIN ed e ON e.game_id = w.game_id AND e.src = w.v AND NOT list_contains(w.seen, e.dst)),
    best AS (SELECT game_id, s, v, min(d) AS d FROM walk GROUP BY ALL),
    short AS (SELECT w.*, count(*) OVER (PARTITION BY w.game_id, w.s, w.v) AS sigma FROM walk w JOIN best b USING (game_id, s, v) WHERE w.d <= b.d + 1e-12),
    via AS (SELECT game_id, unnest(seen[2:len(seen) - 1]) AS state, 1.0::DOUBLE / sigma AS x FROM short) """


@query("network_distances", NET + _walks("probability") + f"SELECT game_id, s AS src, v AS dst, {r('d', 6)} AS d FROM best")
def network_distances(spark, d):
    e = network.edges(sequences.transitions(t.steps(spark, d)))
    return network.distances(e).withColumn("d", round_half_up("d", 6))


PAGE_RANK = """, pr AS (
  SELECT 0 AS k, game_id, state, 1.0::DOUBLE / count(*) OVER (PARTITION BY game_id) AS r, count(*) OVER (PARTITION BY game_id) AS n FROM nd
  UNION ALL
  SELECT k + 1, game_id, state, (1 - 0.85::DOUBLE + 0.85::DOUBLE * loose) / n + 0.85::DOUBLE * flow, n FROM (
    SELECT any_value(p.k) AS k, q.game_id, q.state, any_value(q.n) AS n, sum(p.r * coalesce(e.probability, 0)) AS flow,
           sum(CASE WHEN o.src IS NULL THEN p.r ELSE 0 END) AS loose
    FROM pr p
    JOIN (SELECT game_id, state, count(*) OVER (PARTITION BY game_id) AS n FROM nd) q ON q.game_id = p.game_id
    LEFT JOIN ed e ON e.game_id = p.game_id AND e.src = p.state AND e.dst = q.state
    LEFT JOIN (SELECT DISTINCT game_id, src FROM ed) o ON o.game_id = p.game_id AND o.src = p.state
    WHERE p.k < 100 GROUP BY q.game_id, q.state)) """


def centrality_sql(weight: str) -> str:
    return _walks(weight) + PAGE_RANK + f"""SELECT n.game_id, n.state, {r('coalesce(o, 0)')} AS out_strength, {r('coalesce(i, 0)')} AS in_strength,
      {r('coalesce(b, 0)', 3)} AS betweenness, {r('coalesce(h, 0) / (count(*) OVER (PARTITION BY n.game_id) - 1)')} AS closeness, {r('pr.r')} AS page_rank FROM nd n
    LEFT JOIN (SELECT game_id, src AS state, sum({weight})::DOUBLE AS o FROM ed GROUP BY ALL) USING (game_id, state)
    LEFT JOIN (SELECT game_id, dst AS state, sum({weight})::DOUBLE AS i FROM ed GROUP BY ALL) USING (game_id, state)
    LEFT JOIN (SELECT game_id, s AS state, sum(1.0::DOUBLE / d) AS h FROM best GROUP BY ALL) USING (game_id, state)
    LEFT JOIN (SELECT game_id, state, sum(x) AS b FROM via GROUP BY ALL) USING (game_id, state)
    LEFT JOIN pr ON pr.game_id = n.game_id AND pr.state = n.state AND pr.k = 100"""


@query("network_centrality", NET + centrality_sql("probability"))
def network_centrality(spark, d):
    return network.centrality(*network.model(t.steps(spark, d)))


@query("network_centrality_by_frequency", NET + centrality_sql('"count"'))
def network_centrality_by_frequency(spark, d):
    return network.centrality(*network.model(t.steps(spark, d), "frequency"))


def mixed_sql(z: str, name: str) -> str:
    """bootstrap.mixed as columns, the last one called ``name``; 64-bit wrap-around by a remainder of 128-bit products."""
    wrap = f"% {1 << 64}::UHUGEINT"
    return f"""({z}) {wrap} AS {name}0, (xor({name}0, {name}0 >> 30) * {bootstrap.MIX1}::UHUGEINT) {wrap} AS {name}1,
      (xor({name}1, {name}1 >> 27) * {bootstrap.MIX2}::UHUGEINT) {wrap} AS {name}2, xor({name}2, {name}2 >> 31) AS {name}"""


def bootstrap_sql(weight: str, iterations: int, level: float, seed: int = 42) -> str:
    """The resample of operators/bootstrap.py, up to the weights ``w`` of every observed edge in every replicate."""
    offset, step, digits = f"{bootstrap.seed_offset(seed)}::UHUGEINT", f"{bootstrap.STEP}::UHUGEINT", bootstrap.KEY_BITS // 4
    lo, hi = math.floor(level / 2 * iterations), min(iterations - 1, math.ceil((1 - level / 2) * iterations) - 1)
    resampled = '"count"::DOUBLE' if weight == "frequency" else '"count" / sum("count") OVER (PARTITION BY game_id, replicate, src)'
    return NET + f""", one AS (SELECT game_id, session_id, src, dst, count(*) AS n FROM tr GROUP BY ALL),
  sets AS (SELECT game_id, session_id, string_agg(src || chr(31) || dst || chr(31) || n, chr(30) ORDER BY src, dst) AS edges FROM one GROUP BY ALL),
  prof AS (SELECT game_id, coalesce(edges, '') AS edges, count(*) AS weight, min(session_id) AS example,
    ('0x' || substr(md5(game_id || chr(30) || coalesce(edges, '')), 1, {digits}))::BIGINT AS key
    FROM (SELECT DISTINCT game_id, session_id FROM ev) LEFT JOIN sets USING (game_id, session_id) GROUP BY ALL),
  games AS (SELECT game_id, CAST(sum(weight) AS BIGINT) AS sessions, ('0x' || substr(md5(game_id), 1, {digits}))::UHUGEINT AS game_key FROM prof GROUP BY 1),
  laid AS (SELECT prof.*, sessions, sum(weight) OVER (PARTITION BY game_id ORDER BY key) - weight AS start FROM prof JOIN games USING (game_id)),
  means AS (SELECT DISTINCT game_id, weight, weight * (greatest(0, sessions - {bootstrap.SPARE} * sqrt(sessions)) / sessions) AS mean FROM laid),
  tbl AS (SELECT game_id, weight, k, sum(p) OVER (PARTITION BY game_id, weight ORDER BY k) AS below FROM (
    SELECT *, CASE WHEN mean = 0 THEN (k = 0)::INT ELSE exp(k * ln(mean) - mean - lgamma(k + 1.0)) END AS p FROM (
      SELECT *, unnest(range(greatest(0, floor(mean - 9 * sqrt(mean) - 20)::BIGINT), ceil(mean + 9 * sqrt(mean) + 20)::BIGINT + 1)) AS k FROM means))),
  inv AS (SELECT game_id, weight, 0.0::DOUBLE AS above, min(k) AS k FROM tbl GROUP BY 1, 2
    UNION ALL SELECT game_id, weight, max(below), k + 1 FROM tbl GROUP BY game_id, weight, k),
  reps AS (SELECT unnest(range({iterations})) AS replicate),
  luck AS (SELECT game_id, key, weight, replicate, {mixed_sql(f"key::UHUGEINT + {offset} + (replicate + 1)::UHUGEINT * {step}", "z")},
    (z >> 11)::DOUBLE / {1 << 53} AS u FROM prof, reps),
  pois AS (SELECT l.game_id, l.key, l.replicate, i.k AS times FROM (SELECT game_id, key, weight, replicate, u FROM luck) l
    ASOF JOIN (SELECT game_id, weight, above, max(k) AS k FROM inv GROUP BY 1, 2, 3) i ON l.game_id = i.game_id AND l.weight = i.weight AND l.u >= i.above),
  short AS (SELECT g.game_id, replicate, sessions, {mixed_sql(f"game_key + {offset} + (replicate + 1)::UHUGEINT * {step}", "s")},
    unnest(range(greatest(0, sessions - drawn))) AS j
    FROM (SELECT game_id, replicate, CAST(sum(times) AS BIGINT) AS drawn FROM pois GROUP BY 1, 2) JOIN games g USING (game_id)),
  thrown AS (SELECT game_id, replicate, {mixed_sql(f"s + (j + 1)::UHUGEINT * {step}", "z")},
    floor((z >> 11)::DOUBLE / {1 << 53} * sessions)::BIGINT AS place FROM short),
  extra AS (SELECT t.game_id, l.key, t.replicate, count(*) AS times FROM (SELECT game_id, replicate, place FROM thrown) t
    ASOF JOIN laid l ON t.game_id = l.game_id AND t.place >= l.start GROUP BY 1, 2, 3),
  times AS (SELECT game_id, key, replicate, CAST(sum(times) AS BIGINT) AS times FROM (FROM pois UNION ALL FROM extra) GROUP BY 1, 2, 3),
  resampled AS (SELECT *, {resampled} AS w FROM (
    SELECT t.game_id, t.replicate, o.src, o.dst, CAST(sum(times * o.n) AS BIGINT) AS "count" FROM times t JOIN prof p USING (game_id, key)
    JOIN one o ON o.game_id = p.game_id AND o.session_id = p.example WHERE times > 0 GROUP BY 1, 2, 3, 4)),
  judged AS (SELECT e.game_id, e.src, e.dst, {'any_value(e."count")::DOUBLE' if weight == "frequency" else "any_value(e.probability)"} AS weight,
    list_sort(list(coalesce(w, 0))) AS ws, count(w) AS present
    FROM ed e JOIN games g ON g.game_id = e.game_id AND sessions >= {bootstrap.MIN_SESSIONS}, reps
    LEFT JOIN resampled x ON x.game_id = e.game_id AND x.src = e.src AND x.dst = e.dst AND x.replicate = reps.replicate GROUP BY 1, 2, 3),
  boot AS (SELECT game_id, src, dst, {r('weight')} AS weight, {r('list_sum(ws) / ' + str(iterations))} AS bootstrap_mean,
    {r(f'ws[{lo + 1}]')} AS ci_lower, {r(f'ws[{hi + 1}]')} AS ci_upper, {r(f'({iterations} - present) / {iterations}')} AS p_value,
    ({iterations} - present) / {iterations} <= {level} AND ws[{lo + 1}] > 0 AS significant FROM judged)"""


@query("bootstrap_edges", bootstrap_sql("probability", *bootstrap.settings()) + " SELECT * FROM boot")
def bootstrap_edges(spark, d):
    steps = t.steps(spark, d)
    return bootstrap.table_order(bootstrap.validate(sequences.transitions(steps), sequences.session_ends(steps)))


@query(
    "bootstrap_summary",
    bootstrap_sql("frequency", *bootstrap.settings())
    + " SELECT game_id, count(*) FILTER (WHERE significant) AS significant, count(*) AS total FROM boot GROUP BY 1",
)
def bootstrap_summary(spark, d):
    steps = t.steps(spark, d)
    return bootstrap.summary(bootstrap.validate(sequences.transitions(steps), sequences.session_ends(steps), "frequency"))


@query(
    "centrality_sorted",
    NET + f"""SELECT game_id, state, {r('coalesce(o, 0)')} AS out_strength,
      CAST(row_number() OVER (PARTITION BY game_id ORDER BY {r('coalesce(o, 0)')} DESC NULLS LAST, state) AS BIGINT) AS place FROM nd
    LEFT JOIN (SELECT game_id, src AS state, sum("count")::DOUBLE AS o FROM ed GROUP BY ALL) USING (game_id, state)""",
)
def centrality_sorted(spark, d):
    s = network.strengths(*network.model(t.steps(spark, d), "frequency"))
    rounded = s.select("game_id", "state", round_half_up("out_strength").alias("out_strength"))
    return ordered.numbered(rounded, ["game_id"], [F.desc_nulls_last("out_strength"), "state"], "place")
