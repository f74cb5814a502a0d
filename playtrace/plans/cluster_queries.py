"""Distance and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrace.functions.scalars import round_half_up
from playtrace.operators import clustering, distance, features, network, ordered, sequences
from playtrace.plans import tables as t
from playtrace.plans.registry import CTES, query, r, with_
from playtrace.plans.sequence_queries import NETWORK, centrality_sql

USABLE = with_("ev", "paths", "tr") + """, us AS (SELECT game_id, session_id, path FROM paths WHERE length >= 2),
    vec AS MATERIALIZED (SELECT game_id, session_id, 's:' || type AS feature, count(*) / sum(count(*)) OVER (PARTITION BY game_id, session_id) AS value
        FROM ev SEMI JOIN us USING (game_id, session_id) GROUP BY game_id, session_id, type
      UNION ALL SELECT game_id, session_id, 't:' || src || ' > ' || dst, count(*) / sum(count(*)) OVER (PARTITION BY game_id, session_id)
        FROM tr GROUP BY game_id, session_id, src, dst) """
# Profiles: sessions with equal vectors, named by the smallest of them.
PROFILES = """, vl AS MATERIALIZED (SELECT game_id, session_id, list({'f': feature, 'v': value} ORDER BY feature) AS v FROM vec GROUP BY ALL),
    pf AS MATERIALIZED (SELECT game_id, v, min(session_id) AS profile, count(*) AS weight FROM vl GROUP BY game_id, v),
    mem AS (SELECT game_id, session_id, profile FROM vl JOIN pf USING (game_id, v)),
    cell AS MATERIALIZED (SELECT vec.game_id, profile, weight, feature, value FROM vec JOIN pf ON pf.game_id = vec.game_id AND pf.profile = vec.session_id),
    fact AS MATERIALIZED (SELECT game_id, profile, weight, sum(value * value) AS n2 FROM cell GROUP BY ALL) """


def _dist(name: str, centres: str) -> str:
    """Squared distances of all profiles to the centres (game_id, run, cluster, feature, value)."""
    return f""", {name} AS MATERIALIZED (SELECT f.game_id, f.profile, f.weight, z.run, z.cluster, round(greatest(0, n2 - 2 * coalesce(dot, 0) + c2), 9) AS d FROM fact f
      JOIN (SELECT game_id, run, cluster, sum(value * value) AS c2 FROM {centres} GROUP BY ALL) z USING (game_id)
      LEFT JOIN (SELECT a.game_id, a.profile, c.run, c.cluster, sum(a.value * c.value) AS dot FROM cell a JOIN {centres} c USING (game_id, feature) GROUP BY ALL) q
        ON q.game_id = f.game_id AND q.profile = f.profile AND q.run = z.run AND q.cluster = z.cluster)"""


def _seeds_sql(k: int = 3, runs: int = clustering.RESTARTS, pairs: str | None = None) -> str:
    """Seeds drawn by weight, then by weight and squared distance to the nearest seed before; by the distances in pairs, if given."""
    key = lambda step, share: f"-ln((('0x' || substr(md5(profile || ':' || run || ':{step}'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE) / ({share})"
    first = lambda step, rows, share: f"SELECT game_id, run, {step} AS cluster, profile FROM {rows} WHERE {share} > 0 QUALIFY row_number() OVER (PARTITION BY game_id, run ORDER BY {key(step, share)}, profile) = 1"
    out = f", r0 AS (SELECT game_id, profile, weight, CAST(run AS INTEGER) AS run FROM fact, range({runs}) r(run)), sd0 AS MATERIALIZED ({first(0, 'r0', 'weight')})"
    for step in range(1, k):
        if pairs:
            out += f", sq{step} AS (SELECT p.game_id, p.profile, p.weight, s.run, p.d * p.d AS d FROM {pairs} p JOIN sd{step - 1} s ON s.game_id = p.game_id AND s.profile = p.other)"
        else:
            out += f", sc{step} AS MATERIALIZED (SELECT game_id, run, cluster, feature, value FROM cell JOIN sd{step - 1} USING (game_id, profile))" + _dist(f"sq{step}", f"sc{step}")
        before = f" UNION ALL SELECT game_id, profile, run, weight, d FROM sn{step - 1}" if step > 1 else ""
        out += f", sn{step} AS MATERIALIZED (SELECT game_id, profile, run, max(weight) AS weight, min(d) AS d FROM (SELECT game_id, profile, run, weight, d FROM sq{step}{before}) GROUP BY ALL)"
        out += f", sd{step} AS MATERIALIZED ({first(step, f'sn{step}', 'weight * d')})"
    return out + ", sx AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM sd{i}" for i in range(k)) + ")"


def _best(name: str, distances: str) -> str:
    return f", {name} AS MATERIALIZED (SELECT * FROM {distances} QUALIFY row_number() OVER (PARTITION BY game_id, profile, run ORDER BY d, cluster) = 1)"


def _mean(name: str, assigned: str) -> str:
    return f""", {name} AS MATERIALIZED (SELECT a.game_id, a.run, a.cluster, c.feature, sum(a.weight * c.value) / any_value(t.total) AS value FROM {assigned} a
      JOIN cell c ON c.game_id = a.game_id AND c.profile = a.profile
      JOIN (SELECT game_id, run, cluster, sum(weight) AS total FROM {assigned} GROUP BY ALL) t ON t.game_id = a.game_id AND t.run = a.run AND t.cluster = a.cluster GROUP BY ALL)"""


def _kmeans_sql(rounds: int = clustering.KMEANS_ROUNDS) -> str:
    out = USABLE + PROFILES + _seeds_sql() + ", c0 AS MATERIALIZED (SELECT game_id, run, cluster, feature, value FROM cell JOIN sx USING (game_id, profile))" + _dist("d0", "c0") + _best("a0", "d0")
    for i in range(1, rounds + 1):
        out += _mean(f"c{i}", f"a{i - 1}") + _dist(f"d{i}", f"c{i}") + _best(f"a{i}", f"d{i}")
    return out + f""", cost AS (SELECT game_id, run, round(sum(weight * d), 6) AS c FROM a{rounds} GROUP BY ALL),
    won AS (SELECT game_id, run FROM cost QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY c, run) = 1),
    fin AS MATERIALIZED (SELECT a.* FROM a{rounds} a JOIN won USING (game_id, run)),
    asg AS MATERIALIZED (SELECT game_id, session_id, cluster AS first_type, length FROM mem JOIN fin USING (game_id, profile) JOIN paths USING (game_id, session_id)) """


def _measures(name: str, points: str, point: str, centres: str, centre: str) -> str:
    """The four vector dissimilarities of points to the centres of their game."""
    return f""", {name} AS MATERIALIZED (SELECT x.game_id, x.{point}, c.{centre}, sqrt(greatest(0, x.n2 + c.n2 - 2 * coalesce(dot, 0))) AS euclidean, x.s + c.s - 2 * coalesce(low, 0) AS manhattan,
        1 - coalesce(dot, 0) / (sqrt(x.n2) * sqrt(c.n2)) AS cosine, sqrt(greatest(0, coalesce(js, 0) + 0.5 * ln(2) * (2 - coalesce(ps, 0) - coalesce(qs, 0))) / ln(2)) AS jensenshannon
      FROM (SELECT game_id, {point}, sum(value) AS s, sum(value * value) AS n2 FROM {points} GROUP BY ALL) x
      JOIN (SELECT game_id, {centre}, sum(value) AS s, sum(value * value) AS n2 FROM {centres} GROUP BY ALL) c USING (game_id)
      LEFT JOIN (SELECT a.game_id, a.{point}, b.{centre}, sum(a.value * b.value) AS dot, sum(least(a.value, b.value)) AS low, sum(a.value / 2) AS ps, sum(b.value / 2) AS qs,
          sum(0.5 * a.value / 2 * ln(a.value / ((a.value + b.value) / 2)) + 0.5 * b.value / 2 * ln(b.value / ((a.value + b.value) / 2))) AS js
        FROM {points} a JOIN {centres} b USING (game_id, feature) GROUP BY ALL) q
        ON q.game_id = x.game_id AND q.{point} = x.{point} AND q.{centre} = c.{centre})"""


# Step strings as profiles: equal ones are one, named by the smallest session.
TEXTS = """, enc AS MATERIALIZED (SELECT game_id, session_id, replace(replace(replace(replace(replace(replace(path, ' > ', ''), 'click', 'c'), 'purchase', 'p'), 'error', 'e'), 'signup', 's'), 'view', 'v') AS txt FROM us),
    fact AS MATERIALIZED (SELECT game_id, txt, min(session_id) AS profile, count(*) AS weight FROM enc GROUP BY game_id, txt),
    pr AS MATERIALIZED (SELECT x.game_id, x.profile, y.profile AS other, x.weight, levenshtein(x.txt, y.txt) / greatest(length(x.txt), length(y.txt)) AS exact, round(exact, 9) AS d
      FROM fact x JOIN fact y USING (game_id))"""


def _all_pairs(measure: str) -> str:
    """The distances of all profiles of a game; the twin may compare them all."""
    return PROFILES + ", oth AS (SELECT game_id, profile AS other, feature, value FROM cell)" + _measures("pm", "cell", "profile", "oth", "other") + f""",
      pr AS MATERIALIZED (SELECT n.game_id, n.profile, n.other, f.weight, greatest(0, {measure}) AS exact, round(greatest(0, {measure}), 9) AS d FROM pm n JOIN fact f ON f.game_id = n.game_id AND f.profile = n.profile)"""


def _medoids_sql(measure: str, rounds: int = clustering.MEDOID_ROUNDS) -> str:
    out = USABLE + (TEXTS if measure == "sequence" else _all_pairs(measure)) + _seeds_sql(3, 1, "pr") + ", m0 AS MATERIALIZED (SELECT game_id, cluster, profile FROM sx)"
    for i in range(rounds):
        out += f""", a{i} AS MATERIALIZED (SELECT p.game_id, p.profile, p.weight, m.cluster FROM pr p JOIN m{i} m ON m.game_id = p.game_id AND m.profile = p.other
          QUALIFY row_number() OVER (PARTITION BY p.game_id, p.profile ORDER BY p.d, m.cluster) = 1)"""
        out += f""", m{i + 1} AS MATERIALIZED (SELECT game_id, cluster, profile FROM (SELECT a.game_id, a.cluster, p.other AS profile, sum(p.weight * p.exact) / sum(p.weight) AS mean FROM a{i} a
            JOIN pr p ON p.game_id = a.game_id AND p.profile = a.profile JOIN a{i} b ON b.game_id = a.game_id AND b.cluster = a.cluster AND b.profile = p.other GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY game_id, cluster ORDER BY round(mean, 9), profile) = 1)"""
    last = rounds - 1
    return out + f""" SELECT a.game_id, a.cluster, m.profile AS medoid, CAST(sum(a.weight) AS BIGINT) AS size FROM a{last} a
      JOIN m{rounds} m ON m.game_id = a.game_id AND m.cluster = a.cluster GROUP BY ALL"""


# Mean squared distance of each session to the sessions of each cluster, from all pairs.
SILHOUETTE = f""", nrm AS MATERIALIZED (SELECT game_id, session_id, sum(value * value) AS n2 FROM vec GROUP BY ALL),
    prs AS (SELECT a.game_id, a.session_id AS a, b.session_id AS b, sum(a.value * b.value) AS dot FROM vec a JOIN vec b USING (game_id, feature) GROUP BY ALL),
    mn AS (SELECT x.game_id, x.session_id AS a, gx.first_type AS own, gy.first_type AS other, avg(greatest(0, x.n2 + y.n2 - 2 * coalesce(dot, 0))) AS d FROM nrm x
      JOIN nrm y ON y.game_id = x.game_id AND y.session_id <> x.session_id
      LEFT JOIN prs ON prs.game_id = x.game_id AND prs.a = x.session_id AND prs.b = y.session_id
      JOIN asg gx ON gx.game_id = x.game_id AND gx.session_id = x.session_id JOIN asg gy ON gy.game_id = y.game_id AND gy.session_id = y.session_id GROUP BY ALL),
    ab AS (SELECT game_id, a, min(d) FILTER (WHERE own = other) AS i, min(d) FILTER (WHERE own <> other) AS o FROM mn GROUP BY ALL),
    sil AS (SELECT game_id, {r('avg(CASE WHEN greatest(o, i) = 0 THEN 0 ELSE (o - i) / greatest(o, i) END)', 3)} AS silhouette FROM ab WHERE i IS NOT NULL AND o IS NOT NULL GROUP BY 1) """

BY_FIRST = with_("ev", "paths") + """, asg AS (SELECT game_id, session_id, arg_min(type, seq) AS first_type, count(*) AS length FROM ev GROUP BY ALL HAVING count(*) >= 2)"""


def _usable(spark, d):
    steps = t.steps(spark, d)
    return steps.join(distance.usable(steps).select("game_id", "session_id"), ["game_id", "session_id"], "left_semi")


def _by_first(spark, d):
    """A grouping SQL can repeat: the session's first activity."""
    ends = sequences.session_ends(t.steps(spark, d)).where(F.col("length") >= 2)
    return ends.select("game_id", "session_id", F.col("first_type").alias("cluster"))


@query(
    "behaviour_vectors",
    with_("ev", "paths", "tr") + f""", us AS (SELECT game_id, session_id FROM paths WHERE length >= 2)
    SELECT game_id, session_id, 's:' || type AS feature, {r('count(*) / sum(count(*)) OVER (PARTITION BY game_id, session_id)', 6)} AS value FROM ev SEMI JOIN us USING (game_id, session_id) GROUP BY game_id, session_id, type
    UNION ALL SELECT game_id, session_id, 't:' || src || ' > ' || dst, {r('count(*) / sum(count(*)) OVER (PARTITION BY game_id, session_id)', 6)} FROM tr GROUP BY game_id, session_id, src, dst""",
)
def behaviour_vectors(spark, d):
    return distance.vectors(_usable(spark, d)).withColumn("value", round_half_up("value", 6))


SAMPLED = 600


@query("sampled_sessions", USABLE + "SELECT game_id, session_id FROM us QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY md5(session_id || ':20240816'), session_id) <= 600")
def sampled_sessions(spark, d):
    """The sampling operator itself; nothing else works on its result."""
    return features.sample_sessions(distance.usable(t.steps(spark, d)).select("game_id", "session_id"), SAMPLED, 20240816)


MEASURES = ", ".join(f"{r(m, 5)} AS {m}" for m in distance.DISSIMILARITIES)


@query(
    "medoid_distances",
    USABLE + """, md AS (SELECT game_id, session_id AS medoid FROM us QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY md5(session_id), session_id) <= 3),
      mv AS MATERIALIZED (SELECT vec.game_id, medoid, feature, value FROM vec JOIN md ON md.game_id = vec.game_id AND md.medoid = vec.session_id),
      enc AS (SELECT game_id, session_id, replace(replace(replace(replace(replace(replace(path, ' > ', ''), 'click', 'c'), 'purchase', 'p'), 'error', 'e'), 'signup', 's'), 'view', 'v') AS txt FROM us)"""
    + _measures("dm", "vec", "session_id", "mv", "medoid")
    + f""", dd AS (SELECT dm.*, levenshtein(x.txt, y.txt) / greatest(length(x.txt), length(y.txt)) AS sequence FROM dm
      JOIN enc x ON x.game_id = dm.game_id AND x.session_id = dm.session_id JOIN enc y ON y.game_id = dm.game_id AND y.session_id = dm.medoid)
      SELECT game_id, session_id, medoid, {MEASURES} FROM dd""",
)
def medoid_distances(spark, d):
    usable = _usable(spark, d)
    ids = usable.select("game_id", "session_id").distinct().withColumn("_h", F.md5("session_id"))
    medoids = ordered.top_k(ids, ["game_id"], ["_h", "session_id"], 3).select("game_id", F.col("session_id").alias("medoid"))
    return distance.to_medoids(usable, medoids).withColumns({m: round_half_up(m, 5) for m in distance.DISSIMILARITIES})


@query(
    "silhouette_by_first_activity",
    USABLE + ", asg AS (SELECT game_id, session_id, str_split(path, ' > ')[1] AS first_type FROM us) " + SILHOUETTE + "SELECT * FROM sil",
)
def silhouette_by_first_activity(spark, d):
    return clustering.silhouette(distance.vectors(_usable(spark, d)), _by_first(spark, d))


@query("clustering_readiness", with_("ev", "paths") + "SELECT game_id, count(*) FILTER (WHERE length >= 2) AS usable, count(*) AS total, count(*) FILTER (WHERE length >= 2) >= 4 AS enough FROM paths GROUP BY 1")
def clustering_readiness(spark, d):
    return clustering.readiness(t.steps(spark, d))


PROFILE = f""", e AS (SELECT game_id, session_id, first_type AS c, type, lead(type) OVER (PARTITION BY game_id, session_id ORDER BY seq) AS nxt FROM ev JOIN asg USING (game_id, session_id)),
    sz AS (SELECT game_id, first_type AS c, count(*) AS size, sum(length) AS events FROM asg GROUP BY ALL),
    st AS (SELECT game_id, c, type, count(*) AS n, row_number() OVER (PARTITION BY game_id, c ORDER BY count(*) DESC, type) AS rk FROM e GROUP BY game_id, c, type)
    SELECT game_id, CAST(row_number() OVER (PARTITION BY game_id ORDER BY size DESC, c) AS INTEGER) AS label, size, size / sum(size) OVER (PARTITION BY game_id) AS share,
      states, transitions, distinct_transitions, self_loops, {r('events::DOUBLE / size', 1)} AS avg_len, top_states
    FROM sz JOIN (SELECT game_id, c, count(DISTINCT type) AS states, count(nxt) AS transitions, count(DISTINCT CASE WHEN nxt IS NOT NULL THEN type || '>' || nxt END) AS distinct_transitions,
        count(*) FILTER (WHERE type = nxt) AS self_loops FROM e GROUP BY ALL) USING (game_id, c)
    JOIN (SELECT game_id, c, string_agg(type, ', ' ORDER BY rk) AS top_states FROM st WHERE rk <= 4 GROUP BY ALL) USING (game_id, c)"""


@query("kmeans_profile", _kmeans_sql() + PROFILE)
def kmeans_profile(spark, d):
    usable = _usable(spark, d)
    return clustering.profile(usable, clustering.cluster(usable, "kmeans"))


@query("kmeans_sse", _kmeans_sql() + f"SELECT game_id, {r('sum(weight * d)', 3)} AS sse FROM fin GROUP BY 1")
def kmeans_sse(spark, d):
    return clustering.kmeans(distance.vectors(_usable(spark, d)))[1]


@query("kmeans_silhouette", _kmeans_sql() + SILHOUETTE + "SELECT * FROM sil")
def kmeans_silhouette(spark, d):
    long = distance.vectors(_usable(spark, d))
    return clustering.silhouette(long, clustering.kmeans(long)[0])


def _medoid_query(name: str, measure: str) -> None:
    def run(spark, d):
        usable = _usable(spark, d)
        assigned = clustering.edit_medoids(usable) if measure == "sequence" else clustering.k_medoids(distance.vectors(usable), measure)
        return assigned.groupBy("game_id", "cluster", "medoid").agg(F.count("*").alias("size"))

    query(name, _medoids_sql(measure))(run)


for _name, _measure in (("medoid_clusters", "jensenshannon"), ("medoid_clusters_manhattan", "manhattan"), ("medoid_clusters_cosine", "cosine"), ("medoid_clusters_sequence", "sequence")):
    _medoid_query(_name, _measure)


@query(
    "cluster_profile_by_first_activity",
    BY_FIRST + PROFILE,
)
def cluster_profile_by_first_activity(spark, d):
    return clustering.profile(_usable(spark, d), _by_first(spark, d))


@query(
    "cluster_edges_by_first_activity",
    BY_FIRST + """, e AS (SELECT game_id, session_id, first_type AS cluster, type AS src, lead(type) OVER (PARTITION BY game_id, session_id ORDER BY seq) AS dst FROM ev JOIN asg USING (game_id, session_id))
    SELECT game_id, cluster, src, dst, count(*) AS "count", count(*) / sum(count(*)) OVER (PARTITION BY game_id, cluster, src) AS probability
    FROM e WHERE dst IS NOT NULL GROUP BY game_id, cluster, src, dst""",
)
def cluster_edges_by_first_activity(spark, d):
    return clustering.networks(_usable(spark, d), _by_first(spark, d))[1].drop("weight")


@query(
    "cluster_sequences_by_first_activity",
    BY_FIRST + """SELECT game_id, cluster, rank, session_id, length, path FROM (SELECT p.game_id, first_type AS cluster, p.session_id, p.length, p.path,
      CAST(row_number() OVER (PARTITION BY p.game_id, first_type ORDER BY p.session_id) AS INTEGER) AS rank FROM asg JOIN paths p USING (game_id, session_id)) WHERE rank <= 24""",
)
def cluster_sequences_by_first_activity(spark, d):
    return clustering.sample_sequences(_usable(spark, d), _by_first(spark, d))


@query(
    "cluster_nodes_by_first_activity",
    BY_FIRST + """, st AS (SELECT game_id, first_type AS cluster, type AS state, count(*) AS frequency, count(*) FILTER (WHERE seq = 0) AS starts FROM ev JOIN asg USING (game_id, session_id) GROUP BY ALL)
    SELECT *, starts / sum(starts) OVER (PARTITION BY game_id, cluster) AS initial FROM st""",
)
def cluster_nodes_by_first_activity(spark, d):
    return clustering.networks(_usable(spark, d), _by_first(spark, d))[0]


@query(
    "cluster_centrality_by_first_activity",
    "SELECT split_part(game_id, '/', 1) AS game_id, split_part(game_id, '/', 2) AS cluster, * EXCLUDE (game_id) FROM (WITH RECURSIVE "
    + CTES["ev"].replace("ev AS", "ev0 AS", 1) + """, asg AS (SELECT session_id, arg_min(type, seq) AS first_type FROM ev0 GROUP BY ALL HAVING count(*) >= 2),
    ev AS (SELECT * REPLACE (game_id || '/' || first_type AS game_id) FROM ev0 JOIN asg USING (session_id)),
    """ + CTES["tr"] + NETWORK + centrality_sql("probability") + ")",
)
def cluster_centrality_by_first_activity(spark, d):
    nodes, edges = clustering.networks(_usable(spark, d), _by_first(spark, d))
    return network.centrality(nodes, edges, clustering.GROUP)
