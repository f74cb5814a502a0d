import hashlib
import math
import random
import time
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playtrace.operators import clustering, distance, medoids


@pytest.fixture(scope="module")
def two_groups(make_steps):
    return make_steps({("g", f"s{i}"): "ab" * (2 + i % 3) for i in range(10)} | {("g", f"t{i}"): "cd" * (2 + i % 3) + "c" for i in range(10)})


def _same_partition(assigned, expect):
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r["cluster"], set()).add(r["session_id"])
    return sorted(map(sorted, groups.values())) == sorted(map(sorted, expect))


@pytest.mark.parametrize("algorithm,measure", [("kmeans", ""), ("pam", "jensenshannon"), ("pam", "cosine"), ("pam", "euclidean"), ("pam", "manhattan"), ("pam", "sequence")])
def test_two_groups_are_found(two_groups, algorithm, measure):
    got = clustering.cluster(two_groups, algorithm, measure, 2)
    assert _same_partition(got, [[f"s{i}" for i in range(10)], [f"t{i}" for i in range(10)]])


def test_every_session_gets_a_cluster(make_steps):
    rnd = random.Random(3)
    sessions = {(g, f"s{i}"): "".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 9))) for g in "gh" for i in range(70)}
    steps = make_steps(sessions)
    for algorithm in ("kmeans", "pam"):
        got = [(r["game_id"], r["session_id"]) for r in clustering.cluster(steps, algorithm, "jensenshannon").collect()]
        assert sorted(got) == sorted(sessions)


def test_profile_of_clusters(two_groups):
    assigned = two_groups.select("game_id", "session_id").distinct().withColumn("cluster", F.substring("session_id", 1, 1))
    p = {r["top_states"]: r.asDict() for r in clustering.profile(two_groups, assigned).collect()}
    assert p["a, b"]["size"] == 10 and p["a, b"]["share"] == 0.5 and p["a, b"]["self_loops"] == 0 and p["c, d"]["states"] == 2
    assert len(clustering.sample_sequences(two_groups, assigned).collect()) == 20


def test_distances_to_medoids(make_steps, spark):
    steps = make_steps({("g", "a"): "aab", ("g", "b"): "aab", ("g", "c"): "cdcd", ("g", "d"): "abcd"})
    medoids = spark.createDataFrame([("g", "a")], "game_id string, medoid string")
    rows = {r["session_id"]: r.asDict() for r in distance.to_medoids(steps, medoids).collect()}
    assert len(rows) == 4
    assert all(abs(rows["b"][m]) < 1e-7 for m in distance.DISSIMILARITIES)
    far = rows["c"]
    assert abs(far["cosine"] - 1) < 1e-12 and abs(far["jensenshannon"] - 1) < 1e-12 and far["manhattan"] == 4 and far["sequence"] == 1
    assert rows["d"]["sequence"] == 0.75  # aab -> abcd: three edits of four


def test_edit_distance_compares_all_steps(make_steps, spark):
    steps = make_steps({("g", "a"): "ab" * 75 + "a" * 60, ("g", "b"): "ab" * 75 + "b" * 60})
    medoids = spark.createDataFrame([("g", "a")], "game_id string, medoid string")
    rows = {r["session_id"]: r["sequence"] for r in distance.to_medoids(steps, medoids).collect()}
    assert rows["a"] == 0 and rows["b"] > 0.2


def test_guards(make_steps, spark):
    steps = make_steps({("g", "1"): "ab", ("g", "2"): "ab", ("g", "3"): "ab", ("g", "4"): "a"})
    assert clustering.readiness(steps).first()["enough"] is False
    assert clustering.clamp_k(None) == 3 and clustering.clamp_k(1) == 2 and clustering.clamp_k(99) == 8


def test_silhouette_equals_its_definition(spark):
    rnd = random.Random(4)
    points = {f"s{i}": {f: rnd.random() for f in "xyz"} for i in range(12)}
    label = {s: 0 if i < 6 else 1 if i < 11 else 2 for i, s in enumerate(points)}  # the last is alone
    long = spark.createDataFrame([("g", s, f, v) for s, p in points.items() for f, v in p.items()], "game_id string, session_id string, feature string, value double")
    lab = spark.createDataFrame([("g", s, c) for s, c in label.items()], "game_id string, session_id string, cluster int")
    d2 = lambda a, b: sum((points[a][f] - points[b][f]) ** 2 for f in "xyz")
    widths = []
    for s in points:
        mean = {c: [d2(s, o) for o in points if o != s and label[o] == c] for c in range(3)}
        if mean[label[s]]:
            i = sum(mean[label[s]]) / len(mean[label[s]])
            o = min(sum(m) / len(m) for c, m in mean.items() if c != label[s])
            widths.append((o - i) / max(i, o))
    assert abs(clustering.silhouette(long, lab).first()["silhouette"] - sum(widths) / len(widths)) < 6e-4


def plain_seeds(points, k):
    """Names of k numbers, each drawn by the squared distance to the nearest before it."""
    chosen = []
    for step in range(k):
        share = {p: min((round((x - points[c]) ** 2, 9) for c in chosen), default=1.0) for p, x in points.items()}
        key = {p: -math.log((int(hashlib.md5(f"{p}:0:{step}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32) / s for p, s in share.items() if s > 0}
        chosen.append(min(key, key=lambda p: (key[p], p)))
    return chosen


def test_seeds_are_drawn_by_squared_distance(spark):
    """A far profile is nearly always the second seed, and as many seeds come as there are profiles."""
    points = {f"p{i}": float(i % 3) / 100 for i in range(9)} | {"far": 50.0}
    long = spark.createDataFrame([("g", p, "x", x + 1) for p, x in points.items()], "game_id string, session_id string, feature string, value double")
    _, cells, facts = clustering.profiles(long)
    squared = lambda seeds: clustering._distances(cells, facts, cells.join(seeds, ["game_id", "profile"]).select("game_id", "run", "cluster", "feature", "value"))
    seeds = clustering._seeds(facts, 3, 20, squared).collect()
    by = {run: [r["profile"] for r in sorted((x for x in seeds if x["run"] == run), key=lambda x: x["cluster"])] for run in range(20)}
    assert all("far" in own[:2] and len(set(own)) == 3 for own in by.values())
    assert {own[0] for own in by.values()} >= {"p0", "p1", "p2"}  # the first is drawn by weight
    assert len(clustering._seeds(facts, 8, 1, squared).collect()) == 4


def plain_clusters(points, k, rounds, medoids):
    """Clusters of numbers by the definition, and how many rounds moved something."""
    first = plain_seeds(points, k)
    centres, got = [points[p] for p in first], None
    for done in range(rounds):
        power = 1 if medoids else 2
        before, got = got, {p: min(range(k), key=lambda c: (round(abs(x - centres[c]) ** power, 9), c)) for p, x in points.items()}
        if got == before:
            break
        for c in range(k):
            own = [points[p] for p in points if got[p] == c]
            total = lambda p: sum(abs(points[p] - x) for x in own) / len(own)  # noqa: B023, E731
            centres[c] = points[min((round(total(p), 9), p) for p in points if got[p] == c)[1]] if medoids else sum(own) / len(own)
    return got, done


@pytest.mark.parametrize("medoids,tag,n", [(False, 0, 200), (True, 4, 150)])
def test_rounds_go_on_until_nothing_moves(spark, medoids, tag, n):
    assert (clustering.KMEANS_ROUNDS, clustering.MEDOID_ROUNDS) == (40, 50)
    points = {f"{tag}p{i}": float(i) for i in range(n)}
    want, done = plain_clusters(points, 8, 40, medoids)
    assert 20 < done < 39 and want != plain_clusters(points, 8, 20, medoids)[0]
    long = spark.createDataFrame([("g", p, "x", x) for p, x in points.items()], "game_id string, session_id string, feature string, value double").coalesce(1)
    got = clustering.k_medoids(long, "manhattan", 8) if medoids else clustering.kmeans(long, 8, restarts=1)[0]
    assert {r["session_id"]: r["cluster"] for r in got.collect()} == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def entropy_distance(a, b):
    p, q = ({f: v / sum(x.values()) for f, v in x.items()} for x in (a, b))
    mid = {f: (p.get(f, 0) + q.get(f, 0)) / 2 for f in p | q}
    part = lambda x: sum(v * math.log2(v / mid[f]) for f, v in x.items() if v)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


PLAIN = {
    "euclidean": lambda a, b: math.sqrt(sum((a.get(f, 0) - b.get(f, 0)) ** 2 for f in a | b)),
    "manhattan": lambda a, b: sum(abs(a.get(f, 0) - b.get(f, 0)) for f in a | b),
    "cosine": lambda a, b: 1 - sum(a[f] * b.get(f, 0) for f in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())),
    "jensenshannon": entropy_distance,
    "sequence": lambda a, b: edits(a, b) / max(len(a), len(b)),
}


@pytest.mark.parametrize("measure", list(PLAIN))
def test_medoids_have_the_least_total_distance(spark, monkeypatch, measure):
    """Against all pairs, in two clusters of very unequal size and with weights, in several steps; ties go to the first profile."""
    monkeypatch.setattr(medoids, "BATCH", 10)
    monkeypatch.setattr(medoids, "PIVOTS", 4)
    rnd = random.Random(measure)
    text = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12)))
    vector = lambda: {f: rnd.randint(1, 9) / 10 for f in rnd.sample("uvwxyz", rnd.randint(1, 4))}
    what = {f"p{i:03}": (i % 9 == 0, rnd.choice([1, 1, 2, 30]), text() if measure == "sequence" else vector()) for i in range(150)}
    rows = [("g", int(c), p, w, len(x) if measure == "sequence" else 0) for p, (c, w, x) in what.items()]
    members = spark.createDataFrame(rows, "game_id string, part int, profile string, weight long, len int")
    if measure == "sequence":
        cells, pairs = None, medoids.text_pairs(spark.createDataFrame([("g", p, x) for p, (_, _, x) in what.items()], "game_id string, profile string, text string"))
    else:
        cells = spark.createDataFrame([("g", p, f, v) for p, (_, _, x) in what.items() for f, v in x.items()], "game_id string, profile string, feature string, value double")
        pairs = medoids.vector_pairs(cells, measure)
    pivot = pairs(members.select("game_id", "part", "profile"), spark.createDataFrame([("g", 0, "p001"), ("g", 1, "p000")], "game_id string, part int, other string"))
    found = medoids.totals(members, pivot.join(members, ["game_id", "part", "profile"]), measure, pairs, cells)
    want = {}
    for part in (0, 1):
        own = {p: (w, x) for p, (c, w, x) in what.items() if int(c) == part}
        total = {p: sum(w * PLAIN[measure](x, y) for w, y in own.values()) for p, (_, x) in own.items()}
        all_ = sum(w for w, _ in own.values())
        want[part] = min((round(total[p] / all_, 9), p) for p in own)[1]
        for r in found.where(F.col("part") == part).collect():
            assert r["total"] is None or abs(r["total"] - total[r["profile"]]) < 1e-6
    assert {r["part"]: r["profile"] for r in medoids.best(found).collect()} == want


def test_few_members_are_compared_with_their_cluster(spark):
    """Bounds of pivots leave most members of a cluster out, and an empty table stays empty."""
    rnd = random.Random(8)
    n = 1500
    points = {f"p{i:04}": (rnd.gauss(5, 1), rnd.gauss(5, 1)) for i in range(n)}
    cells = spark.createDataFrame([("g", p, f, v) for p, x in points.items() for f, v in zip("xy", x)], "game_id string, profile string, feature string, value double")
    members = spark.createDataFrame([("g", 0, p, 1, 0) for p in points], "game_id string, part int, profile string, weight long, len int")
    pairs = medoids.vector_pairs(cells, "euclidean")
    far = pairs(members.select("game_id", "part", "profile"), members.limit(3).select("game_id", "part", F.col("profile").alias("other")))
    found = medoids.totals(members, far.join(members, ["game_id", "part", "profile"]), "euclidean", pairs, cells)
    total = {p: sum(math.dist(x, y) for y in points.values()) for p, x in points.items()}
    assert medoids.best(found).first()["profile"] == min(total, key=lambda p: (round(total[p] / n, 9), p))
    assert found.agg(F.sum("compared")).first()[0] < n * n / 4
    none = members.limit(0)
    assert medoids.best(medoids.totals(none, far.join(none, ["game_id", "part", "profile"]), "euclidean", pairs, cells)).isEmpty()


def test_edit_medoids_keep_every_session(make_steps):
    rnd = random.Random(5)
    sessions = {(g, f"s{i}"): "".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 9))) for g in "gh" for i in range(40)}
    rows = clustering.edit_medoids(make_steps(sessions), 3).collect()
    assert sorted((r["game_id"], r["session_id"]) for r in rows) == sorted(sessions)
    text = {(r["game_id"], r["medoid"]) for r in rows}
    for r in rows:  # everyone is with the nearest medoid of its game
        own = PLAIN["sequence"](sessions[r["game_id"], r["session_id"]], sessions[r["game_id"], r["medoid"]])
        assert own <= min(PLAIN["sequence"](sessions[r["game_id"], r["session_id"]], sessions[m]) for m in text if m[0] == r["game_id"]) + 1e-9


@pytest.mark.parametrize("measure", list(PLAIN))
def test_distances_are_computed_in_blocks(measure):
    """The arrays of a block against a chunk give every distance once, also of members and others of very unequal length."""
    rnd = random.Random(measure)
    if measure == "sequence":
        points = ["".join(rnd.choice("abc\U00010000") for _ in range(n)) for n in (1, 2, 3, 5, 8, 70, 300)]
        column, found = pa.array(points), medoids._edit_distances
    else:
        points = [{f: rnd.randint(1, 9) / 10 for f in rnd.sample("uvwxyz", n)} for n in (1, 2, 3, 4, 5, 6)]
        kind = pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64())]))
        column = pa.array([[{"feature": f, "value": v} for f, v in x.items()] for x in points], kind)
        found = partial(medoids._vector_distances, measure)
    got = list(found(column.slice(1), column))
    assert len(got) == len(points)
    for other, d in zip(points, got):
        assert [round(x, 7) for x in d] == [round(edits(x, other) if measure == "sequence" else PLAIN[measure](x, other), 7) for x in points[1:]]


def test_a_round_adds_up_blocks():
    """Two blocks give the sums, weights and moves that a plain loop over all members gives."""
    rnd = random.Random(9)
    kind = pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64())]))
    vectors = [{f: rnd.randint(1, 9) / 10 for f in rnd.sample("uvwxyz", rnd.randint(1, 4))} for _ in range(40)]
    weights = [rnd.randint(1, 5) for _ in vectors]
    column = lambda some: pa.array([[{"feature": f, "value": v} for f, v in x.items()] for x in some], kind)
    members = pa.StructArray.from_arrays(
        [column(vectors), pa.array(weights), pa.array([sum(v * v for v in x.values()) for x in vectors])], ["point", "weight", "n2"]
    )
    tables = [[(r, c, {f: rnd.random() for f in "uvwxyzq"}) for r in range(2) for c in range(3)] for _ in range(2)]
    centres = [pa.StructArray.from_arrays([pa.array([x[0] for x in t], pa.int32()), pa.array([x[1] for x in t], pa.int32()), column([x[2] for x in t])], ["run", "cluster", "point"]) for t in tables]
    got, want = {}, {}
    for a, b in ((0, 25), (25, 40)):
        for run, cluster, feature, s, moved in zip(*(c.to_pylist() for c in clustering._round(members.slice(a, b - a), *centres))):
            got[run, cluster, feature] = got.get((run, cluster, feature), 0) + s
            got["moved", run, cluster] = got.get(("moved", run, cluster), 0) + moved
    for x, w in zip(vectors, weights):
        for run in (0, 1):
            now, old = (min((PLAIN["euclidean"](x, v) ** 2, c) for r, c, v in t if r == run)[1] for t in tables)
            for f, v in [(None, 1), *x.items()]:
                want[run, now, f] = want.get((run, now, f), 0) + w * v
            want["moved", run] = want.get(("moved", run), 0) + (now != old)
    assert {k: round(v, 9) for k, v in got.items() if k[0] != "moved"} == {k: round(v, 9) for k, v in want.items() if k[0] != "moved"}
    for run in (0, 1):  # every cluster's row says how many of the block moved
        assert (max(v for k, v in got.items() if k[:2] == ("moved", run)) > 0) == (want["moved", run] > 0)


@pytest.mark.parametrize("kept", [1, 5_000, medoids.KEPT])
def test_edit_distances_by_bit_vectors(monkeypatch, kept):
    """Texts of no, one and several words of signs, in any order, with columns held and not held."""
    monkeypatch.setattr(medoids, "KEPT", kept)
    rnd = random.Random(kept)
    text = lambda: "".join(rnd.choice("ab\U00010000") for _ in range(rnd.choice([0, 1, 7, 8, 9, 16, 17, 63, 64, 65, 130])))
    members, others = [text() for _ in range(12)], [text() for _ in range(12)]
    for own in (members, ["", "a", "b"], [""]):
        got = medoids._edit_distances(pa.array(own), pa.array(others))
        assert [d.tolist() for d in got] == [[edits(x, other) for x in own] for other in others]


def test_edit_distances_cost_little():
    """A million distances of sessions of 100 steps: under 20 s by words of bits, over a minute cell by cell."""
    rnd = random.Random(6)
    texts = pa.array(["".join(rnd.choice("abcde") for _ in range(100)) for _ in range(2048)])
    started = time.process_time()
    assert len(list(medoids._edit_distances(texts, texts.slice(0, 512)))) == 512
    assert time.process_time() - started < 20


def test_one_part_is_many_tasks(spark):
    """The blocks and chunks of a single part are not compared in one task."""
    texts = spark.createDataFrame([("g", f"p{i}", f"{i:b}") for i in range(4000)], "game_id string, profile string, text string")
    members = texts.select("game_id", F.lit(0).alias("part"), "profile", F.lit(1).cast("long").alias("weight"), F.length("text").alias("len"))
    pairs = medoids.Pairs(texts.select("game_id", "profile", F.col("text").alias("point")), medoids._edit_distances, 250)
    others = members.select("game_id", "part", F.col("profile").alias("other"), F.col("len").alias("_len"))
    rows = pairs._run(pairs.blocks(members), pairs._chunks(others, ["_len"]), medoids._part_totals, "other string, _t double, _n long")
    assert rows.select(F.spark_partition_id().alias("t")).distinct().count() > 1
    assert rows.agg(F.sum("_n")).first()[0] == 4000 * 4000


def test_texts_are_searched_in_steps_too(spark, monkeypatch):
    """A cluster above the first step's size goes through bounds, a smaller one is compared whole; both find the same medoid."""
    monkeypatch.setattr(medoids, "BATCH", 10)
    monkeypatch.setattr(medoids, "PIVOTS", 4)
    rnd = random.Random(12)
    texts = {f"p{i:03}": "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for i in range(150)}
    members = spark.createDataFrame([("g", 0, p, 1 + i % 3, len(x)) for i, (p, x) in enumerate(texts.items())], "game_id string, part int, profile string, weight long, len int")
    pairs = medoids.text_pairs(spark.createDataFrame([("g", p, x) for p, x in texts.items()], "game_id string, profile string, text string"))
    near = pairs(members.select("game_id", "part", "profile"), spark.createDataFrame([("g", 0, "p001")], "game_id string, part int, other string"))
    near = near.join(members, ["game_id", "part", "profile"])
    whole = medoids.best(medoids.totals(members, near, "sequence", pairs)).first()
    pairs.first = 1
    assert medoids.best(medoids.totals(members, near, "sequence", pairs)).first() == whole


def test_all_dissimilarities_from_texts(monkeypatch, make_steps, spark):
    """Against the definitions, for several games with medoids of their own, in one batch cut into small pieces."""
    rnd = random.Random(15)
    sessions = {(g, f"s{i}"): "".join(rnd.choice("abcd" if g == "g" else "xyza") for _ in range(rnd.randint(1, 40))) for g in "gh" for i in range(30)}
    chosen = {"g": ["s3", "s4"], "h": ["s7"]}
    names = spark.createDataFrame([(g, s) for g, own in chosen.items() for s in own], "game_id string, medoid string")
    monkeypatch.setattr(distance, "STEPS", 50)
    got = {(r["game_id"], r["session_id"], r["medoid"]): r for r in distance.to_medoids(make_steps(sessions), names).collect()}
    assert set(got) == {(g, s, m) for g, s in sessions for m in chosen[g]}

    def vector(x):
        moves = [x[i : i + 2] for i in range(len(x) - 1)]
        return {a: x.count(a) / len(x) for a in x} | {a: moves.count(a) / len(moves) for a in moves}

    for (g, s, m), r in got.items():
        a, b = sessions[g, s], sessions[g, m]
        for measure, plain in PLAIN.items():
            want = plain(a, b) if measure == "sequence" else plain(vector(a), vector(b))
            assert abs(r[measure] - want) < 1e-7, (measure, a, b)


def test_medoid_distances_shuffle_sessions_not_features(make_steps, spark):
    """One row for each session goes through the plan: features are neither exploded nor joined."""
    steps = make_steps({("g", f"s{i}"): "ab" * (1 + i) for i in range(5)})
    found = distance.to_medoids(steps, spark.createDataFrame([("g", "s1")], "game_id string, medoid string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "feature" not in plan and len(found.collect()) == 5
