import itertools
import random
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrace.operators import explain, models, trees
from playtrace.operators.models import Settings

NAMES = ["signal", "noise", "flag"]
GROUPS = {"signal": "volume", "noise": "timing", "flag": "context"}


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(8)
    out = []
    for i in range(240):
        x = [round(rnd.random(), 2), rnd.random(), float(rnd.random() < 0.5)]
        out.append(("g", i, i % 7, "l", 3 * x[0] + (1 if x[2] else 0) + rnd.gauss(0, 0.05), x))
    for i in range(300, 345):  # another game with fewer features
        x = [float(rnd.randrange(5)), float(rnd.randrange(3))]
        out.append(("h", i, i % 7, "l", x[0] - x[1] + rnd.gauss(0, 0.3), x))
    return out


def frame(spark, data, passed=False):
    rows = [(*r[:4], float(r[4] > 2) if passed else r[4], r[5]) for r in data]
    return spark.createDataFrame(rows, "game_id string, id long, player_id long, level_name string, y double, x array<double>").repartition(3)


BOTH = {"g": NAMES, "h": ["signal", "noise"]}


@pytest.mark.parametrize("algorithm", models.ALGORITHMS)
@pytest.mark.parametrize("target", ["score", "pass"])
def test_shap_adds_up_and_finds_the_signal(spark, data, algorithm, target):
    rows = frame(spark, data, target == "pass")
    s = Settings(target=target, algorithm=algorithm, estimators=100 if algorithm == "forest" else 20).cleaned()
    fitted = models.fit(rows, BOTH, s)
    done, base = explain.explain(fitted, rows)
    bases = {r["game_id"]: r["base"] for r in base.collect()}
    got = done.collect()
    assert len(got) == len(data)
    assert max(abs(r["margin"] - bases[r["game_id"]] - sum(r["phi"])) for r in got) < 1e-6
    strength = {r["feature"]: r["mean_abs_shap"] for r in explain.importance(explain.long(done, BOTH, GROUPS)).where("game_id = 'g'").collect()}
    assert strength["signal"] > strength["flag"] > strength["noise"]
    if target == "pass":
        own = [r for r in got if r["game_id"] == "g"]
        assert all(-1e-9 <= r["p"] <= 1 + 1e-9 for r in got)
        assert sum((r["p"] >= 0.5) == (r["y"] == 1) for r in own) > 215
        probabilities = [r["base_probability"] for r in base.collect()]
        assert all(0 < p < 1 for p in probabilities)


class Grown:
    """A tree grown from sorted rows, one node after the other."""

    def __init__(self, x, g, h, depth, least, ridge):
        self.value, self.split = -g.sum() / (h.sum() + ridge), None
        worth = lambda k: g[k].sum() ** 2 / (h[k].sum() + ridge)
        best = 1e-12
        if depth and len(g) >= 2 * least:
            for f, low, high in ((f, a, b) for f in range(x.shape[1]) for a, b in itertools.pairwise(sorted(set(x[:, f])))):
                left = x[:, f] <= low
                if min(left.sum(), (~left).sum()) >= least and (gain := (worth(left) + worth(~left) - worth(left | ~left)) / 2) > best * (1 + 1e-9):
                    best, self.split = gain, (f, (low + high) / 2)
        if self.split:
            left = x[:, self.split[0]] <= self.split[1]
            self.left, self.right = (Grown(x[k], g[k], h[k], depth - 1, least, ridge) for k in (left, ~left))

    def predict(self, row):
        return self.value if not self.split else (self.left if row[self.split[0]] <= self.split[1] else self.right).predict(row)


@pytest.mark.parametrize("target", ["score", "pass"])
def test_boosting_equals_exact_greedy_trees(spark, data, target):
    s = Settings(target=target, estimators=23, max_depth=3).cleaned()
    rows = frame(spark, data, s.classify)
    got = {(r["game_id"], r["id"]): r["margin"] for r in models.score(models.fit(rows, BOTH, s), rows).collect()}
    for game in BOTH:
        own = [r for r in data if r[0] == game]
        x, y = np.array([r[5] for r in own]), np.array([float(r[4] > 2) if s.classify else r[4] for r in own])
        n, least = len(y), max(3, int(len(y) * 0.01 + 0.5))
        m = np.full(n, np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)) if s.classify else y.mean())
        for _ in range(s.estimators):
            p = 1 / (1 + np.exp(-m)) if s.classify else m
            tree = Grown(x, p - y, np.maximum(1e-6, p * (1 - p)) if s.classify else np.ones(n), 3, least, 1.0)
            m = m + s.learning_rate * np.array([tree.predict(r) for r in x])
        assert max(abs(got[game, r[1]] - v) for r, v in zip(own, m)) < 1e-6


def test_a_plain_tree_equals_exact_greedy_splits(spark, data):
    rows = frame(spark, data)
    got = {(r["game_id"], r["id"]): r["margin"] for r in models.score(models.fit(rows, BOTH, Settings(algorithm="tree").cleaned()), rows).collect()}
    for game in BOTH:
        own = [r for r in data if r[0] == game]
        x, y = np.array([r[5] for r in own]), np.array([r[4] for r in own])
        tree = Grown(x, -y, np.ones(len(y)), 6, max(3, int(len(y) * 0.02 + 0.5)), 1e-6)
        assert max(abs(got[game, r[1]] - tree.predict(v)) for r, v in zip(own, x)) < 1e-6


def test_models_do_not_depend_on_the_partitions(spark, data, monkeypatch):
    monkeypatch.setattr(trees, "FLUSH", 3)
    fits = []
    for parts, rows_of_a_task, games in ((1, 10**9, 200), (4, 50, 1)):
        monkeypatch.setattr(trees, "TASK_ROWS", rows_of_a_task)
        monkeypatch.setattr(trees, "GAMES", games)
        rows = frame(spark, data).repartition(parts)
        for algorithm in ("gbtree", "forest"):
            fitted = models.fit(rows, BOTH, Settings(algorithm=algorithm, estimators=20).cleaned())
            fits.append(sorted((r["game_id"], r["id"], round(r["p"], 6)) for r in models.score(fitted, rows).collect()))
    assert fits[0] == fits[2] and fits[1] == fits[3]


def test_more_values_than_bins(spark):
    rnd = random.Random(2)
    data = [("g", i, 0, "l", float(v > 0.3) + float(v > 0.8), [v]) for i, v in enumerate(rnd.random() for _ in range(3000))]
    rows = frame(spark, data)
    cuts = trees.edges(rows)["g"][0]
    assert trees.BINS < len(cuts) <= trees.BINS + 2
    fitted = models.fit(rows, {"g": ["signal"]}, Settings(algorithm="tree").cleaned())
    got = models.score(fitted, rows).collect()
    assert np.mean([abs(r["p"] - r["y"]) for r in got]) < 0.02
    tree = fitted.models["g"].trees[0]
    assert tree.cover[0] == 3000 and all(tree.cover[i] == tree.cover[2 * i + 1] + tree.cover[2 * i + 2] for i in np.flatnonzero(tree.feature >= 0))


def test_bootstrap_draws_are_poisson():
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for t in range(3):
        w = trees._draws(keys, t, 42)
        assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05
    assert abs(np.corrcoef(trees._draws(keys, 0, 42), trees._draws(keys, 1, 42))[0, 1]) < 0.03


def test_tree_shares_equal_the_shapley_definition(spark, data):
    rows = frame(spark, data[:240])
    fitted = models.fit(rows, BOTH, Settings(algorithm="tree", max_depth=4).cleaned())
    tree = fitted.models["g"].trees[0]

    def value(known, x, i=0):
        """Expected prediction when only some features are known."""
        f = tree.feature[i]
        if f < 0:
            return tree.value[i]
        left, right = 2 * i + 1, 2 * i + 2
        if f in known:
            return value(known, x, left if x[f] <= tree.threshold[i] else right)
        return sum(tree.cover[c] / tree.cover[i] * value(known, x, c) for c in (left, right))

    done, base = explain.explain(fitted, rows.where("id < 15"))
    assert abs(base.first()["base"] - value(set(), None)) < 1e-9
    for r in done.collect():
        for k in range(3):
            others = [j for j in range(3) if j != k]
            want = sum(
                factorial(len(c)) * factorial(2 - len(c)) / 6 * (value({*c, k}, r["x"]) - value(set(c), r["x"]))
                for size in range(3)
                for c in itertools.combinations(others, size)
            )
            assert abs(r["phi"][k] - want) < 1e-9


def test_ridge_equals_the_closed_form(spark, data):
    fitted = models.fit(frame(spark, data), BOTH, Settings(algorithm="linear", l2=0.3))
    for game in BOTH:
        x, y = (np.array([r[k] for r in data if r[0] == game]) for k in (5, 4))
        z = (x - x.mean(0)) / x.std(0)
        want = np.linalg.solve(z.T @ z / len(y) + 0.3 * np.eye(len(BOTH[game])), z.T @ (y - y.mean()) / len(y))
        assert np.allclose(fitted.models[game].weights, want, atol=1e-9) and abs(fitted.models[game].base - y.mean()) < 1e-9


def test_logistic_model_is_at_its_minimum(spark, data):
    s = Settings(target="pass", algorithm="linear", l2=0.1)
    fitted = models.fit(frame(spark, data, True), BOTH, s)
    for game in BOTH:
        x, y = np.array([r[5] for r in data if r[0] == game]), np.array([float(r[4] > 2) for r in data if r[0] == game])
        m = fitted.models[game]
        error = 1 / (1 + np.exp(-m.margin(x))) - y
        assert abs(error.mean()) < 1e-8
        assert np.allclose(((x - m.mean) / m.std).T @ error / len(y) + s.l2 * m.weights, 0, atol=1e-8)


def test_waterfall_and_exemplars(spark):
    names = [f"f{i}" for i in range(12)]
    phi = [float(i + 1) * (-1) ** i for i in range(12)]
    df = spark.createDataFrame([("g", 1, [0.0] * 12, phi, 5.0), ("g", 2, [0.0] * 12, phi, 1.0), ("g", 3, [0.0] * 12, phi, 9.0)], "game_id string, id long, x array<double>, phi array<double>, p double")
    base = spark.createDataFrame([("g", 2.0)], "game_id string, base double")
    steps = explain.waterfall(explain.long(df, {"g": names}, dict.fromkeys(names, "g")), base, df.where("id = 1")).orderBy("step").collect()
    assert len(steps) == 10 and steps[0]["feature"] == "f11" and steps[-1]["feature"] == "+ 3 other features"
    assert steps[-1]["to"] == 2 + sum(phi)
    kinds = {r["kind"]: r["id"] for r in explain.exemplars(df).collect()}
    assert kinds == {"lowest": 2, "typical": 1, "highest": 3}


def test_settings_are_kept_in_range():
    s = Settings(target="x", algorithm="?", groups=("volume", "no"), threshold=5, estimators=3, learning_rate=9, max_depth=50, l2=-1).cleaned()
    assert (s.target, s.algorithm, s.groups, s.threshold, s.estimators, s.learning_rate, s.max_depth, s.l2) == ("score", "gbtree", ("volume",), 0.6, 20, 0.1, 6, 0.1)
    assert Settings(algorithm="tree").cleaned().max_depth == 6 and Settings(algorithm="tree", max_depth=20).cleaned().max_depth == 10
    assert Settings(algorithm="forest").cleaned().max_depth == 5


def test_registered_queries_use_the_default_number_of_trees(monkeypatch):
    from playtrace.plans import model_queries, registry

    registry.load()
    used = []
    monkeypatch.setattr(model_queries, "_metrics", lambda spark, d, s: used.append(s.cleaned()))
    monkeypatch.setattr(model_queries, "_explained", lambda spark, d, s: used.append(s.cleaned()) or [None] * 4)
    monkeypatch.setattr(explain, "importance", lambda shap: None)
    monkeypatch.setattr(explain, "long", lambda *a: None)
    monkeypatch.setattr(registry, "ship", lambda spark: None)
    for name in ("gbtree_score_metrics", "gbtree_pass_metrics", "forest_stars_metrics", "shap_importance"):
        registry.QUERIES[name](None, None)
    assert [(s.algorithm, s.target, s.estimators) for s in used] == [("gbtree", "score", 150), ("gbtree", "pass", 150), ("forest", "stars", 150), ("gbtree", "score", 150)]


def test_cells_of_a_tree_hold_the_shares_of_all_its_leaves():
    """One table for a tree gives what its leaves give one by one, also on the cuts; a tree of too many cells has none."""
    rnd = np.random.default_rng(3)
    tree = trees.Tree.of_depth(4)
    for i in range(15):
        tree.feature[i], tree.threshold[i] = rnd.integers(0, 3), rnd.integers(0, 6)
    tree.cover[:] = 1
    for i in reversed(range(15)):
        tree.cover[i] = tree.cover[2 * i + 1] + tree.cover[2 * i + 2]
    tree.value[:] = rnd.normal(size=31)
    leaves, _ = explain.leaf_tables(tree, 0.5)
    columns = rnd.integers(-1, 8, size=(4, 500)).astype(float)
    one, other = np.zeros((4, 500)), np.zeros((4, 500))
    explain._by_leaf(columns, leaves, one)
    explain._by_cell(columns, explain._cell_table(tree, leaves, 10_000), other)
    assert np.allclose(one, other, atol=1e-12) and np.abs(one[:3]).max() > 0
    assert explain._cell_table(tree, leaves, 10) is None


def test_leaves_are_found_by_whole_columns(monkeypatch):
    rnd = np.random.default_rng(4)
    tree = trees.Tree.of_depth(6)
    inner = [0]
    for i in inner:
        tree.feature[i], tree.threshold[i] = rnd.integers(0, 3), rnd.normal()
        inner += [c for c in (2 * i + 1, 2 * i + 2) if c < 63 and rnd.random() < 0.8]
    columns = rnd.normal(size=(3, 400))
    want = []
    for row in columns.T:
        i = 0
        while tree.feature[i] >= 0:
            i = 2 * i + 1 + int(row[tree.feature[i]] > tree.threshold[i])
        want.append(i)
    for narrow in (0, 1, 2, 3):
        monkeypatch.setattr(trees, "NARROW", narrow)
        assert tree.leaf_of(columns, tree.threshold).tolist() == want


def test_waterfall_of_every_run_needs_no_exchange(spark):
    """All steps of a run are made within its row, so no task holds more than its batch."""
    names = [f"f{i:02}" for i in range(12)]
    phi = [float(i + 1) * (-1) ** i for i in range(12)]
    df = spark.createDataFrame([("g", i, [0.0] * 12, phi) for i in range(3)], "game_id string, id long, x array<double>, phi array<double>")
    base = spark.createDataFrame([("g", 2.0)], "game_id string, base double")
    found = explain.waterfall(explain.wide(df, {"g": names}, dict.fromkeys(names, "g")), F.broadcast(base))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    some = explain.waterfall(explain.long(df, {"g": names}, dict.fromkeys(names, "g")), base, df.where("id = 1"))
    rows = lambda d: sorted(tuple(r) for r in d.where("id = 1").collect())
    assert rows(found) == rows(some) and found.count() == 30
