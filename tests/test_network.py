import numpy as np
from pyspark.sql import functions as F

from playtrace.operators import bootstrap, network, sequences


def _central(steps, weight="probability"):
    return {r["state"]: r.asDict() for r in network.centrality(*network.model(steps, weight)).collect()}


def test_tied_shortest_paths_share_betweenness(make_steps):
    c = _central(make_steps({("g", "1"): "abd", ("g", "2"): "acd"}))
    assert c["b"]["betweenness"] == c["c"]["betweenness"] == 0.5
    assert c["a"]["betweenness"] == c["d"]["betweenness"] == 0
    assert c["a"]["out_strength"] == 1 and c["d"]["in_strength"] == 2
    # distances from a: b and c 2, d 3
    assert c["a"]["closeness"] == round((0.5 + 0.5 + 1 / 3) / 3, 4)


def test_page_rank_spreads_dangling_mass(make_steps):
    steps = make_steps({("g", "1"): "ab", ("g", "2"): "ab", ("h", "1"): "xyx"})
    ranks = {(r["game_id"], r["state"]): r["page_rank"] for r in network.page_rank(*network.model(steps)).collect()}
    a, b = 0.5, 0.5
    for _ in range(100):
        a, b = 0.075 + 0.85 * b / 2, 0.075 + 0.85 * (a + b / 2)
    assert abs(ranks["g", "a"] - a) < 1e-9 and abs(ranks["g", "b"] - b) < 1e-9
    assert abs(ranks["h", "x"] + ranks["h", "y"] - 1) < 1e-9


def test_probabilities_sum_to_one(make_steps):
    steps = make_steps({("g", "1"): "abcab", ("g", "2"): "bbca", ("g", "3"): "c"})
    nodes, edges = network.model(steps)
    assert all(abs(r["p"] - 1) < 1e-12 for r in edges.groupBy("src").agg(F.sum("probability").alias("p")).collect())
    assert abs(nodes.agg(F.sum("initial")).first()[0] - 1) < 1e-12


def test_long_chain_distances(make_steps):
    path = [f"n{i}" for i in range(12)]
    edges = network.edges(sequences.transitions(make_steps({("g", "1"): path})))
    d = {(r["src"], r["dst"]): r["d"] for r in network.distances(edges).collect()}
    assert len(d) == 66 and d["n0", "n11"] == 11


def _validated(steps, **kw):
    df = bootstrap.validate(sequences.transitions(steps), sequences.session_ends(steps), **kw)
    return {(r["src"], r["dst"]): r.asDict() for r in df.collect()}


def test_bootstrap_finds_the_rare_edge_unstable(make_steps):
    steps = make_steps({("g", f"s{i}"): "ab" for i in range(20)} | {("g", "rare"): "ac"})
    v = _validated(steps)
    assert v["a", "b"]["significant"] and v["a", "b"]["p_value"] == 0
    rare = v["a", "c"]
    assert not rare["significant"] and 0.2 < rare["p_value"] < 0.55  # expected (20/21)^21 = .36
    assert abs(rare["bootstrap_mean"] - 1 / 21) < 0.02 and rare["ci_lower"] == 0
    assert v == _validated(steps)
    assert v != _validated(steps, seed=7)


def test_bootstrap_replicates_draw_as_many_sessions(make_steps, monkeypatch):
    monkeypatch.setattr(bootstrap, "BUCKET_PROFILES", 2)  # many buckets
    steps = make_steps({("g", f"s{i}"): ["x", f"y{i}"] for i in range(12)})
    counts = bootstrap.replicate_counts(sequences.transitions(steps), sequences.session_ends(steps), 60)
    per = counts.groupBy("replicate").agg(F.sum("count").alias("n"), F.count("*").alias("kinds")).collect()
    assert len(per) == 60 and all(r["n"] == 12 for r in per)
    assert 6 < sum(r["kinds"] for r in per) / 60 < 9.3  # about 12 (1 - 1/e)


def test_bootstrap_does_not_depend_on_buckets(make_steps, monkeypatch):
    steps = make_steps({("g", f"s{i}"): ["x", f"y{i % 9}", f"z{i % 4}"] for i in range(150)} | {("h", "1"): "ab", ("h", "2"): "a"})
    tr, ends = sequences.transitions(steps), sequences.session_ends(steps)
    whole = sorted(map(tuple, bootstrap.replicate_counts(tr, ends, 50).collect()))
    monkeypatch.setattr(bootstrap, "BUCKET_PROFILES", 3)
    monkeypatch.setattr(bootstrap, "THROWN", 7)
    assert whole == sorted(map(tuple, bootstrap.replicate_counts(tr, ends, 50).collect()))
    first = {}
    for game, replicate, src, _, n in whole:
        first[game, replicate, src] = first.get((game, replicate, src), 0) + n
    assert all(first["g", i, "x"] == 150 for i in range(50))
    assert all(first.get(("h", i, "a"), 0) <= 2 for i in range(50))  # a session of one step is drawn too
    assert any(("h", i, "a") not in first for i in range(50))


def test_bootstrap_counts_follow_the_binomial(make_steps):
    steps = make_steps({("g", f"s{i}"): "ab" if i < 360 else "cd" for i in range(400)})
    counts = bootstrap.replicate_counts(sequences.transitions(steps), sequences.session_ends(steps), 600)
    n = np.array([r["count"] for r in counts.where("src = 'a'").collect()])
    assert len(n) == 600
    assert abs(n.mean() - 360) < 4 * 6 / 600**0.5 and abs(n.std() - 6) < 0.8  # B(400, .9): deviation 6


def test_poisson_table_is_the_distribution():
    for mean in (0.3, 5.0, 2_000.0, 4e6):
        low, below = bootstrap._poisson(mean)
        p = np.diff(below, prepend=0.0)
        k = low + np.arange(len(p))
        assert abs(below[-1] - 1) < 1e-6
        assert abs((p * k).sum() / mean - 1) < 1e-5 and abs((p * (k - mean) ** 2).sum() / mean - 1) < 1e-3
    assert bootstrap._poisson(0.0)[0] == 0


def test_bootstrap_needs_three_sessions(make_steps):
    assert not _validated(make_steps({("g", "1"): "ab", ("g", "2"): "ab"}))


def test_bootstrap_settings():
    assert bootstrap.settings(None, None) == (300, 0.05)
    assert bootstrap.settings(10, 2) == (50, 0.05) and bootstrap.settings(9999, 0.1) == (2000, 0.1)
