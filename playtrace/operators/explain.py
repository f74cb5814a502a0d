"""Exact SHAP explanations of every run, and the reports built on them.

For a leaf, only the features on its path matter, and only whether the run agrees with
the path on each of them. So the Shapley share of a leaf is a small table indexed by
that yes/no pattern. The tables are computed once from the trees. A tree's cuts divide the
values of its features into cells in which all runs have the same shares, so the leaves of a tree with few cells
are added up once for each cell; explaining a run is then one look-up per tree and feature, on whole Arrow batches.
"""

from __future__ import annotations

from math import factorial, prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.functions.scalars import round_half_up
from playtrace.operators import ordered
from playtrace.operators.models import Fitted, score
from playtrace.operators.trees import Tree

# Lengths of the reported lists.
BEESWARM_FEATURES = 12
WATERFALL_FEATURES = 9
TABLE_NUMBERS = 1 << 24  # in the cell tables of all trees together, which are broadcast


def _shares(z: np.ndarray) -> np.ndarray:
    """Shapley share of each path feature for every agreement pattern of a leaf worth 1."""
    d = len(z)
    agree = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1  # pattern x feature
    out = np.zeros((1 << d, d))
    for k in range(d):
        coef = np.zeros((1 << d, d))
        coef[:, 0] = 1.0
        for j in (j for j in range(d) if j != k):
            grown = coef * z[j]
            grown[:, 1:] += coef[:, :-1] * agree[:, [j]]
            coef = grown
        order = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
        out[:, k] = (agree[:, k] - z[k]) * (coef @ order)
    return out


def leaf_tables(tree: Tree, weight: float) -> tuple[list[tuple], float]:
    """Per leaf: path features, the interval each must lie in, and the share table; plus the expected value."""
    leaves, expected = [], 0.0
    stack = [(0, 1.0, {})]
    while stack:
        i, reach, path = stack.pop()
        f = int(tree.feature[i])
        if f < 0:
            value = weight * tree.value[i]
            expected += reach * value
            if path and value:
                feats = np.array(list(path))
                lo, hi, z = (np.array([path[f][j] for f in path], dtype=float) for j in range(3))
                leaves.append((feats, lo, hi, value * _shares(z)))
            continue
        cut = tree.threshold[i]
        for child, left in ((2 * i + 1, True), (2 * i + 2, False)):
            share = tree.cover[child] / tree.cover[i]
            lo, hi, z = path.get(f, (-np.inf, np.inf, 1.0))
            step = (lo, min(hi, cut), z * share) if left else (max(lo, cut), hi, z * share)
            stack.append((child, reach * share, {**path, f: step}))
    return leaves, expected


def _by_leaf(columns: np.ndarray, leaves: list[tuple], phi: np.ndarray) -> None:
    """Add the shares of every leaf; columns and phi have a row for each feature."""
    for feats, lo, hi, table in leaves:
        own = columns[feats]
        pattern = (1 << np.arange(len(feats))) @ ((own > lo[:, None]) & (own <= hi[:, None]))
        phi[feats] += table[pattern].T


def _cell_table(tree: Tree, leaves: list[tuple], most: int) -> tuple | None:
    """All leaves of a tree in one table over the cells that its cuts divide its features into; none if there are over ``most`` numbers in it."""
    inner = np.flatnonzero(tree.feature >= 0)
    feats = np.unique(tree.feature[inner])
    cuts = [np.unique(tree.threshold[inner][tree.feature[inner] == f]) for f in feats]
    sizes = [len(c) + 1 for c in cuts]
    if not leaves or prod(sizes) * len(feats) > most:
        return None
    at = np.indices(sizes).reshape(len(sizes), -1)
    points = np.zeros((int(feats.max()) + 1, at.shape[1]))
    points[feats] = [np.append(c, np.inf)[k] for c, k in zip(cuts, at)]  # the largest value of each cell
    phi = np.zeros(points.shape)
    _by_leaf(points, leaves, phi)
    strides = [prod(sizes[k + 1 :]) for k in range(len(sizes))]
    return feats, cuts, strides, phi[feats]


def _by_cell(columns: np.ndarray, cells: tuple, phi: np.ndarray) -> None:
    feats, cuts, strides, table = cells
    at = np.zeros(columns.shape[1], np.int32)
    for f, own, stride in zip(feats, cuts, strides):
        for cut in own:
            at += (columns[f] > cut) * np.int32(stride)
    for f, shares in zip(feats, table):
        phi[f] += shares[at]


def _tables(fitted: Fitted) -> dict[str, tuple[list[tuple], float]]:
    """For each game a table of cells or of leaves for each tree (none for a linear model), and the base value."""
    if fitted.linear:
        return {g: ([], m.base) for g, m in fitted.models.items()}
    trees = {g: [(t, *leaf_tables(t, m.weight)) for t in m.trees] for g, m in fitted.models.items()}
    most = min(1 << 15, TABLE_NUMBERS // max(1, sum(map(len, trees.values()))))
    tables = {g: [(_cell_table(t, leaves, most), leaves) for t, leaves, _ in own] for g, own in trees.items()}
    tables = {g: [(cells, None if cells else leaves) for cells, leaves in own] for g, own in tables.items()}
    return {g: (tables[g], fitted.models[g].base + sum(expected for _, _, expected in own)) for g, own in trees.items()}


def base_values(fitted: Fitted, spark) -> DataFrame:
    """(game_id, base, base_probability): what a model expects of a run it knows nothing of; the probability only for a yes/no target."""
    rows = []
    for game, model in sorted(fitted.models.items()):
        base = float(model.base) if fitted.linear else model.base + sum(leaf_tables(t, model.weight)[1] for t in model.trees)
        p = (base if fitted.prob_space else 1 / (1 + np.exp(-base))) if fitted.settings.classify else None
        rows.append((game, float(base), None if p is None else float(p)))
    return spark.createDataFrame(rows, "game_id string, base double, base_probability double")


def explain(fitted: Fitted, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with margin, prediction, feature values x and SHAP values phi; and the base value of each game."""
    scored = score(fitted, rows)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((fitted.models if fitted.linear else {}, _tables(fitted)))  # bounded by the settings, for each game

    @F.pandas_udf("array<double>")
    def shares(game: pd.Series, values: pd.Series) -> pd.Series:
        linear, tables = shared.value
        out = pd.Series([None] * len(game), index=game.index, dtype=object)
        for g, own in values.groupby(game):
            x = np.stack(own.to_list()).astype(float)
            if g in linear:
                phi = (x - linear[g].mean) / linear[g].std * linear[g].weights
            else:
                columns = np.ascontiguousarray(x.T)
                phi = np.zeros(columns.shape)
                for cells, leaves in tables[g][0]:
                    _by_cell(columns, cells, phi) if cells else _by_leaf(columns, leaves, phi)
                phi = np.ascontiguousarray(phi.T)
            out[own.index] = pd.Series(list(phi), index=own.index)
        return out

    return scored.withColumn("phi", shares("game_id", "x")), base_values(fitted, spark)


def wide(explained: DataFrame, names: dict[str, list[str]], groups: dict[str, str]) -> DataFrame:
    """One row per run with its features as the array ``cells`` of feature, grp, value and phi; names by game."""
    labels = [(g, [(n, groups[n]) for n in own]) for g, own in sorted(names.items())]
    labels = explained.sparkSession.createDataFrame(labels, "game_id string, f array<struct<feature: string, grp: string>>")  # a row for each game
    cells = F.transform(F.arrays_zip("f", "x", "phi"), lambda c: F.struct(c["f"]["feature"].alias("feature"), c["f"]["grp"].alias("grp"), c["x"].alias("value"), c["phi"].alias("phi")))
    return explained.join(F.broadcast(labels), "game_id").select("game_id", "id", cells.alias("cells"))


def long(explained: DataFrame, names: dict[str, list[str]], groups: dict[str, str]) -> DataFrame:
    """One row per run and feature; names by game."""
    return wide(explained, names, groups).select("game_id", "id", F.inline("cells"))


def importance(shap: DataFrame) -> DataFrame:
    """Mean absolute and mean signed SHAP value of every feature."""
    return shap.groupBy("game_id", "feature", "grp").agg(
        round_half_up(F.avg(F.abs("phi")), 5).alias("mean_abs_shap"), round_half_up(F.avg("phi"), 5).alias("mean_signed_shap")
    )


def beeswarm(shap: DataFrame) -> DataFrame:
    """SHAP value and scaled feature value of every run, for the strongest features."""
    top = ordered.top_k(importance(shap).where("mean_abs_shap > 0"), ["game_id"], [F.desc("mean_abs_shap"), "feature"], BEESWARM_FEATURES)
    span = shap.groupBy("game_id", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = span.join(top.select("game_id", "feature", "rank"), ["game_id", "feature"])
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return shap.join(span, ["game_id", "feature"]).select(
        "game_id", "rank", "feature", "id", round_half_up("phi", 5).alias("shap"), round_half_up((F.col("value") - F.col("lo")) / width, 4).alias("value_norm")
    )


def runs_table(explained: DataFrame, players: DataFrame) -> DataFrame:
    """Explained runs with player, actual, predicted and absolute error."""
    named = explained.join(players.select(F.col("id").alias("player_id"), "username"), "player_id")
    five = lambda c: F.transform(c, lambda v: round_half_up(v, 5))
    return named.select(
        "game_id", "id", "username", F.col("level_name").alias("level"), round_half_up("y", 5).alias("actual"),
        round_half_up("p", 5).alias("predicted"), round_half_up("margin", 5).alias("margin"), round_half_up(F.abs(F.col("p") - F.col("y")), 5).alias("error"),
        five("x").alias("values"), five("phi").alias("phi"),
    )


def exemplars(explained: DataFrame) -> DataFrame:
    """The runs with the lowest, middle and highest prediction of each game."""
    place = ordered.numbered(explained.select("game_id", "id", "p"), ["game_id"], ["p", "id"], "_rn")
    size = place.groupBy("game_id").agg(F.count("*").alias("n"))
    i = F.col("_rn") - 1
    middle = F.floor(F.col("n") / 2)
    kinds = F.array_compact(
        F.array(F.when(i == 0, "lowest"), F.when(i == middle, "typical"), F.when(F.col("_rn") == F.col("n"), "highest"))
    )
    return place.join(size, "game_id").select("game_id", "id", round_half_up("p", 5).alias("predicted"), F.explode(kinds).alias("kind"))


def waterfall(shap: DataFrame, base: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Steps from the base value to the margin of chosen runs, or of all: nine largest, then the rest together.

    shap comes from ``long`` or ``wide``; all steps of a run are made within its row.
    """
    if "cells" not in shap.columns:
        shap = shap.groupBy("game_id", "id").agg(F.collect_list(F.struct("feature", "phi")).alias("cells"))
    mine = shap if chosen is None else shap.join(chosen.select("game_id", "id").distinct(), ["game_id", "id"], "left_semi")
    ranked = F.array_sort(F.transform("cells", lambda c: F.struct((-F.abs(c["phi"])).alias("key"), c["feature"].alias("feature"), c["phi"].alias("phi"))))
    total = lambda cells: F.aggregate(cells, F.lit(0.0), lambda t, c: t + c["phi"])
    rows = mine.select("game_id", "id", ranked.alias("_r")).withColumn("_n", F.size("_r") - WATERFALL_FEATURES)
    rest = F.struct(
        F.lit(0.0).alias("key"),
        F.concat(F.lit("+ "), F.col("_n"), F.lit(" other features")).alias("feature"),
        total(F.slice("_r", WATERFALL_FEATURES + 1, F.greatest(F.lit(0), "_n"))).alias("phi"),
    )
    steps = F.concat(F.slice("_r", 1, WATERFALL_FEATURES), F.when(F.col("_n") > 0, F.array(rest)).otherwise(F.slice("_r", 1, 0)))
    upto = lambda c, i: F.struct((i + 1).alias("step"), c["feature"].alias("feature"), c["phi"].alias("phi"), total(F.slice("_s", 1, i + 1)).alias("upto"))
    folded = rows.select("game_id", "id", steps.alias("_s")).select("game_id", "id", F.inline(F.transform("_s", upto)))
    return folded.join(base, "game_id").select(
        "game_id", "id", "step", "feature", round_half_up("phi", 5).alias("phi"), round_half_up(F.col("base") + F.col("upto"), 5).alias("to")
    )
