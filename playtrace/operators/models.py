"""Predicting a run's outcome from its behaviour: a model for each game, all games fitted together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.functions.scalars import finite, sigmoid
from playtrace.operators import features, trees

# Allowed settings and their defaults.
ALGORITHMS = ("gbtree", "forest", "tree", "linear")
DEPTH_LIMIT = {"tree": 10}
DEPTH_DEFAULT = {"tree": 6, "forest": 5}
NEWTON_ROUNDS, SETTLED = 50, 1e-10


@dataclass(frozen=True)
class Settings:
    target: str = "score"
    algorithm: str = "gbtree"
    groups: tuple[str, ...] = features.GROUPS
    threshold: float = 0.6
    estimators: int = 150
    learning_rate: float = 0.1
    max_depth: int | None = None
    l2: float = 0.1
    seed: int = 42

    def cleaned(self) -> "Settings":
        """Unknown choices fall back to the defaults, numbers are kept in range."""
        target = self.target if self.target in features.TARGETS else "score"
        algorithm = self.algorithm if self.algorithm in ALGORITHMS else "gbtree"
        depth = self.max_depth or DEPTH_DEFAULT.get(algorithm, 3)
        return Settings(
            target,
            algorithm,
            tuple(g for g in self.groups if g in features.GROUPS) or features.GROUPS,
            self.threshold if 0 < self.threshold < 1 else 0.6,
            max(20, min(400, self.estimators or 150)),
            self.learning_rate if 0 < self.learning_rate <= 1 else 0.1,
            max(1, min(DEPTH_LIMIT.get(algorithm, 6), depth)),
            self.l2 if 0 <= self.l2 <= 100 else 0.1,
            self.seed,
        )

    @property
    def classify(self) -> bool:
        return self.target == "pass"


@dataclass
class Linear:
    """base + weights on standardised features."""

    base: float
    weights: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + (x - self.mean) / self.std @ self.weights


@dataclass
class Fitted:
    """The models of all games: trees.Ensemble or Linear, by game."""

    settings: Settings
    names: dict[str, list[str]]
    models: dict[str, object]

    @property
    def linear(self) -> bool:
        return self.settings.algorithm == "linear"

    @property
    def prob_space(self) -> bool:
        """A regression tree on 0/1 labels predicts the positive rate, a probability."""
        return self.settings.algorithm in ("forest", "tree")


def design_rows(design: DataFrame, steps: DataFrame, s: Settings) -> tuple[DataFrame, dict[str, list[str]], dict[str, str]]:
    """The usable rows of all games with their features as the array x; the features' names, by game; and their groups."""
    on = features.enabled_groups(s.target, s.groups)
    fixed = [(g, f) for g in features.GROUPS if g in on and g != "eventmix" for f in features.FEATURES[g]]
    before = [f for g, f in fixed if features.GROUPS.index(g) < features.GROUPS.index("eventmix")]
    after = [f for _, f in fixed if f not in before]
    group = {f: g for g, f in fixed}
    # a row for each game, of at most 12 activities
    types = features.top_types(steps).groupBy("game_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "type"))), lambda x: x["type"]).alias("vocabulary"))
    names = {}
    for game, vocabulary in ((r["game_id"], r["vocabulary"]) for r in types.collect()):
        shares = [f"share:{t}" for t in vocabulary] if "eventmix" in on else []
        names[game] = [*before, *shares, *after]
        group |= dict.fromkeys(shares, "eventmix")
    array = lambda fs: F.array(*[F.coalesce(finite(f), F.lit(0.0)) for f in fs]).cast("array<double>")
    shares = F.transform("vocabulary", lambda t: F.coalesce(F.try_element_at("mix", t), F.lit(0.0))) if "eventmix" in on else F.array().cast("array<double>")
    y = features.target_column(s.target, s.threshold)
    rows = design.join(types, "game_id").withColumn("y", y).where(F.col("y").isNotNull())
    return rows.select("game_id", "id", "player_id", "level_name", "y", F.concat(array(before), shares, array(after)).alias("x")), names, group


def fit(train: DataFrame, names: dict[str, list[str]], s: Settings) -> Fitted:
    """Train on rows with game_id, id, y and x, each game for itself, all in the same jobs."""
    if s.algorithm == "linear":
        return Fitted(s, names, _fit_linear(train, s))
    if s.algorithm == "gbtree":
        return Fitted(s, names, trees.boosted(train, s.classify, s.estimators, s.learning_rate, s.max_depth))
    return Fitted(s, names, trees.averaged(train, s.estimators if s.algorithm == "forest" else 1, s.max_depth, s.seed))


def _added(train: DataFrame, per_game) -> dict[str, np.ndarray]:
    """The sums over all rows of per_game(game, x, y), an array for the rows of a game; the sums of a game meet in one small group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            pdf = batch.to_pandas()
            for game, own in pdf.groupby("game_id", sort=True):
                part = per_game(game, np.stack(own["x"].to_list()).astype(float), own["y"].to_numpy(float))
                total[game] = total[game] + part if game in total else part
        for game, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([game]), pa.array([part.tolist()], pa.list_(pa.float64()))], ["game_id", "part"])

    cells = train.select("game_id", "y", "x").mapInArrow(run, "game_id string, part array<double>")
    sums = cells.select("game_id", F.posexplode("part").alias("i", "v")).groupBy("game_id", "i").agg(F.sum("v").alias("v"))
    out: dict[str, dict[int, float]] = {}
    for r in sums.collect():  # a few hundred numbers for each game
        out.setdefault(r["game_id"], {})[r["i"]] = r["v"]
    return {g: np.array([p[i] for i in range(len(p))]) for g, p in out.items()}


def _moments(game, x, y):
    """Sums of 1, x, y and of all their products."""
    z = np.column_stack([np.ones(len(y)), x, y])
    return (z.T @ z).ravel()


def _fit_linear(train: DataFrame, s: Settings) -> dict[str, Linear]:
    out = {}
    for game, m in _added(train, _moments).items():
        k = int(len(m) ** 0.5)
        m = m.reshape(k, k) / m[0]
        centred = m - np.outer(m[0], m[0])
        std = np.sqrt(np.maximum(np.diag(centred), 0))
        std = np.where(std > 1e-12 * np.maximum(1, np.abs(m[0])), std, 1.0)
        r = centred / np.outer(std, np.r_[std[:-1], 1.0])
        a = r[1:-1, 1:-1] + s.l2 * np.eye(k - 2)  # ridge on standardised columns
        out[game] = Linear(m[0, -1], np.linalg.lstsq(a, r[1:-1, -1], rcond=None)[0], m[0, 1:-1], std[1:-1])
    return _newton(train, out, s.l2) if s.classify else out


def _newton(train: DataFrame, models: dict[str, Linear], l2: float) -> dict[str, Linear]:
    """Logistic models of least mean error plus l2 / 2 times the squared weights, by Newton steps; a job for a step of all games."""
    models = {g: Linear(float(np.log((m.base + 1e-6) / (1 - m.base + 1e-6))), np.zeros(len(m.weights)), m.mean, m.std) for g, m in models.items()}
    for _ in range(NEWTON_ROUNDS):

        def slopes(game, x, y, models=dict(models)):
            m = models[game]
            z = np.column_stack([np.ones(len(y)), (x - m.mean) / m.std])
            p = 1 / (1 + np.exp(-m.margin(x)))
            return np.concatenate([[len(y)], z.T @ (p - y), ((z.T * (p * (1 - p))) @ z).ravel()])

        moved = 0.0
        for game, sums in _added(train, slopes).items():
            m = models[game]
            k = len(m.weights) + 1
            penalty = l2 * np.r_[0.0, np.ones(k - 1)]
            w = np.r_[m.base, m.weights]
            step = np.linalg.lstsq(sums[1 + k :].reshape(k, k) / sums[0] + np.diag(penalty), sums[1 : 1 + k] / sums[0] + penalty * w, rcond=None)[0]
            moved = max(moved, float(np.abs(step).max()))
            models[game] = Linear(float(w[0] - step[0]), (w - step)[1:], m.mean, m.std)
        if moved < SETTLED:
            break
    return models


def score(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """Add ``margin`` and the prediction ``p`` of each row's own game."""
    shared = rows.sparkSession.sparkContext.broadcast(fitted.models)  # bounded by the settings, for each game

    @F.pandas_udf("double")
    def margin(game: pd.Series, x: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=game.index)
        for g, own in x.groupby(game):
            if g in shared.value:
                out[own.index] = shared.value[g].margin(np.stack(own.to_list()).astype(float))
        return out

    out = rows.withColumn("margin", margin("game_id", "x"))
    return out.withColumn("p", sigmoid("margin") if fitted.settings.classify and not fitted.prob_space else F.col("margin"))
