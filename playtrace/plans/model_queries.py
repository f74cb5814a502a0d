"""Model, explanation and report queries; a model for each game on all of its runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.functions.scalars import round_half_up
from playtrace.operators import explain, features, metrics, models
from playtrace.plans import tables as t
from playtrace.plans.registry import query, r, with_
from playtrace.session import durable


def _fitted(spark, d, settings: models.Settings):
    """The models of all games that have enough runs, the rows with their train mark, and the features' groups."""
    s = settings.cleaned()
    steps = t.steps(spark, d)
    runs = t.runs(spark, d)
    design = durable(features.design(runs, steps))
    ready = features.readiness(design, runs, s.target).where("enough").select("game_id")
    rows, names, groups = models.design_rows(design.join(ready, "game_id", "left_semi"), steps, s)
    split = durable(features.holdout(rows, s.seed))
    return models.fit(split.where("train"), names, s), split, groups


def _metrics(spark, d, settings):
    fitted, split, _ = _fitted(spark, d, settings)
    test = durable(models.score(fitted, split.where(~F.col("train"))))
    base = metrics.constant_baseline(split.where("train"), test)
    measure = metrics.classification if settings.classify else metrics.regression
    return measure(test).withColumn("model", F.lit(settings.algorithm)).unionByName(measure(base).withColumn("model", F.lit("constant")))


def _explained(spark, d, settings):
    """Explained rows, base values, names and groups."""
    fitted, split, groups = _fitted(spark, d, settings)
    rows, base = explain.explain(fitted, split.drop("train", "place"))
    return durable(rows), base, fitted.names, groups


GBT = models.Settings()
PASS = models.Settings(target="pass")

for _name, _settings in {
    "gbtree_score_metrics": GBT,
    "gbtree_pass_metrics": PASS,
    "forest_stars_metrics": models.Settings(target="stars", algorithm="forest"),
    "tree_session_length_metrics": models.Settings(target="sessionLen", algorithm="tree"),
    "linear_score_metrics": models.Settings(algorithm="linear"),
    "linear_pass_metrics": models.Settings(target="pass", algorithm="linear"),
}.items():
    query(_name)(lambda spark, d, s=_settings: _metrics(spark, d, s))


@query("shap_importance")
def shap_importance(spark, d):
    e, _, names, groups = _explained(spark, d, GBT)
    return explain.importance(explain.long(e, names, groups))


@query("shap_additivity", with_("ev") + "SELECT DISTINCT game_id, a.algorithm, 0.0::DOUBLE AS gap FROM ev CROSS JOIN (VALUES ('gbtree'), ('forest'), ('tree'), ('linear')) a(algorithm)")
def shap_additivity(spark, d):
    """Largest gap between the margin and base value plus SHAP values, for each game and algorithm; should be 0."""
    out = []
    for algorithm in models.ALGORITHMS:
        e, base, _, _ = _explained(spark, d, models.Settings(target="pass", algorithm=algorithm))
        total = F.aggregate("phi", F.col("base"), lambda a, x: a + x)
        gap = round_half_up(F.max(F.abs(F.col("margin") - total)), 6)
        out.append(e.join(base, "game_id").groupBy("game_id").agg(gap.alias("gap")).withColumn("algorithm", F.lit(algorithm)))
    return reduce(DataFrame.unionByName, out)


@query("shap_beeswarm")
def shap_beeswarm(spark, d):
    e, _, names, groups = _explained(spark, d, models.Settings(algorithm="tree"))
    return explain.beeswarm(explain.long(e, names, groups))


@query("explained_runs")
def explained_runs(spark, d):
    return explain.runs_table(_explained(spark, d, models.Settings(algorithm="linear"))[0], t.players(spark, d))


@query("prediction_exemplars")
def prediction_exemplars(spark, d):
    return explain.exemplars(_explained(spark, d, models.Settings(algorithm="linear"))[0])


@query("shap_waterfall")
def shap_waterfall(spark, d):
    """The steps of every run's prediction, not only of a selected one."""
    e, base, names, groups = _explained(spark, d, models.Settings(algorithm="tree", target="pass"))
    return explain.waterfall(explain.wide(e, names, groups), base)


@query("holdout_points")
def holdout_points(spark, d):
    """Actual against predicted values of the runs held out."""
    fitted, split, _ = _fitted(spark, d, models.Settings(algorithm="linear"))
    return models.score(fitted, split.where(~F.col("train"))).select("game_id", "id", round_half_up("y", 5).alias("actual"), round_half_up("p", 5).alias("predicted"))


@query("model_base_values")
def model_base_values(spark, d):
    """Base value and base probability of each game's model."""
    fitted, _, _ = _fitted(spark, d, PASS)
    return explain.base_values(fitted, spark).select("game_id", round_half_up("base", 5).alias("base"), round_half_up("base_probability", 5).alias("base_probability"))


SPLIT = with_("ev", "runs") + ", sz AS (SELECT game_id, count(*) AS n, CAST(greatest(1, floor(count(*) * 0.8)) AS BIGINT) AS cut, avg(CASE WHEN score >= 0.6 THEN 1.0 ELSE 0.0 END) AS pos FROM runs GROUP BY 1) "


@query(
    "model_metadata",
    SPLIT + f"""SELECT game_id, n, cut AS train_n, n - cut AS test_n, 9 + (SELECT least(12, count(DISTINCT type)) FROM ev e WHERE e.game_id = sz.game_id) AS features,
      {r('pos')} AS pos_rate FROM sz""",
)
def model_metadata(spark, d):
    fitted, split, _ = _fitted(spark, d, models.Settings(target="pass", algorithm="linear"))
    return split.groupBy("game_id").agg(
        F.count("*").alias("n"), F.count_if("train").alias("train_n"), F.count_if(~F.col("train")).alias("test_n"),
        F.max(F.size("x")).cast("long").alias("features"), round_half_up(F.avg("y"), 4).alias("pos_rate"),
    )


@query("seeded_holdout", SPLIT + "SELECT game_id, true AS train, cut AS n FROM sz UNION ALL SELECT game_id, false, n - cut FROM sz")
def seeded_holdout(spark, d):
    rows = features.holdout(t.runs(spark, d).select("game_id", "id"))
    return rows.groupBy("game_id", "train").agg(F.count("*").alias("n"))
