"""Quality of predictions, per group: columns ``y`` (truth) and ``p`` (prediction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.functions.scalars import round_half_up
from playtrace.operators import ordered

GAME = ("game_id",)
ROC_POINTS = 40
CLIP = 1e-9


def regression(df: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """R2 (null without variance), RMSE and MAE."""
    err = F.col("y") - F.col("p")
    sst = F.var_pop("y") * F.count("*")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.when(F.min("y") < F.max("y"), round_half_up(1 - F.sum(err * err) / sst, 6)).alias("r2"),
        round_half_up(F.sqrt(F.avg(err * err)), 6).alias("rmse"),
        round_half_up(F.avg(F.abs(err)), 6).alias("mae"),
    )


def _blocks(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows with equal predictions as one block, with the totals below each block."""
    blocks = df.groupBy(*by, "p").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"))
    return ordered.running(
        blocks, list(by), ["p"], {"below": F.col("n"), "neg_below": F.col("n") - F.col("pos")}, inclusive=False
    )


def tied_ranks(df: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """Ascending ranks of the predictions; equal predictions share the mean rank."""
    return _blocks(df, by).select(*by, "p", "n", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def auc(df: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """Chance that a positive ranks above a negative, ties counting half; null for one class."""
    neg = F.col("n") - F.col("pos")
    wins = F.sum(F.col("pos") * (F.col("neg_below") + neg / 2))
    pairs = F.sum("pos").cast("double") * F.sum(neg)
    return _blocks(df, by).groupBy(*by).agg(F.when(pairs > 0, round_half_up(wins / pairs, 6)).alias("auc"))


def classification(df: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """Accuracy and confusion at .5, log-loss with clipped probabilities, AUC."""
    said, is_pos = F.col("p") >= 0.5, F.col("y") == 1
    q = F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), F.col("p")))
    loss = -(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(said & is_pos).alias("tp"),
        F.count_if(~said & ~is_pos).alias("tn"),
        F.count_if(said & ~is_pos).alias("fp"),
        F.count_if(~said & is_pos).alias("fn"),
        round_half_up(F.avg(loss), 6).alias("log_loss"),
    )
    accuracy = round_half_up((F.col("tp") + F.col("tn")) / F.col("n"), 6).alias("accuracy")
    return counts.join(auc(df, by), list(by)).select(*by, "n", accuracy, "auc", "log_loss", "tp", "tn", "fp", "fn")


def roc(df: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """Cumulative false and true positive rates from the highest prediction down, thinned."""
    pos = (F.col("y") == 1).cast("long")
    sweep = ordered.running(
        df.select(*by, "id", "p", "y"), list(by), [F.desc("p"), F.asc("id")], {"i": F.lit(1).cast("long"), "tp": pos, "fp": 1 - pos}
    )
    total = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(pos).alias("positives"))
    step = F.greatest(F.lit(1), F.floor((F.col("n") + 1) / ROC_POINTS))
    rate = lambda a, b: F.when(b > 0, round_half_up(a / b, 6)).otherwise(0.0)
    points = (
        sweep.join(total, list(by))
        .where((F.col("i") % step == 0) | (F.col("i") == F.col("n")))
        .select(*by, "i", rate(F.col("fp"), F.col("n") - F.col("positives")).alias("fpr"), rate(F.col("tp"), F.col("positives")).alias("tpr"))
    )
    return total.select(*by, F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).unionByName(points)


def constant_baseline(train: DataFrame, test: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """The test rows predicted by the training mean (the positive rate for a 0/1 target)."""
    mean = train.groupBy(*by).agg(F.avg("y").alias("p"))
    return test.drop("p").join(mean, list(by))
