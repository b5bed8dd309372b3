"""The tables behind the usual plots, all from the per-score running counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import equal_width_bin, ratio
from scoreflow.operators.metrics import confusion, score_steps
from scoreflow.operators.prefix import running_sums, value_counts


def confusion_grid(df: DataFrame, target: str, prediction: str,
                   labels: Sequence[int] = (0, 1)) -> DataFrame:
    """K1: confusion matrix with the empty cells filled with 0."""
    cells = confusion(df, target, prediction)
    side = F.array(*[F.lit(int(x)) for x in labels])
    # The grid is labels x labels, made from the labels alone.
    grid = df.sparkSession.range(1).select(F.explode(side).alias("actual")).select(
        "actual", F.explode(side).alias("predicted"))
    return grid.join(cells, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def roc_points(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """K2: threshold, false positive rate, true positive rate at every distinct score."""
    return score_steps(df, score, target, by).select(
        *by, F.col(score).alias("threshold"),
        ratio(F.col("cum_goods"), F.col("tot_goods")).alias("fpr"),
        ratio(F.col("cum_bads"), F.col("tot_bads")).alias("tpr"))


def pr_points(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """K3: threshold, recall, precision at every distinct score."""
    return score_steps(df, score, target, by).select(
        *by, F.col(score).alias("threshold"),
        ratio(F.col("cum_bads"), F.col("tot_bads")).alias("recall"),
        ratio(F.col("cum_bads"), F.col("cum_bads") + F.col("cum_goods")).alias("precision"))


def thin(points: DataFrame, x: str, steps: int = 1000) -> DataFrame:
    """One point per 1/steps of the x share (the first by value), for drawing only."""
    slot = F.floor(F.col(x) * steps).cast("long")
    key = F.struct(F.col(x), F.col("threshold"))
    rest = [c for c in points.columns]
    picked = points.groupBy(slot.alias("_slot")).agg(
        F.min_by(F.struct(*rest), key).alias("_p"))
    return picked.select("_p.*")


def score_histogram(df: DataFrame, score: str, target: str, bins: int = 30,
                    low: float = 0.0, high: float = 1.0) -> DataFrame:
    """K4: rows per (class, equal-width bin of the score)."""
    slot = equal_width_bin(F.col(score), F.lit(low), F.lit(high), bins)
    return df.filter(F.col(score).isNotNull()).groupBy(
        F.col(target), F.greatest(slot, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def calibration(df: DataFrame, score: str, target: str, bins: int = 10) -> DataFrame:
    """K5: mean score and positive rate per uniform bin (p in (k/bins, (k+1)/bins])."""
    slot = F.greatest(F.ceil(F.col(score) * bins).cast("int") - 1, F.lit(0))
    return df.filter(F.col(score).isNotNull()).groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
        F.avg(F.col(target).cast("double")).alias("positive_rate"))


def ks_curve(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """K6: score, cumulated good and bad shares, and their difference."""
    good = ratio(F.col("cum_goods"), F.col("tot_goods"))
    bad = ratio(F.col("cum_bads"), F.col("tot_bads"))
    return score_steps(df, score, target, by).select(
        *by, F.col(score).alias("score"), good.alias("cum_good"), bad.alias("cum_bad"),
        (bad - good).alias("difference"))


def gain_lift(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of positives and of rows captured by descending score, and lift."""
    rows, tot = (F.col("cum_bads") + F.col("cum_goods")), (F.col("tot_bads") + F.col("tot_goods"))
    gain, part = ratio(F.col("cum_bads"), F.col("tot_bads")), ratio(rows, tot)
    return score_steps(df, score, target, by).select(
        *by, F.col(score).alias("threshold"), part.alias("population"), gain.alias("gain"),
        (gain / F.nullif(part, F.lit(0.0))).alias("lift"))


def cumulative_counts(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and cumulated rows per distinct score, ascending."""
    return running_sums(value_counts(df, score, by), score, ["n"], by)
