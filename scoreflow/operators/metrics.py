"""Ranking and classification metrics as DataFrames.

Every ranking metric starts from the counts of goods and bads per distinct score,
so ties are one step and one aggregate feeds KS, AUC, PR and all curves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreflow.functions.core import present, ratio
from scoreflow.operators.prefix import running_sums


def class_counts(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """A1: goods (target 0), bads (target 1) and all rows, per group."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(target) == 0).alias("goods"),
        F.count_if(F.col(target) == 1).alias("bads"),
        F.count(F.lit(1)).alias("n"),
    )


def _rows(weight: str | None, when: Column | None = None) -> Column:
    """Rows (or their summed ``weight``) for which ``when`` holds."""
    value = F.lit(1) if weight is None else F.col(weight)
    if when is None:
        return F.sum(value) if weight else F.count(F.lit(1))
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0)) if weight else F.count_if(when)


def score_steps(df: DataFrame, score: str, target: str, by: Sequence[str] = (),
                descending: bool = True, weight: str | None = None) -> DataFrame:
    """One row per (group, distinct score) with cumulated goods and bads.

    Rows whose score is missing (null or NaN) or whose target is not 0 or 1 are left out;
    ``left_out`` counts them. ``weight`` is the number of rows that a row stands for.
    """
    scored = df.withColumn(score, present(df, score))
    scored = scored.filter(F.col(score).isNotNull() & F.col(target).isin(0, 1))
    counts = scored.groupBy(*by, score).agg(
        _rows(weight, F.col(target) == 0).alias("goods"),
        _rows(weight, F.col(target) == 1).alias("bads"),
    )
    return running_sums(counts, score, ["goods", "bads"], by, descending)


def left_out(df: DataFrame, score: str, target: str) -> DataFrame:
    """One row: rows that no ranking metric uses, by a missing score and by an unusable target."""
    no_score = present(df, score).isNull()
    return df.agg(F.count_if(no_score).alias("no_score"),
                  F.count_if(~no_score & ~F.coalesce(F.col(target).isin(0, 1), F.lit(False)))
                  .alias("no_target"))


def _shares() -> tuple[Column, Column]:
    return ratio(F.col("cum_goods"), F.col("tot_goods")), ratio(F.col("cum_bads"), F.col("tot_bads"))


def _auc_term() -> Column:
    # Trapezoid on (good share, bad share); a tie group is one slanted step.
    height = F.col("cum_bads") - F.col("bads") / 2.0
    return F.col("goods").cast("double") * height


_RANKS = ("ks", "ks_two_sided", "threshold", "auc", "pr_auc", "average_precision")


def rank_metrics(df: DataFrame, score: str, target: str, by: Sequence[str] = (),
                 extra: Sequence[Column] = (), weight: str | None = None) -> DataFrame:
    """M1-M4 in one pass: ks, ks_two_sided, threshold, auc, gini, pr_auc, average_precision.

    One row per group; a group with one class only has null metrics. ``extra`` are named
    aggregates over the distinct scores of the group, computed in the same pass.
    """
    return rank_steps(score_steps(df, score, target, by, weight=weight), score, by, extra)


def rank_steps(steps: DataFrame, score: str, by: Sequence[str] = (),
               extra: Sequence[Column] = ()) -> DataFrame:
    """``rank_metrics`` from the steps of ``score_steps`` (descending)."""
    good, bad = _shares()
    gap = bad - good
    seen = (F.col("cum_bads") + F.col("cum_goods")).cast("double")
    before = seen - F.col("bads") - F.col("goods")
    precision = F.col("cum_bads") / seen
    # The curve starts at recall 0, precision 1.
    previous = F.when(before == 0, F.lit(1.0)).otherwise(
        (F.col("cum_bads") - F.col("bads")) / F.nullif(before, F.lit(0.0)))
    recall_step = ratio(F.col("bads"), F.col("tot_bads"))
    both = (F.col("tot_goods") > 0) & (F.col("tot_bads") > 0)
    area = F.sum(_auc_term()) / F.nullif(
        F.max(F.col("tot_goods").cast("double") * F.col("tot_bads")), F.lit(0.0))
    out = steps.groupBy(*by).agg(
        F.max(gap).alias("ks"),
        F.max(F.abs(gap)).alias("ks_two_sided"),
        F.max_by(F.col(score).cast("double"), F.struct(gap, F.col(score))).alias("threshold"),
        area.alias("auc"),
        F.sum(recall_step * (precision + previous) / 2.0).alias("pr_auc"),
        F.sum(recall_step * precision).alias("average_precision"),
        F.max(F.when(both, 1)).alias("_both"),
        F.max("tot_goods").alias("goods"),
        F.max("tot_bads").alias("bads"),
        *extra,
    )
    named = [c for c in out.columns if c not in _RANKS and c not in by and c != "_both"]
    keep = lambda c: F.when(F.col("_both") == 1, F.col(c)).alias(c)
    return out.select(
        *by, *[keep(c) for c in ("ks", "ks_two_sided", "threshold", "auc")],
        F.when(F.col("_both") == 1, 2 * F.col("auc") - 1).alias("gini"),
        keep("pr_auc"), keep("average_precision"), *named,
    )


def ks(df: DataFrame, score: str, target: str, by: Sequence[str] = (),
       two_sided: bool = False) -> DataFrame:
    """M1: largest gap between cumulated bad and good shares, by descending score."""
    table = rank_metrics(df, score, target, by)
    return table.select(*by, F.col("ks_two_sided" if two_sided else "ks").alias("ks"), "threshold")


def roc_auc(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """M2, M4: exact area under ROC and Gini."""
    return rank_metrics(df, score, target, by).select(*by, "auc", "gini")


def pr_auc(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """M3: area under precision-recall and average precision."""
    return rank_metrics(df, score, target, by).select(*by, "pr_auc", "average_precision")


def label_at(score: str, threshold: float = 0.5) -> Column:
    """M7: 1 when the score is strictly above the threshold."""
    return (F.col(score) > threshold).cast("int")


def ks_verdict(ks_col: Column) -> Column:
    """M8: weak below .2, fair below .3, good below .5, very strong from there."""
    return (F.when(ks_col < 0.2, "weak").when(ks_col < 0.3, "fair")
            .when(ks_col < 0.5, "good").when(ks_col.isNotNull(), "very strong"))


def confusion(df: DataFrame, target: str, prediction: str,
              weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A5: rows per (actual, predicted), per group."""
    return df.groupBy(*by, F.col(target).cast("int").alias("actual"),
                      F.col(prediction).cast("int").alias("predicted")).agg(
        _rows(weight).alias("n"))


def class_report(df: DataFrame, target: str, prediction: str,
                 weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """M6: precision, recall, f1 and support per class, from the confusion counts."""
    cells = confusion(df, target, prediction, weight, by)
    # One row per class on each side; the union keeps classes never predicted.
    sides = cells.select(*by, F.col("actual").alias("label"), F.col("n").alias("support"),
                         F.lit(0).cast("long").alias("chosen"),
                         F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                         .otherwise(0).alias("hit"))
    sides = sides.unionByName(cells.select(
        *by, F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
        F.col("n").alias("chosen"), F.lit(0).cast("long").alias("hit")))
    table = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "chosen", "hit")])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return table.select(
        *by, "label",
        zero(ratio(F.col("hit"), F.col("chosen"))).alias("precision"),
        zero(ratio(F.col("hit"), F.col("support"))).alias("recall"),
        zero(ratio(2 * F.col("hit"), F.col("chosen") + F.col("support"))).alias("f1"),
        "support", "hit",
    )


def weighted_metrics(df: DataFrame, target: str, prediction: str,
                     weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """M5: accuracy and support-weighted precision, recall and f1, per group."""
    table = class_report(df, target, prediction, weight, by)
    all_rows = F.sum("support")
    mean = lambda c: ratio(F.sum(F.col(c) * F.col("support")), all_rows)
    return table.groupBy(*by).agg(
        ratio(F.sum("hit"), all_rows).alias("accuracy"),
        mean("precision").alias("weighted_precision"),
        mean("recall").alias("weighted_recall"),
        mean("f1").alias("f1"),
    )


METRICS = ("accuracy", "weighted_precision", "weighted_recall", "f1",
           "auc", "gini", "ks", "pr_auc")


def evaluate(df: DataFrame, target: str, prediction: str, score: str | None = None,
             weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """M9: long table (metric, value), per group. Ranking metrics need a score and two classes."""
    by = list(by)
    wide = weighted_metrics(df, target, prediction, weight, by)
    long = wide.unpivot(by, [c for c in wide.columns if c not in by], "metric", "value")
    if score is None:
        return long
    ranks = rank_metrics(df, score, target, by, weight=weight).select(*by, "auc", "gini", "ks", "pr_auc")
    # More than two classes leave the ranking metrics out, one class leaves them null.
    return long.unionByName(
        ranks.unpivot(by, ["auc", "gini", "ks", "pr_auc"], "metric", "value").filter(F.col("value").isNotNull()))


def class_profile(df: DataFrame, col: str, target: str) -> DataFrame:
    """A3: count, mean, sample deviation, min and max of a column per class."""
    return df.groupBy(target).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev(col).alias("stddev"),
        F.min(col).alias("min"), F.max(col).alias("max"))


def class_balance(df: DataFrame, target: str, limit: float = 0.8) -> DataFrame:
    """A2: rows per class, majority share and the imbalance flag."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # one row per class
    share = ratio(F.max("n").over(whole), F.sum("n").over(whole))
    return counts.select(target, "n", share.alias("majority_share"),
                         (share > limit).alias("imbalanced"))
