"""Feature selection, every filter one aggregate over all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreflow.functions.core import numeric_columns
from scoreflow.operators import association, clean, stability
from scoreflow.operators.sampling import weights
from scoreflow.plans.models import counted, fit_counted, importance
from scoreflow.plans.shared import REPORT, SharedCounts


def report_rows(spark: SparkSession, report: DataFrame, size: int) -> DataFrame:
    """Keep a finished step of the report: a few rows per feature."""
    from scoreflow.functions.core import bounded_rows

    rows = bounded_rows(report.select("feature", "test", "status", "value"), size, "report")
    return spark.createDataFrame(rows, REPORT)


def model_filter(df: DataFrame, cols: Sequence[str], target: str, imbalanced: bool,
                 rounds: int = 100, seed: int = 42) -> DataFrame:
    """Boosted trees; a feature stays if its importance is above the mean."""
    filled = clean.impute(df.select(target, *cols), cols, "median")
    weight = None
    if imbalanced:
        filled, weight = weights(filled, target), "weight"
    params = {"maxIter": rounds, "subsamplingRate": 0.8}
    # Rows are equal where the same bins and class are; of each cell lots of equal rows are drawn.
    rows = counted(filled, [target, *cols, *([weight] if weight else [])])
    model = fit_counted("boosted", params, cols, target, rows, seed, weight, drawn=True)
    table = importance(model, cols)
    mean = 1.0 / len(cols)  # importances add up to 1
    status = F.when(F.col("importance") > mean, "kept").otherwise("removed")
    return table.select("feature", F.lit("model").alias("test"), status.alias("status"),
                        F.col("importance").alias("value"))


def select_features(df: DataFrame, date: str, target: str | None = None,
                    cols: Sequence[str] | None = None, missing: float = 0.95,
                    mode: float = 0.9, corr: float = 0.9, psi: float = 0.1,
                    baseline_months: int = 3, use_model: bool = True, by_month: bool = False,
                    rounds: int = 100, seed: int = 42) -> tuple[list[str], DataFrame]:
    """(selected features, report).

    Order: missing ratio, mode share, univariate area and information, correlation with an
    earlier feature, stability, model importance. Without a target the univariate and model
    steps are left out. ``by_month`` takes the mean of the monthly indices (D3) instead of
    one index of all later months (D2). The input is read twice before the model step: for the
    counts that all filters share, and for the correlations.
    """
    spark = df.sparkSession
    cols = list(cols) if cols is not None else numeric_columns(df, [target or "", date])
    reports: list[DataFrame] = []

    def step(report: DataFrame, left: list[str]) -> list[str]:
        done = report_rows(spark, report, 3 * len(left))
        reports.append(done)
        return clean.kept(done, left)

    shared = SharedCounts(df, date, cols, target, baseline_months) if cols else None
    cols = step(shared.missing_filter(cols, missing), cols) if cols else cols
    cols = step(shared.mode_filter(cols, mode), cols) if cols else cols
    imbalanced = False
    if target is not None and cols:
        imbalanced = shared.majority() > 0.8
        cols = step(shared.univariate_filter(cols, imbalanced), cols)
    if len(cols) > 1:
        cols = step(association.correlation_filter(df, cols, corr, shared.centre(cols)), cols)
    if cols:
        index = shared.psi_mean_by_month(cols) if by_month else shared.psi(cols)
        cols = step(stability.stability_filter(index, psi), cols)
    if target is not None and use_model and cols:
        cols = step(model_filter(df, cols, target, imbalanced, rounds, seed), cols)
    report = reduce(lambda a, b: a.unionByName(b), reports) if reports else spark.createDataFrame([], REPORT)
    return cols, report
