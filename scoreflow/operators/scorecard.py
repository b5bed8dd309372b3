"""Score bands: statistics, alignment of the score to log-odds, and metrics per band."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreflow.functions.core import band_label, ratio
from scoreflow.operators.metrics import rank_metrics
from scoreflow.operators.prefix import difference, ntile


def score_bands(df: DataFrame, score: str, id_col: str, n: int = 10) -> DataFrame:
    """B1: add ``band`` 1..n, equal-sized by ascending score."""
    return ntile(df, score, id_col, n, "band")


def band_table(banded: DataFrame, score: str, target: str) -> DataFrame:
    """Range, counts, mean score, bad rate and log-odds per band."""
    stats = banded.groupBy("band").agg(
        F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(target) == 0).alias("goods"),
        F.count_if(F.col(target) == 1).alias("bads"),
        F.avg(score).alias("mean_score"),
    )
    pd = ratio(F.col("bads"), F.col("total"))
    odds = F.when((pd > 0) & (pd < 1), F.log((1 - pd) / pd))
    return stats.withColumns({"pd": pd, "log_odds": odds})


def alignment(bands: DataFrame) -> DataFrame:
    """Least-squares line of log-odds on the mean score of the bands, one row."""
    usable = bands.filter(F.col("log_odds").isNotNull())
    return usable.agg(F.regr_slope("log_odds", "mean_score").alias("slope"),
                      F.regr_intercept("log_odds", "mean_score").alias("intercept"))


def align_score(df: DataFrame, bands: DataFrame, score: str, name: str = "aligned") -> DataFrame:
    """Apply a + b * score to every row; the two coefficients are a scalar subquery."""
    line = alignment(bands).select(F.struct("slope", "intercept"))
    return (
        df.withColumn("_line", line.scalar())
        .withColumn(name, F.col("_line.intercept") + F.col("_line.slope") * F.col(score))
        .drop("_line")
    )


def band_metrics(banded: DataFrame, score: str, target: str, ascending: bool = True) -> DataFrame:
    """KS, AUC and Gini inside each band, one grouped pass.

    ``ascending`` measures goods against bads from the lowest score up, the direction
    of an aligned score where a higher value is a better client.
    """
    table = rank_metrics(banded.withColumn("_rank", -F.col(score) if ascending else F.col(score)),
                         "_rank", target, ["band"])
    return table.select("band", "ks", "auc", "gini")


def scorecard(banded: DataFrame, score: str, target: str) -> DataFrame:
    """The final table, one row per band plus the mean of the bands.

    Range, counts and metrics all come from one pass over the counts per (band, score).
    """
    table = rank_metrics(banded, score, target, ["band"], extra=[
        F.min(score).alias("min_score"), F.max(score).alias("max_score")])
    total = F.col("goods") + F.col("bads")
    card = table.select(
        F.col("band").cast("string").alias("band"),
        band_label(F.col("min_score"), F.col("max_score")).alias("label"),
        "goods", "bads", total.alias("total"), ratio(F.col("bads"), total).alias("pd"),
        "ks", "auc", "gini")
    return with_mean_row(card, "band", "label")


def with_mean_row(table: DataFrame, key: str, *text: str) -> DataFrame:
    """Add a row ``MEAN`` with the mean of every number in a metric table.

    Each row counts for itself and for the mean, so the table is computed once.
    """
    numbers = [c for c in table.columns if c != key and c not in text]
    twice = table.withColumn("_to", F.explode(F.array(F.col(key), F.lit("MEAN"))))
    return twice.groupBy(F.col("_to").alias(key)).agg(
        *[F.when(F.col("_to") == "MEAN", "MEAN").otherwise(F.max(t)).alias(t) for t in text],
        *[F.avg(c).alias(c) for c in numbers])


def band_cumulative(bands: DataFrame) -> DataFrame:
    """Cumulated shares of goods and bads over the bands, and their distance."""
    upto = Window.partitionBy(F.lit(0)).orderBy("band").rowsBetween(
        Window.unboundedPreceding, 0)  # a handful of bands
    whole = Window.partitionBy(F.lit(0))
    share = lambda c: ratio(F.sum(c).over(upto), F.sum(c).over(whole))
    return bands.select(
        "band", "goods", "bads", share("goods").alias("cum_goods"), share("bads").alias("cum_bads")
    ).withColumn("ks", F.abs(F.col("cum_goods") - F.col("cum_bads")))


def partial_gini(bands: DataFrame) -> DataFrame:
    """Trapezoid of each band under (goods, bads) shares and its part of the Gini."""
    shares = band_cumulative(bands)
    shares = difference(shares, "cum_goods", "band", name="_dg")
    shares = difference(shares, "cum_bads", "band", name="_db")
    area = (2 * F.col("cum_bads") - F.col("_db")) * F.col("_dg") / 2
    return shares.select("band", "cum_goods", "cum_bads", area.alias("partial_auc"),
                         (2 * area - F.col("_db")).alias("partial_gini"))
