"""Set operations on rows and on the feature lists of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_by_name(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Union all by column name."""
    for df in rest:
        first = first.unionByName(df)
    return first


def stack_by_position(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Union all by position."""
    for df in rest:
        first = first.union(df)
    return first


def compare_features(a: DataFrame, b: DataFrame, name: str = "feature") -> DataFrame:
    """Every feature of two models and whether it is in both, only in a, or only in b."""
    both = a.select(name).distinct().withColumn("_a", F.lit(1)).unionByName(
        b.select(name).distinct().withColumn("_a", F.lit(2)))
    where = F.sum("_a")
    return both.groupBy(name).agg(
        F.when(where == 3, "both").when(where == 1, "only_a").otherwise("only_b").alias("where"))


def presence(df: DataFrame, models: list[str], model: str = "model",
             feature: str = "feature") -> DataFrame:
    """U4: one row per feature, one boolean column per model."""
    return df.groupBy(feature).agg(*[
        F.coalesce(F.max(F.col(model) == m), F.lit(False)).alias(m) for m in models])
