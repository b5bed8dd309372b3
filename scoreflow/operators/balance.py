"""Oversampling of the minority class between nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreflow.functions.core import known, uniform
from scoreflow.operators.frame import drop_missing, salted_join, top_per_group
from scoreflow.operators.neighbours import nearest


def smote(df: DataFrame, target: str, id_col: str, num_cols: Sequence[str],
          cat_cols: Sequence[str] = (), k: int = 5, multiplier: int = 1,
          seed: int = 42) -> DataFrame:
    """All rows without missing values plus ``multiplier`` synthetic rows per minority row.

    A synthetic row lies on the segment from its row to one of the k nearest minority rows,
    drawn anew in each round; each text value comes from either parent. Copies of one point
    are neighbours at distance 0. Distances are between distinct points, so copies are never
    compared with each other. Added column: ``synthetic``.
    """
    num_cols, cat_cols = list(num_cols), list(cat_cols)
    used = drop_missing(df, [*num_cols, *cat_cols, target]).select(
        id_col, target, *[known(df, c).alias(c) for c in num_cols], *cat_cols)
    minority = used.filter(F.col(target) == 1).withColumn(
        "_point", F.md5(F.concat_ws("|", *[F.hex(F.col(c).cast("string").cast("binary"))
                                           for c in num_cols])))
    # k + 1 rows stand for all copies of a point: enough for k neighbours besides the row itself.
    stand = top_per_group(minority, ["_point"], [F.md5(F.col(id_col).cast("string"))], k + 1,
                          "_copy")
    # A point is named by the first of its rows, so that equal distances are in the order of the rows.
    stand = stand.withColumn("_key", F.struct(
        F.min(id_col).over(Window.partitionBy("_point")).alias("id"), F.col("_point").alias("point")))
    points = stand.filter(F.col("_copy") == 1).select("_key", *num_cols)
    near = nearest(points, "_key", num_cols, k, seed).select(
        F.col("key.point").alias("_base"), F.col("neighbour.point").alias("_point"),
        F.col("distance").alias("_gap"))
    own = points.select(F.col("_key.point").alias("_base"), F.col("_key.point").alias("_point"), F.lit(0.0).alias("_gap"))
    parents = near.unionByName(own).join(stand, "_point").select(
        "_base", "_gap", F.struct(F.col(id_col).alias("id"), *num_cols, *cat_cols).alias("row"))
    parents = top_per_group(parents, ["_base"], [F.col("_gap"), F.col("row.id")], k + 1, "_rn")
    lists = parents.groupBy("_base").agg(  # k + 1 rows each
        F.array_sort(F.collect_list(F.struct("_gap", "_rn", "row"))).alias("_near"))
    rounds = minority.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(multiplier)))) \
        if multiplier > 0 else minority.limit(0).withColumn("_round", F.lit(1))
    # A point may hold a large share of the rows, so its rows are spread over tasks.
    both = salted_join(rounds.withColumnRenamed("_point", "_base"), lists, ["_base"],
                       F.col(id_col))
    others = F.filter("_near", lambda n: n["row"]["id"] != F.col(id_col))
    ready = both.withColumn("_others", F.slice(others, 1, k)).filter(F.size("_others") > 0)
    draw = F.concat_ws("#", F.col(id_col).cast("string"), F.col("_round").cast("string"))
    pick = F.least(F.floor(uniform(draw, seed) * F.size("_others")).cast("int"),
                   F.size("_others") - 1)
    ready = ready.withColumn("_mate", F.get("_others", pick)["row"]).withColumn(
        "_u", uniform(draw, seed + 1))
    made = ready.select(
        F.concat_ws("#", F.col(id_col).cast("string"), F.col("_round").cast("string"))
        .alias(id_col), target,
        *[(F.col(c) + F.col("_u") * (F.col(f"_mate.{c}") - F.col(c))).alias(c) for c in num_cols],
        *[F.when(uniform(F.concat(draw, F.lit(f"#{i}")), seed + 2) < 0.5, F.col(c))
          .otherwise(F.col(f"_mate.{c}")).alias(c) for i, c in enumerate(cat_cols)],
        F.lit(True).alias("synthetic"))
    original = used.withColumn(id_col, F.col(id_col).cast("string")).withColumn(
        "synthetic", F.lit(False))
    return original.unionByName(made)
