"""Feature attributions computed by scoring changed rows with the model."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import bounded_rows, known
from scoreflow.operators.metrics import rank_metrics
from scoreflow.operators.prefix import global_rank
from scoreflow.operators.sampling import sample_rows
from scoreflow.plans.models import predict


def permutation_importance(model: PipelineModel, df: DataFrame, id_col: str,
                           features: Sequence[str], target: str, metric: str = "auc",
                           seed: int = 42) -> DataFrame:
    """Drop of a ranking metric when one feature is taken from another row.

    Two random orders of the ids, joined by rank, give each row its partner: one shuffle for
    all features. The shuffled versions are scored in one pass, grouped by feature.
    """
    data = df.select(id_col, target, *features)
    left = global_rank(data, id_col, seed, "_rank")
    right = global_rank(data.select(id_col, *features), id_col, seed + 1, "_rank").select(
        "_rank", *[F.col(f).alias(f"_o_{f}") for f in features])
    paired = left.join(right, "_rank")
    names = ["(none)", *features]
    versions = paired.withColumn("feature", F.explode(F.array(*[F.lit(n) for n in names])))
    changed = versions.select(id_col, target, "feature", *[
        F.when(F.col("feature") == f, F.col(f"_o_{f}")).otherwise(F.col(f)).alias(f)
        for f in features])
    scored = predict(model, changed, [target, "feature"])
    table = rank_metrics(scored, "score", target, ["feature"]).select("feature", metric)
    base = F.max(F.when(F.col("feature") == "(none)", F.col(metric)))
    wide = table.agg(base.alias("base"), F.collect_list(F.struct("feature", metric)).alias("all"))
    return wide.select("base", F.explode("all").alias("r")).filter(
        F.col("r.feature") != "(none)").select(
        F.col("r.feature").alias("feature"),
        (F.col("base") - F.col(f"r.{metric}")).alias("importance"))


def linear_contributions(df: DataFrame, id_col: str, coefficients: Mapping[str, float]
                         ) -> DataFrame:
    """Coefficient * (x - mean x) per row and feature; adds up to margin - mean margin."""
    names = list(coefficients)
    means = df.agg(*[F.avg(known(df, c)).alias(c) for c in names]).select(
        F.struct(*names).alias("m"))
    wide = df.select(id_col, *[known(df, c).alias(c) for c in names]).withColumn(
        "_m", means.scalar())
    parts = wide.select(id_col, *[
        (F.lit(float(w)) * (F.col(c) - F.col(f"_m.{c}"))).alias(c)
        for c, w in coefficients.items()])
    return parts.unpivot([id_col], names, "feature", "contribution")


def sampled_shapley(model: PipelineModel, df: DataFrame, id_col: str, features: Sequence[str],
                    n_rows: int = 100, n_perm: int = 20, seed: int = 42) -> DataFrame:
    """Shapley contributions of ``n_rows`` sampled rows by random feature orders.

    Each of ``n_perm`` orders has its own background row. Features are switched from the
    background to the row one by one; the change of the score is the contribution. They
    add up to score(x) - mean score of the background rows.
    """
    features = list(features)
    data = df.select(id_col, *[known(df, f).alias(f) for f in features])
    background = bounded_rows(sample_rows(data, id_col, n_perm, seed + 1).orderBy(id_col),
                              n_perm, "background rows")
    rng = random.Random(seed)
    orders = []
    for row in background:
        order = list(range(len(features)))
        rng.shuffle(order)
        orders.append(F.struct(
            *[F.lit(float(row[f]) if row[f] is not None else None).cast("double").alias(f"b{i}")
              for i, f in enumerate(features)],
            *[F.lit(order.index(i)).alias(f"at{i}") for i in range(len(features))]))
    rows = sample_rows(data, id_col, n_rows, seed)
    wide = rows.withColumn("_o", F.explode(F.array(*orders))).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    places = [F.col(f"_o.at{i}").alias(f"_at{i}") for i in range(len(features))]
    mixed = wide.select(id_col, "_j", *places, *[
        F.when(F.col(f"_o.at{i}") < F.col("_j"), F.col(f)).otherwise(F.col(f"_o.b{i}")).alias(f)
        for i, f in enumerate(features)])
    names = [f"_at{i}" for i in range(len(features))]
    scored = predict(model, mixed, [id_col, "_j", *names])
    count = float(len(background))
    total = scored.groupBy(id_col).agg(*[
        (F.sum(F.when(F.col("_j") == F.col(f"_at{i}") + 1, F.col("score"))
               .when(F.col("_j") == F.col(f"_at{i}"), -F.col("score")).otherwise(0.0)) / count)
        .alias(f) for i, f in enumerate(features)])
    return total.unpivot([id_col], features, "feature", "contribution")


def contribution_summary(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return contributions.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature")


def dependence(contributions: DataFrame, df: DataFrame, id_col: str,
               features: Sequence[str]) -> DataFrame:
    """(feature, value, contribution) of the explained rows, for the named features."""
    pairs = F.create_map(*[x for f in features for x in (F.lit(f), known(df, f))])
    wanted = contributions.filter(F.col("feature").isin(list(features)))
    # A few explained rows: Spark broadcasts them, the rows of the frame stay where they are.
    return wanted.join(df.select(id_col, pairs.alias("_x")), id_col).withColumn(
        "value", F.element_at("_x", F.col("feature"))).drop("_x")
