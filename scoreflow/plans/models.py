"""Model families, their inputs, and stored models."""

from __future__ import annotations

import json
import math
import posixpath
from collections.abc import Callable, Mapping, Sequence
from threading import RLock
from typing import Any
from weakref import WeakKeyDictionary

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml.feature import Bucketizer, ElementwiseProduct, MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreflow.functions.core import sigmoid, stored
from scoreflow.operators.encode import input_for
from scoreflow.plans import factors, perceptron

# Rows that a counted row stands for, and the same times its class weight.
ROWS, WEIGHT = "_rows", "_weight"
BIN = "_bin_"  # prefix of a column that holds the bin of a feature
DRAWN = 8  # rows of a cell beyond this number are drawn in so many lots
BINNED = ("tree", "boosted")
WEIGHTED = ("logistic", "tree", "forest", "boosted", "svc", "naive_bayes", "ovr")


def _mlp(n_features: int, n_classes: int, **p: Any) -> Estimator:
    hidden = p.pop("hidden", None) or [p.pop(k) for k in ("hidden1", "hidden2") if k in p] or [5]
    hidden = [hidden] if isinstance(hidden, int) else list(hidden)
    return C.MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], **p)


def _ovr(n_features: int, n_classes: int, **p: Any) -> Estimator:
    parallelism = p.pop("parallelism", 1)
    return C.OneVsRest(classifier=C.LogisticRegression(**p), parallelism=parallelism)


def _plain(cls: Callable[..., Estimator]) -> Callable[..., Estimator]:
    return lambda n_features, n_classes, **p: cls(**p)


FAMILIES: dict[str, Callable[..., Estimator]] = {
    "logistic": _plain(C.LogisticRegression),
    "tree": _plain(C.DecisionTreeClassifier),
    "forest": _plain(C.RandomForestClassifier),
    "boosted": _plain(C.GBTClassifier),
    "svc": _plain(C.LinearSVC),
    "naive_bayes": _plain(C.NaiveBayes),
    "mlp": _mlp,
    "fm": _plain(C.FMClassifier),
    "ovr": _ovr,
}


def make_model(name: str, params: Mapping[str, Any], features: Sequence[str], target: str,
               seed: int = 42, n_classes: int = 2, weight: str | None = None) -> Pipeline:
    """An unfitted pipeline from feature columns to prediction.

    Linear, naive Bayes, perceptron and factorisation families read scaled inputs, trees
    raw ones. Scaling is learned together with the model, so only on its training rows.
    """
    if name not in FAMILIES:
        raise ValueError(f"unknown model {name!r}; one of {', '.join(FAMILIES)}")
    model = FAMILIES[name](len(features), n_classes, **dict(params))
    stages: list = [VectorAssembler(inputCols=list(features), outputCol="raw_features")]
    column = "raw_features"
    if name == "naive_bayes":
        stages.append(MinMaxScaler(inputCol=column, outputCol="scaled_features"))
        column = "scaled_features"
    elif input_for(name) == "scaled":
        stages.append(StandardScaler(inputCol=column, outputCol="scaled_features"))
        column = "scaled_features"
    model.set(model.getParam("featuresCol"), column)
    model.set(model.getParam("labelCol"), target)
    if model.hasParam("seed") and "seed" not in params:
        model.set(model.getParam("seed"), seed)
    if weight is not None and name in WEIGHTED:
        model.set(model.getParam("weightCol"), weight)
    return Pipeline(stages=[*stages, model])


def counted(df: DataFrame, keys: Sequence[str], name: str = ROWS) -> DataFrame:
    """Equal rows once, with their number, written once for all fits that read them."""
    return stored(df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(name)))


def fits_counts(name: str, params: Mapping[str, Any], weight: str | None = None) -> bool:
    """Whether the family's fit on counted rows is its fit on the rows themselves.

    Forests and sampled boosting draw rows. Limits on the rows of a node can only be said in rows, so not
    together with class weights.
    """
    if name == "mlp":
        return params.get("solver", "l-bfgs") == "l-bfgs" and "initialWeights" not in params
    if name == "fm":
        return params.get("solver", "adamW") == "adamW" and params.get("miniBatchFraction", 1.0) == 1.0
    if name in ("tree", "boosted"):
        few = params.get("minInstancesPerNode", 1) <= 1
        return ((few or weight is None) and params.get("subsamplingRate", 1.0) == 1.0
                and "minWeightFractionPerNode" not in params)
    return name == "naive_bayes" or name in ("logistic", "svc") and "standardization" not in params


def cut_points(rows: DataFrame, features: Sequence[str], max_bins: int) -> dict[str, list[float]]:
    """Where features of more than ``max_bins`` values are cut; the others are not named.

    MLlib takes the candidates for splits from a sample; here they are quantiles of all distinct rows.
    """
    shares = [i / max_bins for i in range(1, max_bins)]
    found = rows.agg(*[F.approx_count_distinct(f).alias(f"n{i}") for i, f in enumerate(features)], *[
        F.percentile_approx(f, shares).alias(f"q{i}") for i, f in enumerate(features)]).first()
    few = [f for i, f in enumerate(features) if found[f"n{i}"] <= 2 * max_bins]
    values = rows.agg(*[F.size(F.collect_set(f)).alias(f) for f in few]).first().asDict() if few else {}
    return {f: sorted(set(map(float, found[f"q{i}"] or []))) for i, f in enumerate(features) if values.get(f, max_bins + 1) > max_bins}


def binned(rows: DataFrame, features: Sequence[str], target: str, max_bins: int, numbers: Sequence[str]
           ) -> tuple[list, list[str], DataFrame]:
    """A stage that bins features of many values, the inputs of a tree, and the cells: rows that no tree tells apart.

    There are at most ``2 * max_bins ** features`` cells, however many rows. ``numbers`` are added up.
    """
    cuts = cut_points(rows, features, max_bins)
    if not cuts:
        return [], list(features), rows
    # A value at a cut belongs to the upper bin; NaN and null are refused as the assembler refuses them.
    stage = Bucketizer(splitsArray=[[-math.inf, *cuts[f], math.inf] for f in cuts], inputCols=list(cuts),
                       outputCols=[BIN + f for f in cuts], handleInvalid="error")
    inputs = [BIN + f if f in cuts else f for f in features]
    cells = stage.transform(rows).groupBy(target, *inputs).agg(*[F.sum(n).alias(n) for n in numbers])
    return [stage], inputs, stored(cells)


# Cells and scales of counted frames that are still in use: the trials of a search read the same ones.
_READY: WeakKeyDictionary = WeakKeyDictionary()


def _learned(rows: DataFrame, place: tuple, learn: Callable[[], Any]) -> Any:
    """What is learned of a counted frame once, also by fits that run at the same time."""
    lock, ready = _READY.setdefault(rows, (RLock(), {}))
    with lock:
        if place not in ready:
            ready[place] = learn()
        return ready[place]


def lots(cells: DataFrame, count: str = ROWS, weight: str = WEIGHT) -> DataFrame:
    """Cells as lots of equal rows, for fits that draw rows: a cell of up to DRAWN rows is its single rows,
    a larger one DRAWN lots that differ by one row at most. No row is lost."""
    many = F.least(F.col(count), F.lit(DRAWN)).cast("long")
    parts = cells.withColumn("_lot", F.explode(F.sequence(F.lit(1).cast("long"), many)))
    of = F.floor(F.col(count) / many) + (F.col("_lot") <= F.col(count).cast("long") % many).cast("long")
    return parts.withColumn(weight, F.col(weight) / F.col(count) * of).withColumn(count, of.cast("double")).drop("_lot")


def _deviations(rows: DataFrame, features: Sequence[str], each: Column, count: str) -> list[float]:
    """Standard deviations of features over all rows that the counted ones stand for, each with its weight."""
    total = rows.agg(F.sum(WEIGHT).alias("w"), F.sum(each * each / F.col(count)).alias("q"), *[
        (F.sum(F.col(f) * F.col(WEIGHT)) / F.sum(WEIGHT)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    spread = rows.agg(*[F.sum((F.col(f) - F.lit(total[f"m{i}"])) ** 2 * F.col(WEIGHT))
                        for i, f in enumerate(features)]).first()
    free = total["w"] - total["q"] / total["w"]
    return [math.sqrt(s / free) if s and free > 0 else 0.0 for s in spread]


def _scaler(deviations: Sequence[float], column: str) -> ElementwiseProduct:
    return ElementwiseProduct(scalingVec=Vectors.dense([1.0 / d if d else 0.0 for d in deviations]),
                              inputCol=column, outputCol="scaled_features")


def fit_perceptrons(points: Sequence[Mapping[str, Any]], features: Sequence[str], target: str, rows: DataFrame,
                    seed: int = 42, count: str = ROWS) -> list[PipelineModel | Exception]:
    """A perceptron for each set of parameters, or its error, from rows that each stand for ``count`` equal ones.

    All take their steps side by side, so that a pass over the rows serves every one.
    """
    plain, rows = rows, rows.withColumn(WEIGHT, F.col(count))
    deviations = _learned(plain, ("scales", *features, None, count), lambda: _deviations(rows, features, F.col(count), count))
    inputs = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw_features"),
                              _scaler(deviations, "raw_features")]).fit(rows)
    made: list[Estimator | Exception] = []
    for p in points:
        try:
            made.append(_mlp(len(features), 2, **{"seed": seed, **p}, featuresCol="scaled_features", labelCol=target))
        except Exception as error:  # noqa: BLE001 - belongs to this point alone
            made.append(error)
    machines = [m for m in made if isinstance(m, Estimator)]
    fitted = iter(perceptron.fit(machines, inputs.transform(rows), WEIGHT) if machines else [])
    out = [next(fitted) if isinstance(m, Estimator) else m for m in made]
    return [m if isinstance(m, Exception) else PipelineModel([*inputs.stages, m]) for m in out]


def fit_counted(name: str, params: Mapping[str, Any], features: Sequence[str], target: str, rows: DataFrame,
                seed: int = 42, weight: str | None = None, count: str = ROWS, drawn: bool = False) -> PipelineModel:
    """The model of ``make_model`` from rows that each stand for ``count`` equal ones.

    Trees read cells of binned features. With ``drawn`` a fit that draws rows draws lots of equal ones.

    Scales are those of all rows, which the summaries of weighted rows would miss, so they are a stage of
    their own; the least number of rows in a node becomes their share.
    """
    if name == "mlp":
        fitted = fit_perceptrons([params], features, target, rows, seed, count)[0]
        if isinstance(fitted, Exception):
            raise fitted
        return fitted
    if name not in WEIGHTED:  # as in make_model
        weight = None
    params, each = dict(params), F.col(count) if weight is None else F.col(count) * F.col(weight)
    plain, rows = rows, rows.withColumn(WEIGHT, each)
    inputs, fixed = list(features), []
    if name in BINNED:
        bins = params.get("maxBins", 32)
        fixed, inputs, rows = _learned(plain, (*features, target, weight, count, bins),
                                       lambda: binned(rows, features, target, bins, [count, WEIGHT]))
        if drawn:
            rows = lots(rows, count)
    stages = [VectorAssembler(inputCols=inputs, outputCol="raw_features")]
    column = "raw_features"
    if name == "naive_bayes":
        stages.append(MinMaxScaler(inputCol=column, outputCol="scaled_features"))
        column = "scaled_features"
    elif input_for(name) == "scaled":
        deviations = _learned(plain, ("scales", *features, weight, count), lambda: _deviations(rows, features, each, count))
        stages.append(_scaler(deviations, column))
        column = "scaled_features"
    if name == "fm":
        machine = C.FMClassifier(featuresCol=column, labelCol=target, **{"seed": seed, **params})
        inputs = Pipeline(stages=stages).fit(rows)
        return PipelineModel([*inputs.stages, factors.fit(machine, inputs.transform(rows), WEIGHT)])
    if name in ("logistic", "svc"):
        params["standardization"] = False
    least = params.pop("minInstancesPerNode", 1)
    if least > 1:
        share = (least - 0.5) / rows.agg(F.sum(count)).first()[0]
        if share >= 0.5:  # no node can be split
            params["maxDepth"] = 0
        else:
            params["minWeightFractionPerNode"] = share
    model = FAMILIES[name](len(features), 2, featuresCol=column, labelCol=target, weightCol=WEIGHT, **params)
    if model.hasParam("seed") and "seed" not in params:
        model.set(model.getParam("seed"), seed)
    return PipelineModel([*fixed, *Pipeline(stages=[*stages, model]).fit(rows).stages])


def fit(name: str, params: Mapping[str, Any], features: Sequence[str], target: str, df: DataFrame,
        seed: int = 42, weight: str | None = None) -> PipelineModel:
    """The fitted model of two classes; equal rows are fitted once where the family can."""
    if not fits_counts(name, params, weight):
        return make_model(name, params, features, target, seed, weight=weight).fit(df)
    keys = [target, *features, *([weight] if weight else [])]
    return fit_counted(name, params, features, target, counted(df, keys), seed, weight)


def element(vector: str, place: int) -> Column:
    """one element of a vector column; null for a null vector."""
    return F.get(vector_to_array(vector), F.lit(place))


def score_column(scored: DataFrame) -> Column | None:
    """Probability of class 1, else the sigmoid of the margin, else nothing."""
    if "probability" in scored.columns:
        return element("probability", 1)
    if "rawPrediction" in scored.columns:
        return sigmoid(element("rawPrediction", 1))
    return None


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The kept columns with ``prediction`` and, where the family has one, ``score``."""
    out = model.transform(df)
    score = score_column(out)
    extra = [] if score is None else [score.alias("score")]
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"), *extra)


def predict_counted(model: PipelineModel, rows: DataFrame, target: str, count: str = ROWS) -> DataFrame:
    """``predict`` of counted rows, with their class and number.

    A model of binned features sees their cells, which are counted once for all models with the same cuts.
    """
    stage = model.stages[0]
    if isinstance(stage, Bucketizer):
        inputs, cuts = model.stages[1].getInputCols(), stage.getSplitsArray()
        place = ("cells", target, count, *inputs, *map(tuple, cuts))
        rows = _learned(rows, place, lambda: stored(stage.transform(rows).groupBy(target, *inputs).agg(F.sum(count).alias(count))))
        model = PipelineModel(model.stages[1:])
    return predict(model, rows, [target, count])


def importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """K8: importance per feature; for linear families the absolute coefficient."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        values = abs(last.coefficients.toArray())
    elif hasattr(last, "linear"):
        values = abs(last.linear.toArray())
    elif hasattr(last, "models"):
        values = sum(abs(m.coefficients.toArray()) for m in last.models) / len(last.models)
    else:
        raise ValueError(f"{type(last).__name__} has no importance")
    spark = SparkSession.builder.getOrCreate()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def top_features(table: DataFrame, k: int = 3) -> list[str]:
    """L3: the k most important features."""
    rows = table.orderBy(F.desc("importance"), "feature").limit(k).collect()
    return [r["feature"] for r in rows]


def save_model(model: PipelineModel, params: Mapping[str, Any], name: str, folder: str) -> str:
    """The fitted model and its parameters (one JSON row) below ``folder/name``."""
    path = posixpath.join(folder, name)
    model.write().overwrite().save(posixpath.join(path, "model"))
    spark = SparkSession.builder.getOrCreate()
    row = [(name, json.dumps(dict(params), sort_keys=True))]
    spark.createDataFrame(row, "name string, params string").write.mode("overwrite").json(
        posixpath.join(path, "params"))
    return path


def load_model(path: str) -> PipelineModel:
    """The fitted model below a path given by ``save_model``."""
    return PipelineModel.load(posixpath.join(path, "model"))


def score(path: str, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Batch-score rows with a stored model."""
    return predict(load_model(path), df, keep)
