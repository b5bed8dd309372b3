"""Comparing, cross-validating, tuning and tracking models.

The loops over models, folds and trials run on the driver, as in any MLlib search; each
step of a loop is a Spark fit over all rows. Only metric values reach the driver.
"""

from __future__ import annotations

import posixpath
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreflow.functions import core
from scoreflow.functions.core import bounded_rows, stored
from scoreflow.operators import metrics
from scoreflow.operators.sampling import fold_of, split
from scoreflow.plans.models import (BINNED, ROWS, counted, fit_counted, fit_perceptrons, fits_counts, importance, load_model,
                                    make_model, predict, predict_counted, save_model)
from scoreflow.sources import runlog
from scoreflow.sources.tables import prediction_sample, summary_artifact, write_parquet

ITERATED = ("fm", "boosted", "mlp")
FOLDS_AT_ONCE = 4  # folds of counted rows that are fitted concurrently
MODELS_AT_ONCE = 4  # families of a comparison that are fitted concurrently
BOARD = "model string, split string, metric string, value double, error string"

# The search spaces. (low, high) is a range, three parts with "log" a
# logarithmic one; whole numbers stay whole; a list is a choice.
QUICK: dict[str, dict[str, Any]] = {
    "logistic": {"regParam": (0.01, 10.0, "log"), "elasticNetParam": (0.0, 1.0)},
    "tree": {"maxDepth": (2, 10), "minInstancesPerNode": (1, 10)},
    "forest": {"numTrees": (10, 100), "maxDepth": (2, 10)},
    "boosted": {"maxIter": (10, 100), "maxDepth": (2, 10)},
    "svc": {"regParam": (0.01, 10.0, "log"), "maxIter": (10, 100)},
    "naive_bayes": {"smoothing": (0.0, 10.0)},
    "mlp": {"hidden": (2, 10), "maxIter": (10, 100)},
    "fm": {"factorSize": (2, 10), "regParam": (0.01, 10.0, "log")},
    "ovr": {"regParam": (0.01, 10.0, "log"), "elasticNetParam": (0.0, 1.0)},
}
CREDIT: dict[str, dict[str, Any]] = {
    "logistic": {"regParam": (1e-3, 10.0, "log"), "elasticNetParam": (0.0, 0.9),
                 "maxIter": (50, 150), "threshold": (0.3, 0.7)},
    "tree": {"maxDepth": (3, 8), "minInstancesPerNode": (20, 100), "minInfoGain": (0.01, 0.1),
             "impurity": ["gini", "entropy"], "maxBins": [32]},
    "forest": {"numTrees": (30, 100), "maxDepth": (4, 8), "minInstancesPerNode": (15, 50),
               "subsamplingRate": (0.7, 0.9),
               "featureSubsetStrategy": ["sqrt", "log2", "onethird"]},
    "boosted": {"maxIter": (20, 80), "maxDepth": (3, 6), "stepSize": (0.05, 0.2),
                "subsamplingRate": (0.6, 0.9), "minInstancesPerNode": (20, 50)},
    "svc": {"regParam": (1e-4, 10.0, "log"), "maxIter": (50, 200), "threshold": (0.3, 0.7),
            "aggregationDepth": (2, 10)},
    "naive_bayes": {"smoothing": (0.5, 5.0), "modelType": ["multinomial"],
                    "class_threshold": (0.3, 0.7)},
    "mlp": {"hidden1": (10, 50), "hidden2": (5, 20), "maxIter": (50, 150),
            "blockSize": [32, 64, 128], "solver": ["l-bfgs", "gd"],
            "stepSize": (1e-5, 0.1, "log"), "tol": (1e-6, 1e-3, "log")},
    "fm": {"factorSize": (2, 8), "regParam": (0.01, 0.1), "stepSize": (0.001, 0.1),
           "initStd": (0.01, 1.0), "maxIter": (50, 300)},
    "ovr": {"regParam": (0.01, 10.0, "log"), "elasticNetParam": (0.0, 1.0),
            "maxIter": (50, 200), "threshold": (0.3, 0.7), "parallelism": (1, 4)},
}


def draw(space: Mapping[str, Any], rng: random.Random) -> dict[str, Any]:
    """One random point of a search space."""
    out: dict[str, Any] = {}
    for key, spec in space.items():
        if isinstance(spec, list):
            out[key] = rng.choice(spec)
        elif len(spec) == 3:
            import math

            out[key] = math.exp(rng.uniform(math.log(spec[0]), math.log(spec[1])))
        elif all(isinstance(v, int) for v in spec):
            out[key] = rng.randint(*spec)
        else:
            out[key] = rng.uniform(*spec)
    if "class_threshold" in out:  # naive Bayes takes one threshold per class
        t = out.pop("class_threshold")
        out["thresholds"] = [1.0 - t, t]
    return out


def measure(predicted: DataFrame, target: str, count: str | None = None) -> dict[str, float]:
    """M9 as a dictionary: at most a dozen numbers. ``count`` is the number of rows that a row stands for."""
    return measure_all([predicted], target, count)[0]


def measure_all(predicted: Sequence[DataFrame], target: str, count: str | None = None) -> list[dict[str, float]]:
    """``measure`` of each frame, as groups of one table: the jobs of one serve all."""
    number = F.count(F.lit(1)) if count is None else F.sum(count).cast("long")
    ranked = any("score" in df.columns for df in predicted)

    def part(i: int, df: DataFrame) -> DataFrame:
        score = F.col("score") if "score" in df.columns else F.lit(None).cast("double")
        kept = df.filter(F.col(target).isNotNull()).select(
            target, "prediction", *([count] if count else []), *([score.alias("score")] if ranked else []))
        # The rows are scored once; everything else comes from their counts.
        return kept.groupBy(target, "prediction", *(["score"] if ranked else [])).agg(
            number.alias("_rows")).withColumn("_of", F.lit(i))

    # Written, not cached: the plans of the metrics then start at a file and not at all the models again.
    counts = core.stored(reduce(DataFrame.unionByName, [part(i, df) for i, df in enumerate(predicted)]))
    out: list[dict[str, float]] = [dict.fromkeys(metrics.METRICS[:4]) for _ in predicted]
    # Unlabelled rows are no class of their own.
    two = bounded_rows(counts.groupBy("_of").agg(((F.min(target) == 0) & (F.max(target) == 1) & (
        F.count_if(~F.col(target).isin(0, 1)) == 0)).alias("two")), len(predicted), "frames")
    two = [r["_of"] for r in two if r["two"]]
    if two and len(two) < len(predicted) and ranked:
        counts = counts.withColumn("score", F.when(F.col("_of").isin(two), F.col("score")))
    found = metrics.evaluate(counts, target, "prediction", "score" if two and ranked else None, "_rows", ["_of"])
    for r in bounded_rows(found, len(metrics.METRICS) * len(predicted), "metrics"):
        out[r["_of"]][r["metric"]] = r["value"]
    return out


def fit_model(name: str, params: Mapping[str, Any], train: DataFrame, features: Sequence[str], target: str, seed: int = 42,
              n_classes: int = 2, weight: str | None = None) -> PipelineModel:
    """Fit on ``train``; counted frames have a column ``ROWS``."""
    if ROWS in train.columns:
        return fit_counted(name, params, features, target, train, seed, weight)
    return make_model(name, params, features, target, seed, n_classes, weight).fit(train)


def fit_measure(name: str, params: Mapping[str, Any], train: DataFrame,
                tests: Mapping[str, DataFrame], features: Sequence[str], target: str,
                seed: int = 42, n_classes: int = 2, weight: str | None = None
                ) -> tuple[PipelineModel, dict[str, dict[str, float]]]:
    """Fit on ``train`` and measure on every named frame; counted frames have a column ``ROWS``.

    Families that read their rows in many iterations count them first.
    """
    if name in ITERATED and n_classes == 2 and ROWS not in train.columns and fits_counts(name, params, weight):
        train = counted(train, [target, *features, *([weight] if weight else [])])
        tests = {k: counted(df, [target, *features]) for k, df in tests.items()}
    model = fit_model(name, params, train, features, target, seed, n_classes, weight)
    count = ROWS if ROWS in train.columns else None
    return model, {k: measure(_predicted(model, df, target), target, count) for k, df in tests.items()}


def _predicted(model: PipelineModel, test: DataFrame, target: str) -> DataFrame:
    return predict_counted(model, test, target) if ROWS in test.columns else predict(model, test, [target])


def measure_models(fitted: Sequence[PipelineModel | Exception], tests: Sequence[DataFrame], target: str
                   ) -> list[dict[str, float] | Exception]:
    """The measures of each model on its frame, or its error; the frames are all counted or all not."""
    good = [(m, t) for m, t in zip(fitted, tests) if not isinstance(m, Exception)]
    count = ROWS if ROWS in tests[0].columns else None
    try:
        made = iter(measure_all(each([lambda m=m, t=t: _predicted(m, t, target) for m, t in good], FOLDS_AT_ONCE),
                                target, count) if good else [])
        return [m if isinstance(m, Exception) else next(made) for m in fitted]
    except Exception as error:  # noqa: BLE001 - reported in the table
        if len(fitted) == 1:
            return [error]
        return [measure_models([m], [t], target)[0] for m, t in zip(fitted, tests)]  # the fault is one model's


def as_board(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Leaderboard in long form: one row per (model, split, metric), errors in their own rows."""
    return spark.createDataFrame([tuple(r) for r in rows], BOARD)


def rank(board: DataFrame, metric: str, split_name: str) -> DataFrame:
    """L4: models by a metric, best first, ties by name."""
    return board.filter((F.col("metric") == metric) & (F.col("split") == split_name)).orderBy(
        F.desc_nulls_last("value"), "model")


def metrics_table(board: DataFrame, split_name: str) -> DataFrame:
    """One row per model, one column per metric."""
    return board.filter((F.col("split") == split_name) & F.col("metric").isNotNull()).groupBy(
        "model").pivot("metric", list(metrics.METRICS)).agg(F.first("value"))


@dataclass
class Comparison:
    board: DataFrame
    best: str
    params: dict[str, Any]
    model: PipelineModel
    trials: DataFrame | None = None
    models: dict[str, PipelineModel] = field(default_factory=dict)


def each(tasks: Sequence[Callable[[], Any]], parallelism: int) -> list[Any]:
    """Run Spark jobs one after the other, or a few at once as ``CrossValidator`` does."""
    if parallelism <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(t)) for t in tasks]]


def cross_validate(name: str, params: Mapping[str, Any], df: DataFrame, id_col: str,
                   features: Sequence[str], target: str, folds: int = 5, seed: int = 42,
                   n_classes: int = 2, weight: str | None = None) -> dict[str, float]:
    """Mean of every metric over the folds, KS included."""
    extra = [weight] if weight else []
    if n_classes == 2 and fits_counts(name, params, weight):
        return _over_folds(name, params, counted_folds(df, id_col, [target, *features, *extra], folds, seed), features, target,
                           seed, n_classes, weight)
    marked = df.select(id_col, target, *features, *extra, fold_of(id_col, folds, seed).alias("_fold")).persist()
    try:
        return _over_folds(name, params, [(marked.filter(F.col("_fold") != k), marked.filter(F.col("_fold") == k))
                                          for k in range(folds)], features, target, seed, n_classes, weight)
    finally:
        marked.unpersist()


def counted_folds(df: DataFrame, id_col: str, keys: Sequence[str], folds: int, seed: int) -> list[tuple[DataFrame, DataFrame]]:
    """Training and test rows of each fold, as counted frames of one stored table: equal rows once, with their number in
    each fold. Fits that are given the same list share what they learn of a fold's rows first (scales, cells)."""
    return folds_and_rows(df, id_col, keys, [folds], seed)[0][folds]


def folds_and_rows(df: DataFrame, id_col: str, keys: Sequence[str], numbers: Sequence[int], seed: int
                   ) -> tuple[dict[int, list[tuple[DataFrame, DataFrame]]], DataFrame]:
    """``counted_folds`` for several numbers of folds, and all rows counted, from one pass over the rows."""
    numbers = sorted(set(numbers))
    marked = df.select(*keys, *[fold_of(id_col, n, seed).alias(f"_fold{n}") for n in numbers])
    names = {n: [f"{ROWS}{n}_{k}" for k in range(n)] for n in numbers}
    table = stored(marked.groupBy(*keys).agg(*[
        F.count_if(F.col(f"_fold{n}") == k).cast("double").alias(c) for n in numbers for k, c in enumerate(names[n])]))
    total = sum((F.col(c) for c in names[numbers[0]][1:]), F.col(names[numbers[0]][0]))
    part = lambda number: table.select(*keys, number.alias(ROWS)).where(F.col(ROWS) > 0)
    return {n: [(part(total - F.col(c)), part(F.col(c))) for c in names[n]] for n in numbers}, part(total)


def _over_folds(name: str, params: Mapping[str, Any], pairs: Sequence[tuple[DataFrame, DataFrame]], features: Sequence[str],
                target: str, seed: int, n_classes: int, weight: str | None) -> dict[str, float]:
    if ROWS in pairs[0][0].columns:
        found = _points_over_folds(name, [params], pairs, features, target, seed, n_classes, weight)[0]
        if isinstance(found, Exception):
            raise found
        return found
    return _means([fit_measure(name, params, train, {"fold": test}, features, target, seed, n_classes, weight)[1]["fold"]
                   for train, test in pairs])


def _means(results: Sequence[Mapping[str, float]]) -> dict[str, float]:
    keys = sorted({k for r in results for k in r})
    return {k: sum(r[k] for r in results if r.get(k) is not None)
            / max(1, sum(r.get(k) is not None for r in results)) for k in keys}


def _points_over_folds(name: str, points: Sequence[Mapping[str, Any]], pairs: Sequence[tuple[DataFrame, DataFrame]],
                       features: Sequence[str], target: str, seed: int, n_classes: int, weight: str | None
                       ) -> list[dict[str, float] | Exception]:
    """Mean of every metric over counted folds for each point, or its error.

    Perceptrons of a frame share their passes. Trees see cells only, so that all points are measured at once.
    """
    def one(params: Mapping[str, Any], train: DataFrame) -> PipelineModel | Exception:
        try:
            return fit_measure(name, params, train, {}, features, target, seed, n_classes, weight)[0]
        except Exception as error:  # noqa: BLE001 - belongs to this point alone
            return error

    def abreast(train: DataFrame) -> list[PipelineModel | Exception]:
        try:
            return fit_perceptrons(points, features, target, train, seed)
        except Exception as error:  # noqa: BLE001 - reported in the table
            return [error] * len(points)

    # Counted folds are small for their fits, whose many short jobs leave cores idle one after the other.
    if name == "mlp":
        fitted = list(zip(*[abreast(train) for train, _ in pairs]))
    else:
        every = each([lambda p=p, t=train: one(p, t) for p in points for train, _ in pairs], FOLDS_AT_ONCE)
        fitted = [every[i:i + len(pairs)] for i in range(0, len(every), len(pairs))]
    tests = [test for _, test in pairs]
    at_once = len(points) if name in BINNED or name == "mlp" and len(pairs) == 1 else 1
    groups = [[m for ms in fitted[i:i + at_once] for m in ms] for i in range(0, len(points), at_once)]
    found = sum(each([lambda g=g: measure_models(g, tests * (len(g) // len(tests)), target) for g in groups], FOLDS_AT_ONCE), [])
    by_point = [found[i:i + len(pairs)] for i in range(0, len(found), len(pairs))]
    return [next((r for r in rs if isinstance(r, Exception)), None) or _means(rs) for rs in by_point]


def search(name: str, train: DataFrame, test: DataFrame | None, id_col: str,
           features: Sequence[str], target: str, metric: str, n_trials: int = 10,
           seed: int = 42, space: Mapping[str, Any] | None = None, folds: int = 3,
           parallelism: int = 1, n_classes: int = 2, weight: str | None = None,
           pairs: Sequence[tuple[DataFrame, DataFrame]] | None = None) -> tuple[dict[str, Any], DataFrame]:
    """Seeded random search; returns (best parameters, table of trials).

    Without ``test`` each trial is measured by cross-validation, of ``pairs`` if the counted folds are
    there already. A trial that fails has no value; the search goes on.
    """
    rng = random.Random(seed)
    points = [draw(space or QUICK[name], rng) for _ in range(n_trials)]
    keys = [target, *features, *([weight] if weight else [])]
    # Equal rows are counted once for all trials.
    counts = n_classes == 2 and all(fits_counts(name, p, weight) for p in points)
    if counts:
        if test is None:
            pairs = pairs or counted_folds(train, id_col, keys, folds, seed)
        elif ROWS not in train.columns:
            train, test = counted(train, keys), counted(test, [target, *features])

    def trial(params: dict[str, Any]) -> tuple[float | None, str | None]:
        try:
            if test is None:
                found = cross_validate(name, params, train, id_col, features, target, folds,
                                       seed, n_classes, weight)
            else:
                found = fit_measure(name, params, train, {"t": test}, features, target, seed,
                                    n_classes, weight)[1]["t"]
        except Exception as error:  # noqa: BLE001 - reported in the table
            return None, str(error)
        return found.get(metric), None

    if counts:
        results = _points_over_folds(name, points, pairs if test is None else [(train, test)], features, target, seed,
                                     n_classes, weight)
        done = [(None, str(r)) if isinstance(r, Exception) else (r.get(metric), None) for r in results]
    else:
        done = each([lambda p=p: trial(p) for p in points], parallelism)
    values = [v for v, _ in done]
    usable = [(v, -i) for i, v in enumerate(values) if v is not None]
    if not usable:
        raise ValueError(f"no trial of {name} gave a {metric}")
    best = points[-max(usable)[1]]
    rows = [(i, name, str(sorted(p.items())), metric, v, e)
            for i, (p, (v, e)) in enumerate(zip(points, done))]
    table = train.sparkSession.createDataFrame(
        rows, "trial int, model string, params string, metric string, value double, error string")
    return best, table


def compare_models(df: DataFrame, id_col: str, features: Sequence[str], target: str,
                   models: Mapping[str, Mapping[str, Any]], metric: str = "ks",
                   n_trials: int = 10, seed: int = 42, test_share: float = 0.2,
                   n_classes: int = 2, space: Mapping[str, Any] | None = None,
                   weight: str | None = None) -> Comparison:
    """Fit all models, rank them, tune the winner and add it as ``<name>_tuned``.

    A model that fails leaves its error text in the leaderboard.
    """
    spark = df.sparkSession
    extra = [weight] if weight else []
    train, test = split(df.select(id_col, target, *features, *extra), id_col, test_share, seed)
    train, test = train.persist(), test.persist()  # read again by every model
    once: list[DataFrame] = []
    counting = Lock()

    def frames(name: str, params: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
        """Equal rows once for families that take counts, counted when the first one asks."""
        if n_classes != 2 or not fits_counts(name, params, weight):
            return train, test
        with counting:
            if not once:
                once.extend([counted(train, [target, *features, *extra]), counted(test, [target, *features])])
        return once[0], once[1]

    def one(name: str, params: Mapping[str, Any]) -> PipelineModel | Exception:
        try:
            return fit_model(name, params, frames(name, params)[0], features, target, seed, n_classes, weight)
        except Exception as error:  # noqa: BLE001 - reported in the table
            return error

    try:
        rows, fitted, values = [], {}, {}
        # The families' many short jobs leave cores idle one after the other.
        results = each([lambda n=n, p=p: one(n, p) for n, p in models.items()], MODELS_AT_ONCE)
        # Equal rows get equal predictions, so the counted test rows serve every family.
        found = measure_models(results, [once[1] if once else test] * len(results), target)
        for name, model, result in zip(models, results, found):
            if isinstance(result, Exception):
                rows.append((name, "test", None, None, str(result)))
                continue
            fitted[name], values[name] = model, result
            rows += [(name, "test", k, v, None) for k, v in result.items()]
        ranked = [n for n in values if values[n].get(metric) is not None]
        if not ranked:
            raise ValueError(f"no model gave a {metric}")
        best = min(ranked, key=lambda n: (-values[n][metric], n))
        params, trials = dict(models[best]), None
        if n_trials > 0:
            params, trials = search(best, train, test, id_col, features, target, metric,
                                    n_trials, seed, space, n_classes=n_classes, weight=weight)
            tuned = f"{best}_tuned"
            rows_in, rows_out = frames(best, params)
            fitted[tuned], found = fit_measure(best, params, rows_in, {"test": rows_out}, features,
                                               target, seed, n_classes, weight)
            rows += [(tuned, "test", k, v, None) for k, v in found["test"].items()]
            best = tuned
        return Comparison(as_board(spark, rows), best, params, fitted[best], trials, fitted)
    finally:
        train.unpersist()
        test.unpersist()


def dev_oot_run(dev: DataFrame, oot: DataFrame, id_col: str, features: Sequence[str],
                target: str, models: Mapping[str, Mapping[str, Any]], metric: str = "ks",
                folds: int = 5, tune_folds: int = 3, n_trials: int = 10, seed: int = 42,
                folder: str | None = None, space: Mapping[str, Any] | None = None,
                weight: str | None = None) -> Comparison:
    """Cross-validate every model, pick the winner out of time, tune it by
    cross-validation, refit it on all development rows and score it out of time."""
    spark = dev.sparkSession
    keys = [target, *features, *([weight] if weight else [])]
    dev, oot = dev.select(id_col, *keys), oot.select(id_col, target, *features)
    # Counted rows are read once; only families that need every row read them again and again.
    kept = [] if all(fits_counts(n, p, weight) for n, p in models.items()) else [dev.persist(), oot.persist()]
    once: list[Any] = []

    def counts() -> tuple[dict[int, list[tuple[DataFrame, DataFrame]]], DataFrame, DataFrame]:
        """Counted folds of both numbers, all development rows and the later ones, when a family asks for them."""
        if not once:
            once.extend([*folds_and_rows(dev, id_col, keys, [folds, tune_folds], seed), counted(oot, [target, *features])])
        return once[0], once[1], once[2]

    def cross(name: str, params: Mapping[str, Any]) -> dict[str, float]:
        if not fits_counts(name, params, weight):
            return cross_validate(name, params, dev, id_col, features, target, folds, seed, weight=weight)
        return _over_folds(name, params, counts()[0][folds], features, target, seed, 2, weight)

    def refit(name: str, params: Mapping[str, Any]) -> tuple[PipelineModel, dict[str, float]]:
        rows_in, rows_out = counts()[1:] if fits_counts(name, params, weight) else (dev, oot)
        model, found = fit_measure(name, params, rows_in, {"oot": rows_out}, features, target, seed, weight=weight)
        return model, found["oot"]

    try:
        rows, values = [], {}
        for name, params in models.items():
            try:
                cv = cross(name, params)
                _, found = refit(name, params)
            except Exception as error:  # noqa: BLE001 - reported in the table
                rows.append((name, "cv", None, None, str(error)))
                continue
            values[name] = found
            rows += [(name, "cv", k, v, None) for k, v in cv.items()]
            rows += [(name, "oot", k, v, None) for k, v in found.items()]
        ranked = [n for n in values if values[n].get(metric) is not None]
        if not ranked:
            raise ValueError(f"no model gave a {metric}")
        best = min(ranked, key=lambda n: (-values[n][metric], n))
        params, trials = dict(models[best]), None
        if n_trials > 0:
            params, trials = search(best, dev, None, id_col, features, target, metric, n_trials,
                                    seed, space, tune_folds, weight=weight, pairs=once[0][tune_folds] if once else None)
        model, found = refit(best, params)
        tuned = f"{best}_tuned"
        rows += [(tuned, "oot", k, v, None) for k, v in found.items()]
        if folder is not None:
            save_model(model, params, tuned, folder)
        return Comparison(as_board(spark, rows), tuned, params, model, trials, {tuned: model})
    finally:
        for df in kept:
            df.unpersist()


def tracked_run(train: DataFrame, test: DataFrame, id_col: str, features: Sequence[str],
                target: str, folder: str, name: str = "forest",
                params: Mapping[str, Any] | None = None, seed: int = 42) -> dict[str, Any]:
    """Fit one model and store metrics, importance, a prediction sample, the summary of
    the inputs and the model below ``folder``."""
    spark = train.sparkSession
    params = {"numTrees": 50, "maxDepth": 7} if params is None else dict(params)
    run_id = runlog.new_run()
    home = posixpath.join(folder, run_id)
    model, found = fit_measure(name, params, train, {"test": test}, features, target, seed)
    path = save_model(model, params, name, home)
    write_parquet(importance(model, features), posixpath.join(home, "importance"))
    write_parquet(prediction_sample(predict(model, test, [id_col, target]), id_col),
                  posixpath.join(home, "predictions"))
    summary_artifact(train.select(*features), posixpath.join(home, "summary"))
    runlog.log_run(spark, posixpath.join(folder, "runs"), run_id, name, params, found["test"],
                   path)
    return {"run_id": run_id, "path": path, "home": home, "metrics": found["test"]}


def score_runs(paths: Mapping[str, str], df: DataFrame, target: str,
               metric: str = "ks") -> DataFrame:
    """Score stored models on one frame, tabulate the metrics and mark the best."""
    rows = []
    for name, path in paths.items():
        found = measure(predict(load_model(path), df, [target]), target)
        rows += [(name, "scored", k, v, None) for k, v in found.items()]
    usable = [(r[3], r[0]) for r in rows if r[2] == metric and r[3] is not None]
    best = min(usable, key=lambda x: (-x[0], x[1]))[1] if usable else None
    return as_board(df.sparkSession, rows).withColumn("best", F.col("model") == F.lit(best))
