"""Factorisation machines from rows that each stand for several equal ones.

MLlib's machines take no weights. Here the rows lie packed in blocks; an iteration is one pass that adds up
the gradient of each task in numpy, and the step is MLlib's default (AdamW, all rows in every iteration), from
MLlib's own starting point, until its limit or tolerance. The result is MLlib's model class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block for each batch: the inputs, the class and the weight, one line of doubles for each."""
    for batch in rows:
        n = batch.num_rows
        if not n:
            continue
        x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T
        y, w = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "w"))
        if not np.isin(y, (0.0, 1.0)).all():  # null is NaN here
            raise ValueError("the fit needs classes 0 and 1")
        block = np.ascontiguousarray(np.vstack([x, y[None], w[None]]))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["n", "block"])


def gradient(block: np.ndarray, factors: np.ndarray, linear: np.ndarray, intercept: float) -> list[np.ndarray]:
    """Weighted gradients of the logistic loss by factors, linear part and intercept, and the sum of weights."""
    x, y, w = block[:-2], block[-2], block[-1]
    sums, squares = factors.T @ x, x * x
    raw = intercept + linear @ x + 0.5 * ((sums * sums).sum(0) - (factors * factors).sum(1) @ squares)
    with np.errstate(over="ignore"):
        off = (1.0 / (1.0 + np.exp(-raw)) - y) * w
    weighted = x * off
    return [(weighted @ sums.T - (squares @ off)[:, None] * factors).ravel(), weighted.sum(1), off.sum()[None], w.sum()[None]]


def _gradients(factors: np.ndarray, linear: np.ndarray, intercept: float):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(factors.size + linear.size + 2)
        for batch in rows:
            for n, block in zip(batch["n"].to_pylist(), batch["block"]):
                lines = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, n)
                total += np.concatenate(gradient(lines, factors, linear, intercept))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])
    return batches


def fit(machine: FMClassifier, rows: DataFrame, weight: str) -> FMClassificationModel:
    """The machine fitted to ``rows``, of which each counts ``weight`` times.

    The driver gets one gradient for each task and iteration.
    """
    features, label = machine.getFeaturesCol(), machine.getLabelCol()
    lines = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
                         F.col(weight).cast("double").alias("w"))
    blocks = lines.mapInArrow(packed, "n int, block binary").persist()
    try:
        size = rows.select(F.size(vector_to_array(features)).alias("n")).first()
        size = size["n"] if size else 0
        one = rows.sparkSession.createDataFrame([(0.0, Vectors.dense([1.0] * size))], [label, features])
        start = machine.copy({machine.maxIter: 0}).fit(one)
        factors, linear, intercept = start.factors.toArray(), start.linear.toArray(), float(start.intercept)
        k = factors.shape[1]
        w = np.concatenate([factors.ravel(), linear, [intercept]])
        m, v = np.zeros_like(w), np.zeros_like(w)
        rate, penalty, before = machine.getStepSize(), machine.getRegParam(), None
        used = np.concatenate([np.ones(size * k), np.full(size, machine.getFitLinear()), [machine.getFitIntercept()]])
        for step in range(1, machine.getMaxIter() + 1):
            parts = w[:size * k].reshape(size, k), w[size * k:-1], float(w[-1])
            found = blocks.mapInArrow(_gradients(*parts), "g array<double>").toArrow()["g"]
            total = np.sum([np.array(g.as_py()) for g in found], axis=0)
            if not len(found) or not total[-1]:
                break
            g = total[:-1] / total[-1] * used
            m, v = BETA1 * m + (1 - BETA1) * g, BETA2 * v + (1 - BETA2) * g * g
            change = rate * (m / (1 - BETA1 ** step)) / (np.sqrt(v / (1 - BETA2 ** step)) + EPSILON) + penalty * w
            before, w = w, w - change
            if step > 1 and np.linalg.norm(before - w) < machine.getTol() * max(np.linalg.norm(w), 1.0):
                break
    finally:
        blocks.unpersist()
    made = JavaWrapper._new_java_obj(
        "org.apache.spark.ml.classification.FMClassificationModel", machine.uid, float(w[-1]), Vectors.dense(w[size * k:-1]),
        DenseMatrix(size, k, w[:size * k].tolist(), isTransposed=True))
    return machine._copyValues(FMClassificationModel(made))
