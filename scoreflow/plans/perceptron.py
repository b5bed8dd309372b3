"""Perceptrons from rows that each stand for several equal ones.

MLlib's perceptrons take no weights. Here the rows lie packed in blocks (``factors.packed``); a pass adds up loss
and gradient of each task in numpy, and the steps are MLlib's: L-BFGS with ten corrections and a strong Wolfe line
search, from MLlib's own starting point, until its limit or tolerance. Several machines, as the trials of a search,
step side by side: a pass gives each its next gradient. The results are of MLlib's model class.

The loss is the mean over all rows. MLlib's is the mean over blocks, so its short last blocks weigh more.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.plans.factors import packed

CORRECTIONS, LOOK_BACK = 10, 20
SUFFICIENT, CURVATURE, TRIES = 1e-4, 0.9, 10

Points = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def loss_and_gradient(block: np.ndarray, layers: Sequence[int], w: np.ndarray) -> np.ndarray:
    """Weighted cross entropy of a block, its gradient by the weights, and the sum of the rows' weights."""
    x, y, n = block[:-2], block[-2].astype(int), block[-1]
    parts, inputs, at = [], [x], 0
    for a, b in zip(layers, layers[1:]):
        weights = w[at:at + a * b].reshape(a, b).T  # MLlib's layout: by columns, then the bias
        z = weights @ inputs[-1] + w[at + a * b:at + (a + 1) * b, None]
        parts.append(weights)
        at += (a + 1) * b
        if len(parts) < len(layers) - 1:
            with np.errstate(over="ignore"):
                inputs.append(1.0 / (1.0 + np.exp(-z)))
    z -= z.max(0)
    shares, rows = np.exp(z), np.arange(len(y))
    total = shares.sum(0)
    loss = n @ (np.log(total) - z[y, rows])
    delta = shares / total
    delta[y, rows] -= 1.0
    delta *= n
    out: list[np.ndarray] = []
    for i in range(len(parts) - 1, -1, -1):
        out = [(inputs[i] @ delta.T).ravel(), delta.sum(1), *out]
        if i:
            delta = (parts[i].T @ delta) * inputs[i] * (1.0 - inputs[i])
    return np.concatenate([[loss], *out, [n.sum()]])


def _sums(points: Sequence[tuple[Sequence[int], np.ndarray]]):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(w.size + 2) for _, w in points]
        for batch in rows:
            for n, block in zip(batch["n"].to_pylist(), batch["block"]):
                lines = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, n)
                for t, (layers, w) in zip(total, points):
                    t += loss_and_gradient(lines, layers, w)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(total).tolist()], pa.list_(pa.float64()))], names=["g"])
    return batches


class _NoStep(Exception):
    """The line search found no step."""


def _direction(grad: np.ndarray, history: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out, used = grad.copy(), []
    for step, change in history:
        rho = step @ change
        share = step @ out / rho
        used.append((step, change, rho, share))
        out -= share * change
    if history:
        out *= history[0][0] @ history[0][1] / (history[0][1] @ history[0][1])
    for step, change, rho, share in reversed(used):
        out += (share - change @ out / rho) * step
    if not np.isfinite(out).all():
        raise _NoStep
    return -out


def _between(a: tuple, b: tuple) -> float:
    """Where the cubic through both ends of a bracket is least, not too close to either; ends are (t, slope, value)."""
    (t0, d0, f0), (t1, d1, f1) = sorted((a, b), key=lambda end: end[0])
    middle = d0 + d1 - 3 * (f0 - f1) / (t0 - t1)
    root = np.sqrt(np.float64(middle * middle - d0 * d1))
    t = t1 - (t1 - t0) * (d1 + root - middle) / (d1 - d0 + 2 * root)
    return float(min(max(t, t0 + 0.1 * (t1 - t0)), t0 + 0.9 * (t1 - t0)))


def _step(w: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, first: float) -> Generator:
    """A step of sufficient decrease and small slope: (step, value, gradient there)."""
    slope = float(grad @ direction)
    if not slope <= 0:
        raise _NoStep
    found: dict[float, tuple[float, np.ndarray]] = {}

    def at(t: float) -> Generator:
        found[t] = yield w + t * direction
        return t, float(found[t][1] @ direction), found[t][0]

    t, low, bracket = first, (0.0, slope, value), None
    for i in range(TRIES):
        here = yield from at(t)
        if not np.isfinite(here[2]):
            t /= 2.0
            continue
        if here[2] > value + SUFFICIENT * t * slope or here[2] >= low[2] and i > 0:
            bracket = low, here
        elif abs(here[1]) <= CURVATURE * abs(slope):
            return t, *found[t]
        elif here[1] >= 0:
            bracket = here, low
        if bracket:
            break
        low, t = here, t * 1.5
    if bracket is None:
        raise _NoStep
    low, high = bracket
    for _ in range(TRIES):
        here = yield from at(_between(low, high))
        if here[2] > value + SUFFICIENT * here[0] * slope or here[2] >= low[2]:
            high = here
            continue
        if abs(here[1]) <= CURVATURE * abs(slope):
            return here[0], *found[here[0]]
        if here[1] * (high[0] - low[0]) >= 0:
            high = low
        low = here
    raise _NoStep


def steps(w: np.ndarray, most: int, tol: float) -> Points:
    """L-BFGS as MLlib's perceptrons take it: yields points, is sent (loss, gradient), returns the last point."""
    value, grad = yield w
    start, history, seen, failed, done = value, [], [np.inf], False, 0
    while done < most:
        if len(seen) > 1 and abs(value - max(seen)) <= tol * start or np.linalg.norm(grad) <= max(tol * value, 1e-8):
            break
        try:
            direction = _direction(grad, history)
            length, value_there, grad_there = yield from _step(
                w, value, grad, direction, 1.0 if done else 1.0 / np.linalg.norm(direction))
            if length * np.linalg.norm(grad) < 1e-10:
                raise _NoStep
        except _NoStep:
            if failed:
                break
            failed, history = True, []
            continue
        step, failed, done = length * direction, False, done + 1
        history = [(step, grad_there - grad), *history][:CORRECTIONS]
        w, value, grad = w + step, value_there, grad_there
        seen = [*seen, value][-LOOK_BACK:]
    return w


def fit(machines: Sequence[MultilayerPerceptronClassifier], rows: DataFrame, weight: str
        ) -> list[MultilayerPerceptronClassificationModel | Exception]:
    """The machines, which share inputs and label, fitted to ``rows``, of which each counts ``weight`` times.

    One that can't be fitted gives its error. The driver gets one gradient for each machine, task and pass.
    """
    spark, features, label = rows.sparkSession, machines[0].getFeaturesCol(), machines[0].getLabelCol()
    lines = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
                        F.col(weight).cast("double").alias("w"))
    blocks = lines.mapInArrow(packed, "n int, block binary").persist()
    out: list = [None] * len(machines)
    running: dict[int, tuple[list[int], Points, np.ndarray]] = {}
    try:
        for i, machine in enumerate(machines):
            try:
                layers = list(machine.getLayers())
                one = spark.createDataFrame([(0.0, Vectors.dense([1.0] * layers[0]))], [label, features])
                start = machine.copy({machine.maxIter: 0}).fit(one).weights.toArray()
                points = steps(start, machine.getMaxIter(), machine.getTol())
                running[i] = layers, points, next(points)
            except Exception as error:  # noqa: BLE001 - belongs to this machine alone
                out[i] = error
        while running:
            found = blocks.mapInArrow(_sums([(layers, w) for layers, _, w in running.values()]), "g array<double>").toArrow()["g"]
            total = np.sum([g.values.to_numpy() for g in found], axis=0) if len(found) else np.zeros(1)
            if not total[-1]:
                raise ValueError("no rows to fit")
            for i, (layers, points, w) in list(running.items()):
                mine, total = total[:w.size + 2], total[w.size + 2:]
                try:
                    running[i] = layers, points, points.send((mine[0] / mine[-1], mine[1:-1] / mine[-1]))
                except StopIteration as end:
                    del running[i]
                    made = JavaWrapper._new_java_obj(
                        "org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel", machines[i].uid,
                        Vectors.dense(end.value))
                    out[i] = machines[i]._copyValues(MultilayerPerceptronClassificationModel(made))
    finally:
        blocks.unpersist()
    return out
