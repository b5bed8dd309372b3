"""K nearest neighbours by a metric index of pivots, with multi-probe and an exact completion.

Pivots are centres of a bounded sample (``SAMPLE`` points, by hash). Every point belongs to the cell of
its nearest pivot; every cell knows its size and covering radius. A point first probes the ``probes``
cells whose pivots are nearest. The k-th distance found so far then bounds the search: another cell
can hold a nearer point only if both

* the distance to its pivot less its covering radius, and
* the distance to the plane between its pivot and the own one

are below that bound. Completion probes just those cells, so the result is exact; without it the
result is that of the probes. Cells beyond ``BLOCK_ROWS`` points are cut into blocks, so a task holds
one block and streams the points that probe it. Equal points are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed
from scoreflow.operators.block_search import first, matrix, probe, squares
from scoreflow.operators.neighbours import one_of_equal, with_equal

SAMPLE = 8_192
MOST_CELLS = 1_024
BLOCK_ROWS = 2_048
MARGIN = 1e-9  # rounding must not lose the k-th neighbour


def centres(sample: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Pivots: points far apart, moved to the means of what is nearest to them."""
    rng = np.random.default_rng(seed)
    found = [sample[rng.integers(len(sample))]]
    apart = ((sample - found[0]) ** 2).sum(1)
    while len(found) < cells and apart.max() > 0:
        found.append(sample[rng.choice(len(sample), p=apart / apart.sum())])
        apart = np.minimum(apart, ((sample - found[-1]) ** 2).sum(1))
    pivots = np.array(found)
    for _ in range(rounds):
        of = squares(sample, pivots).argmin(1)
        count = np.bincount(of, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, of, sample)
        pivots = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], pivots)
    return pivots


def _placed(pivots: np.ndarray, probes: int):
    """Each point with its cell, its distance to the pivot and the cells it probes first."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            far = np.sqrt(squares(matrix(batch["x"], pivots.shape[1]), pivots))
            near = np.argsort(far, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["x"], pa.array(near[:, 0].astype(np.int32)), pa.array(far[np.arange(len(far)), near[:, 0]]),
                 pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["key", "x", "cell", "far", "near"])
    return batches


def _rest(pivots: np.ndarray, radius: np.ndarray):
    """The cells, beyond those probed, that may hold a point nearer than the bound."""
    between = np.sqrt(squares(pivots, pivots))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            far = np.sqrt(squares(matrix(batch["x"], pivots.shape[1]), pivots))
            own = batch["cell"].to_numpy()
            gap = between[own]
            plane = (far ** 2 - (far[np.arange(len(far)), own] ** 2)[:, None]) / np.where(gap > 0, 2 * gap, np.inf)
            least = np.maximum(far - radius, plane)
            bound = batch["bound"].to_numpy(zero_copy_only=False)
            reach = least <= (bound * (1 + MARGIN) + MARGIN)[:, None]
            for i, probed in enumerate(batch["near"].to_pylist()):
                reach[i, probed] = False
            reach &= radius >= 0  # cells with points
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["x"], pa.array([np.flatnonzero(r).astype(np.int32) for r in reach], pa.list_(pa.int32()))],
                names=["key", "x", "near"])
    return batches


def nearest_by_index(points: DataFrame, key: str, cols: Sequence[str], k: int, cells: int | None = None, probes: int = 4,
                     exact: bool = True, seed: int = 42) -> DataFrame:
    """(key, neighbour, distance, rank): the k nearest other points, exact unless ``exact`` is off.

    ``cells`` is the square root of the number of points by default, at most ``MOST_CELLS``. Equal
    distances are ordered by key. Rows with a missing coordinate take no part.
    """
    return _search(points, key, cols, k, cells, probes, exact, seed)[0]


def compared_share(points: DataFrame, key: str, cols: Sequence[str], k: int, cells: int | None = None, probes: int = 4,
                   exact: bool = True, seed: int = 42) -> float:
    """The share of all pairs of different points that a search compares."""
    _, asked, sizes = _search(points, key, cols, k, cells, probes, exact, seed)
    total = sum(sizes.values())
    seen = sum(r["n"] * sizes.get(r["cell"], 0) for r in asked.collect())  # one row per cell
    return seen / max(1, total * total)


def _search(points: DataFrame, key: str, cols: Sequence[str], k: int, cells: int | None, probes: int, exact: bool,
            seed: int) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    rows = points.dropna(subset=list(cols)).select(
        F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    reps = checkpointed(one_of_equal(rows))
    base = reps.select(F.col("rep").alias("key"), "x")
    n, width = base.count(), len(cols)
    sample = np.array([r["x"] for r in base.orderBy(F.md5(F.col("key").cast("string")), "key").limit(SAMPLE).collect()])
    if not n:
        none = base.limit(0)
        asked = none.select(F.lit(0).alias("cell"), F.lit(0).cast("long").alias("n"))
        empty = none.select("key", F.col("key").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
        return empty, asked, {}
    pivots = centres(sample, max(1, min(MOST_CELLS, cells or int(np.sqrt(n)))), seed)
    kind = base.schema["key"].dataType.simpleString()
    placed = checkpointed(base.mapInArrow(
        _placed(pivots, probes), f"key {kind}, x array<double>, cell int, far double, near array<int>"))
    # One row per cell, so at most MOST_CELLS rows reach the driver.
    facts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    sizes = {r["cell"]: r["n"] for r in facts}
    radius = np.full(len(pivots), -1.0)
    radius[[r["cell"] for r in facts]] = [r["radius"] for r in facts]
    blocks = points.sparkSession.createDataFrame([(c, -(-m // BLOCK_ROWS)) for c, m in sizes.items()], "cell int, blocks int")
    found = checkpointed(probe(placed, placed, F.broadcast(blocks), width, k))
    asked = placed.select(F.explode("near").alias("cell"))
    if exact:
        bound = first(found, k).groupBy("key").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("have"))
        bound = bound.select("key", F.when(F.col("have") == k, F.col("kth")).alias("bound"))
        open_ = placed.join(bound, "key", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        more = checkpointed(open_.mapInArrow(_rest(pivots, radius), f"key {kind}, x array<double>, near array<int>")
                            .where(F.size("near") > 0))
        found = found.unionAll(probe(placed, more, F.broadcast(blocks), width, k))
        asked = asked.unionAll(more.select(F.explode("near").alias("cell")))
    best = first(found, k).drop("rank")
    return with_equal(rows, reps, best, k), asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), sizes
