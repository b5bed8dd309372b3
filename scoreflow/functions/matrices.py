"""Sums of small matrices over all rows: each task adds up its part, Spark adds up the parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = "i long, v array<double>"


def _batch(values: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(values), pa.int64()), pa.array(list(values.values()), pa.list_(pa.float64()))],
        names=["i", "v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            by[i] = by.get(i, 0) + v.values.to_numpy()
    yield _batch(by)


def summed_matrix(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray],
                  shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``part(batch)`` over all rows. Only the matrix, of a shape given, reaches the driver.

    The partial matrices are added row by row of the matrix, each row in one place.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += part(batch)
        yield _batch(dict(enumerate(total)))

    out = np.zeros(shape)
    for row in df.mapInArrow(sums, ROWS).repartition("i").mapInArrow(_added, ROWS).collect():
        out[row["i"]] = row["v"]
    return out
