"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str, parts: int, rest: int):
    """True where crc32 of the key as text leaves ``rest`` modulo ``parts``; null keys count as ''."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "utf-8")) % parts == rest


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one by one, null as ''; one text at a time is a Python object."""
    for value in column:
        yield value.as_py() or ""


def parts_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of an Arrow list column that hold only finite numbers: their places and values."""
    places, rows = [], []
    for i, value in enumerate(column):
        if not value.is_valid:
            continue
        items = value.values
        if items is None or items.null_count:
            continue
        row = np.asarray(items.to_numpy(zero_copy_only=False), dtype=np.float64)
        if np.isfinite(row).all():
            places.append(i)
            rows.append(row)
    return np.array(places, dtype=np.int64), rows


def expand(lo_a: np.ndarray, n_a: np.ndarray, lo_b: np.ndarray,
           n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of many rectangles [lo_a, lo_a + n_a) x [lo_b, lo_b + n_b)."""
    size = n_a * n_b
    which = np.repeat(np.arange(len(size)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return lo_a[which] + at // n_b[which], lo_b[which] + at % n_b[which]


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) and ``size`` of their group, both long; nulls come first.

    One range sort and counts per partition, so no group has to fit in a task; rows lie in order.
    """
    keys = [*group, *order]
    rows = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    seen = rows.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group)
    before = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"__g{i}" for i in range(len(group))]
    seen = seen.select(F.col("__part").alias("__of"), *[F.col(g).alias(n) for g, n in zip(group, names)],
                       (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"),
                       F.sum("__n").over(whole).alias("size"))
    same = F.col("__part") == F.col("__of")
    for g, n in zip(group, names):
        same &= rows[g].eqNullSafe(F.col(n))
    return rows.join(seen, same).withColumn("rank", F.col("__at") + F.col("__shift")).drop(
        "__at", "__part", "__of", "__shift", *names)


class Forest:
    """Union-find over 0..n-1 whose root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of all pairs; repeated and already joined pairs cost little."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            other = ra != rb
            lo, hi = np.minimum(ra, rb)[other], np.maximum(ra, rb)[other]
            np.minimum.at(self.up, hi, lo)
            a, b = a[other], b[other]

    def link_nearest(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Join the sets of all pairs, nearest pairs first; returns the places of the pairs that did.

        Each round takes the nearest pair of every set that still has one to another set, so the
        pairs returned are a minimum spanning forest of those given.
        """
        place = np.argsort(d, kind="stable")
        used: list[int] = []
        while True:
            ra, rb = self.roots(a[place]), self.roots(b[place])
            other = ra != rb
            place, ra, rb = place[other], ra[other], rb[other]
            if not len(place):
                return np.array(used, dtype=np.int64)
            _, first = np.unique(np.concatenate([ra, rb]), return_index=True)
            for e in np.unique(first % len(place)).tolist():
                x, y = self.find(int(ra[e])), self.find(int(rb[e]))
                if x != y:
                    self.up[max(x, y)] = min(x, y)
                    used.append(int(place[e]))

    def roots(self, at: np.ndarray | None = None) -> np.ndarray:
        """Roots of the given members (all by default), with full path compression of those."""
        at = np.arange(len(self.up)) if at is None else at
        root = self.up[at]
        while True:
            above = self.up[root]
            if np.array_equal(above, root):
                break
            root = above
        self.up[at] = root
        return root
