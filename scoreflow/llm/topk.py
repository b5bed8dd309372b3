"""Exact top-k by inner product: columnar branch and bound over blocks of dimensions.

Candidates lie in vertical layout, one array per dimension, in blocks of rows; queries in blocks of
their own. Each block of queries meets each group of candidate blocks in one task. Scores grow by a
few dimensions at a time; the mass that remains (product of the norms of the remaining dimensions)
bounds what a candidate can still gain, and candidates that cannot reach the query's k-th best
score so far are removed and the survivors compacted. The bounds are exact for integers, so is the
result. Each task keeps k rows per query, and a last ranking merges the groups.

Components are floor(64 x). Rows whose vector is null or holds null or non-finite values take no
part. Vectors of different lengths are compared as if padded with zeros. Ties go to the smaller id.
Rows that repeat an id are one query together and candidates each; none is a candidate of its own id.
Sums that may pass 2^63 are made in whole numbers of any size; a component or a score that is
needed and doesn't fit 64 bits ends the query with an error that names it, as no long can hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreflow.llm.common import vectors

SCALE = 64
QUERY_ROWS, CANDIDATE_ROWS, STEP = 4096, 8192, 16
FIRST_ROWS, QUERIES_AT_ONCE = 512, 256
GROUPS = 12  # groups of candidate blocks: the parallel tasks of one block of queries
EXACT, LARGEST = float(1 << 53), float(1 << 63)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as integers, one binary value per row."""
    for batch in batches:
        places, rows = vectors(batch.column(1))
        scaled = [np.floor(SCALE * r) for r in rows]
        if any((np.abs(r) >= LARGEST).any() for r in scaled):
            raise OverflowError("a component of 2^57 or more in size doesn't fit 64 bits when scaled")
        packed = [r.astype("<i8").tobytes() for r in scaled]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(packed, pa.binary())],
                                         names=["id", "v"])


def integer_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns ``id, v`` of rows that take part: little-endian 64-bit integers."""
    rows = table.where(table[key].isNotNull()).select(table[key].cast("long").alias("id"),
                                                      table[vector].cast("array<double>").alias("v"))
    return rows.mapInArrow(_pack, "id long, v binary")


def _matrix(cells: list[bytes], width: int) -> np.ndarray:
    if all(len(c) == 8 * width for c in cells):
        return np.frombuffer(b"".join(cells), "<i8").reshape(-1, width)
    out = np.zeros((len(cells), width), np.int64)
    for row, cell in zip(out, cells):
        row[:len(cell) // 8] = np.frombuffer(cell, "<i8")
    return out


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = [np.zeros(0, np.int64) for _ in ids]
        self.of = [np.zeros(0, np.int64) for _ in ids]

    def least(self) -> np.ndarray:
        """Score that a candidate must reach to matter."""
        return np.array([s[-1] if len(s) == self.k else -np.inf for s in self.score], dtype=np.float64)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        other = ids != self.ids[q]
        score = np.concatenate([self.score[q], score[other]])
        ids = np.concatenate([self.of[q], ids[other]])
        if len(score) > 4 * self.k:
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            near = score >= cut
            score, ids = score[near], ids[near]
        order = np.lexsort((ids, -score))[:self.k]
        self.score[q], self.of[q] = score[order], ids[order]


def search(queries: np.ndarray, best: Best, ids: np.ndarray, rows: np.ndarray) -> int:
    """Take one block of candidates (rows) into account; returns the number of products made."""
    width = queries.shape[1]
    size = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    most = size(queries) * size(rows) * width
    # Doubles hold small sums exactly; sums that long integers can't hold are made of Python's.
    kind = np.float64 if most < EXACT else np.int64 if most < LARGEST else object
    layout, q = np.ascontiguousarray(rows.T, dtype=kind), queries.astype(kind)
    edges = [*range(0, width, STEP), width]
    mass = lambda x: np.sqrt(np.cumsum(np.square(x, dtype=np.float64)[:, ::-1], axis=1)[:, ::-1])
    mass_q, mass_c = mass(queries), mass(rows).T
    made, least = 0, best.least()
    first = edges[min(2, len(edges) - 1)]
    slack = 1e-9
    for i in range(len(q)):
        if i % QUERIES_AT_ONCE == 0:
            start = q[i:i + QUERIES_AT_ONCE, :first] @ layout[:first]
            made += start.size * first
        score, alive = start[i % QUERIES_AT_ONCE], None
        for lo, hi in zip(edges[2:], edges[3:]):
            gain = mass_q[i, lo] * (mass_c[lo] if alive is None else mass_c[lo][alive])
            near = score.astype(np.float64, copy=False)
            rounded = 0.0 if kind is np.float64 else slack * np.abs(near)  # beyond 2^53 doubles round
            can = near + gain * (1 + slack) + rounded + slack >= least[i]
            if not can.all():
                alive = np.flatnonzero(can) if alive is None else alive[can]
                score = score[can]
            part = layout[lo:hi] if alive is None else layout[lo:hi, alive]
            score = score + q[i, lo:hi] @ part
            made += part.size
        near = score.astype(np.float64, copy=False) >= least[i]
        found = ids[near] if alive is None else ids[alive[near]]
        score = score[near]
        if kind is object:
            score, found = score[found != best.ids[i]], found[found != best.ids[i]]
        if kind is object and len(score) and not -(1 << 63) <= min(score) <= max(score) < 1 << 63:
            raise OverflowError("a score doesn't fit 64 bits")
        best.add(i, score.astype(np.int64), found)
    return made


def _search_groups(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def results(best: Best) -> pa.RecordBatch:
        n = [len(s) for s in best.score]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(best.ids, n)), pa.array(np.concatenate(best.of)),
             pa.array(np.concatenate(best.score))], schema=schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (task, kind, ...): the queries of a task come before its candidates."""
        here, best, queries, asked = None, None, None, ([], [])
        ids, cells = [], []

        def look() -> None:
            nonlocal best, queries, asked, ids, cells
            if asked[0]:
                width = max(len(c) for c in asked[1]) // 8
                best, queries, asked = Best(np.array(asked[0], np.int64), k), _matrix(asked[1], width), ([], [])
            if ids and best is not None:
                width = max(queries.shape[1], max(len(c) for c in cells) // 8)
                if width > queries.shape[1]:
                    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                rows, number = _matrix(cells, width), np.array(ids, np.int64)
                # A few candidates first: they give bounds for the rest.
                search(queries, best, number[:FIRST_ROWS], rows[:FIRST_ROWS])
                search(queries, best, number[FIRST_ROWS:], rows[FIRST_ROWS:])
            ids, cells = [], []

        for batch in parts:
            for task, kind, i, v in zip(batch["task"].to_pylist(), batch["kind"].to_pylist(),
                                        batch["id"].to_pylist(), batch["v"]):
                if task != here:
                    look()
                    if best is not None:
                        yield results(best)
                    here, best = task, None
                if kind == 0:
                    asked[0].append(i)
                    asked[1].append(v.as_py())
                else:
                    ids.append(i)
                    cells.append(v.as_py())
                    if len(ids) >= CANDIDATE_ROWS:
                        look()
        look()
        if best is not None:
            yield results(best)
    return batches


def top_k(table: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """Columns ``query_id, rank, vec_id, score``; queries are the rows with ids divisible by ``every``."""
    rows = integer_vectors(table, key, vector)
    asked = rows.where(F.col("id") % every == 0)
    n = asked.count()
    blocks = max(1, -(-n // QUERY_ROWS))
    group = F.pmod(F.xxhash64("id"), F.lit(GROUPS))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
    # A stated query set against all rows in blocks: (query block, candidate group) is a task.
    tasks = lambda b, g: (b * GROUPS + g).alias("task")
    left = asked.select(block.alias("b"), "id", "v").select(
        "b", F.explode(F.expr(f"sequence(0, {GROUPS - 1})")).alias("g"), "id", "v")
    right = rows.select(group.alias("g"), "id", "v").select(
        F.explode(F.expr(f"sequence(0, {blocks - 1})")).alias("b"), "g", "id", "v")
    both = (left.select(tasks(F.col("b"), F.col("g")), F.lit(0).alias("kind"), "id", "v")
            .unionAll(right.select(tasks(F.col("b"), F.col("g")), F.lit(1).alias("kind"), "id", "v")))
    found = (both.repartition("task").sortWithinPartitions("task", "kind")
             .mapInArrow(_search_groups(k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
