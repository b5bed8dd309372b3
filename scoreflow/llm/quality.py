"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic scale.

``statistics`` turns each whole text into ``FEATURES`` numbers in one narrow pass. ``fit`` works on
the labelled rows only: means and spreads in one aggregate, then every task adds up the normal
equations of its rows in Fourier space, the partial sums are added on Spark row by row of the
matrix, and the driver solves one (D + 1)-square system. Ridge scores are counted in fixed cells
(a bounded table) and pooled into a non-decreasing calibration. ``score`` applies the model.

All labelled training rows are used. Null texts count as empty; empty texts have a score as any
other. Without labels of both classes the score is the share of class 1 (0.5 without labels).
Repeated rows are scored each; a document with several labels trains with each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.matrices import summed_matrix
from scoreflow.llm.common import texts

FEATURES = (
    "log_bytes", "log_words", "bytes_a_word", "letters", "uppers", "digits", "spaces", "other_bytes",
    "sentence_marks", "bars", "bangs", "symbols", "brackets", "entropy", "distinct_words",
    "repeats_in_a_row", "log_bytes_a_line", "distinct_lines", "log_lines", "capital_words",
)
FOURIER, GAMMA, RIDGE, SEED = 384, 0.03, 1e-3, 11
CELLS_A_UNIT = 1024
SQUASH = 6.0  # standard deviations at which a feature is cut off


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[np.frombuffer(chars, np.uint8)] = 1
    return out


CLASSES = np.stack([
    _mask(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _mask(b"0123456789"), _mask(b" \t\n\r"), _mask(bytes(range(128, 256))), _mask(b".,;:?'\"-"),
    _mask(b"|"), _mask(b"!"), _mask(b"#$%&*@^_~=+/\\"), _mask(b"()[]{}<>")])


def describe(text: str) -> list[float]:
    """The statistics of one text, in the order of FEATURES."""
    data = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(len(data), 1)
    share = count[count > 0] / size
    words, lines = text.split(), text.splitlines()
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(len(data)), np.log1p(len(words)), len(data) / n_words, *(CLASSES @ count / size),
        float(-(share * np.log2(share)).sum()), len(set(words)) / n_words, repeats / n_words,
        np.log1p(len(data) / n_lines), len(set(lines)) / n_lines, np.log1p(len(lines)),
        sum(map(str.isupper, words)) / n_words,
    ]


def _describe_column(column: pa.Array) -> np.ndarray:
    return np.array([describe(t) for t in texts(column)], dtype=np.float64).reshape(-1, len(FEATURES))


def _describe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _describe_column(batch.column(1))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(pa.list_(pa.float64()))],
                                         names=["key", "x"])


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key, x`` for every row: the statistics of the whole text."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_describe_batches, f"key {kind}, x array<double>")


@dataclass
class Model:
    """What a score needs: scaling, Fourier map, weights and the calibration steps."""

    mean: np.ndarray
    spread: np.ndarray
    map: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    cells: np.ndarray
    levels: np.ndarray

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return _fourier(self, x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(x), self.cells, self.levels)


def _fourier(model: Model, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model.mean) / model.spread, -SQUASH, SQUASH)
    waves = np.cos(z @ model.map + model.phase) * np.sqrt(2 / FOURIER)
    return np.column_stack([waves, np.ones(len(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def pooled(cell: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of good / n over sorted cells by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for c, a, g in zip(cell, n, good):
        blocks.append([g, a, c, c])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    ends = np.array([[lo, hi] for _, _, lo, hi in blocks]).ravel()
    level = np.repeat([g / a for g, a, _, _ in blocks], 2)
    keep = np.append(True, np.diff(ends) > 0)
    return ends[keep], level[keep]


def fit(rows: DataFrame) -> Model:
    """The model from labelled statistics: columns ``x, y`` with y 0 or 1; other labels don't train."""
    rows = rows.where("x is not null and y in (0, 1)").select("x", F.col("y").cast("double").alias("y"))
    width = range(len(FEATURES))
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
                   *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in width],
                   *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in width]).first()
    wave = np.random.default_rng(SEED)
    model = Model(np.array([row[f"m{i}"] or 0.0 for i in width]),
                  np.array([row[f"s{i}"] or 1.0 for i in width]),
                  wave.normal(0, np.sqrt(2 * GAMMA), (len(FEATURES), FOURIER)),
                  wave.uniform(0, 2 * np.pi, FOURIER), np.zeros(FOURIER + 1), np.zeros(1),
                  np.array([0.5 if row["y"] is None else row["y"]]))
    if row["y"] is None or row["y"] in (0.0, 1.0):
        return model

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
        total = np.zeros((FOURIER + 1, FOURIER + 2))
        for at in range(0, len(y), 4096):
            z = _fourier(model, x[at:at + 4096])
            total += z.T @ np.column_stack([z, y[at:at + 4096]])
        return total

    whole = summed_matrix(rows, part, (FOURIER + 1, FOURIER + 2))
    gram = whole[:, :-1] + RIDGE * row["n"] * np.diag(np.append(np.full(FOURIER, 1 / FOURIER), 0))
    model.weights = np.linalg.lstsq(gram, whole[:, -1], rcond=None)[0]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor(np.clip(model.ridge(_matrix(batch.column(0))), -1, 2) * CELLS_A_UNIT)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), batch.column(1)],
                                             names=["cell", "y"])

    counted = (rows.mapInArrow(cells, "cell long, y double").groupBy("cell")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).orderBy("cell").collect())
    at = np.array([(r["cell"] + 0.5) / CELLS_A_UNIT for r in counted])  # 3 x CELLS_A_UNIT at most
    model.cells, model.levels = pooled(at, np.array([r["n"] for r in counted]),
                                       np.array([r["good"] for r in counted]))
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """Columns ``key, score`` of rows with statistics."""
    kind = stats.schema["key"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))],
                                             names=["key", "score"])

    return stats.select("key", "x").mapInArrow(batches, f"key {kind}, score double")


def kept(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """All columns of the rows whose text scores ``least`` or more."""
    at = docs.columns.index(text)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield batch.filter(pa.array(model.score(_describe_column(batch.column(at))) >= least))

    return docs.mapInArrow(batches, docs.schema)
