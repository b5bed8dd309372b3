"""Encoding of labels by distributed ranks, scaling as fitted MLlib stages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreflow.functions.core import is_missing
from scoreflow.operators.prefix import rank_by


def label_ranks(df: DataFrame, col: str) -> DataFrame:
    """(label, n, index) of a column: frequency order, ties alphabetical.

    Labels are counted, ranked and kept on Spark, however many there are; null is no label.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return rank_by(counts, [F.desc("n"), "label"], "index").withColumn("index", F.col("index").cast("double"))


def with_index(df: DataFrame, ranks: Mapping[str, DataFrame], suffix: str = "_index") -> DataFrame:
    """The index of each column's label, from ``label_ranks``; unseen and missing get the last index.

    A join with each table of labels, which Spark broadcasts if it is small. The number of labels
    is all that reaches the driver.
    """
    for col, table in ranks.items():
        size = float(table.count())
        found = table.select(F.col("label").alias("_label"), F.col("index").alias("_index"))
        df = df.join(found, F.col(col) == F.col("_label"), "left").withColumn(
            col + suffix, F.coalesce("_index", F.lit(size))).drop("_label", "_index")
    return df


def one_hot(df: DataFrame, ranks: Mapping[str, DataFrame], suffix: str = "_onehot", drop_last: bool = True) -> DataFrame:
    """Index, then a sparse vector per column without its last level.

    Missing and unseen labels are the level after all others; with ``drop_last`` theirs is the empty vector.
    """
    out = with_index(df, ranks)
    cols = list(ranks)
    sizes = [ranks[c].count() + (not drop_last) for c in cols]
    schema = T.StructType([*out.schema.fields, *[T.StructField(c + suffix, VectorUDT()) for c in cols]])
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())),
                      ("values", pa.list_(pa.float64()))])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = list(batch.columns)
            for c, size in zip(cols, sizes):
                at = batch[c + "_index"].to_numpy().astype(np.int32)
                there = at < size
                ends = pa.array(np.append(0, np.cumsum(there)).astype(np.int32))
                n = len(at)
                made.append(pa.StructArray.from_arrays(
                    [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                     pa.ListArray.from_arrays(ends, pa.array(at[there])),
                     pa.ListArray.from_arrays(ends, pa.array(np.ones(int(there.sum()))))], fields=list(kind)))
            yield pa.RecordBatch.from_arrays(made, names=[*batch.schema.names, *[c + suffix for c in cols]])

    return out.mapInArrow(batches, schema)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features",
             invalid: str = "error") -> DataFrame:
    """One vector column; ``invalid`` is error, skip or keep."""
    return VectorAssembler(inputCols=list(cols), outputCol=out,
                           handleInvalid=invalid).transform(df)


def scaling(cols: Sequence[str]) -> Pipeline:
    """Stages that give ``features`` (raw) and ``scaled`` (divided by the deviation)."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(cols), outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True)])


def scaled_and_raw(fitted: PipelineModel, df: DataFrame,
                   keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """E5: two frames with the same rows, one per kind of input."""
    both = fitted.transform(df)
    return (both.select(*keep, F.col("scaled").alias("features")),
            both.select(*keep, "features"))


def min_max(cols: Sequence[str]) -> Pipeline:
    """Inputs on [0, 1], as naive Bayes needs."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(cols), outputCol="features"),
        MinMaxScaler(inputCol="features", outputCol="scaled")])


# Which input each family is trained on.
SCALED_FAMILIES = ("logistic", "svc", "mlp", "fm", "ovr", "naive_bayes")
RAW_FAMILIES = ("tree", "forest", "boosted")
MISSING_TOLERANT = RAW_FAMILIES


def input_for(family: str) -> str:
    """``scaled`` or ``raw``."""
    if family in SCALED_FAMILIES:
        return "scaled"
    if family in RAW_FAMILIES:
        return "raw"
    raise ValueError(f"unknown model family {family!r}")


def families_for(has_missing: bool) -> tuple[str, ...]:
    """Tree families when the inputs have missing values, otherwise all."""
    return MISSING_TOLERANT if has_missing else RAW_FAMILIES + SCALED_FAMILIES


def missing_route(df: DataFrame, cols: Sequence[str]
                  ) -> tuple[DataFrame, list[str], tuple[str, ...]]:
    """(frame, input columns, families to train) for inputs that may have missing values.

    With missing values: medians in their place, an indicator for each column that had some,
    and the tree families. Without: the frame as it is and all families.
    """
    from scoreflow.operators.clean import impute
    from scoreflow.operators.profile import missing_profile

    cols = list(cols)
    found = missing_profile(df, cols).filter("n_missing > 0").collect()  # one row per column
    holes = [c for c in cols if c in {r["feature"] for r in found}]
    families = families_for(bool(holes))
    if not holes:
        return df, cols, families
    marked = missing_indicators(df, holes)
    return impute(marked, holes, "median"), cols + [c + "_missing" for c in holes], families


def missing_indicators(df: DataFrame, cols: Sequence[str], suffix: str = "_missing") -> DataFrame:
    """A 0/1 column per input, taken before the imputation."""
    return df.withColumns({c + suffix: is_missing(df, c).cast("double") for c in cols})
