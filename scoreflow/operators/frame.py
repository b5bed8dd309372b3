"""Projections, filters and joins that the workflow is written with."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreflow.functions.core import is_missing, require_frame


def subset(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the named columns."""
    return require_frame(df).select(*cols)


def derive(df: DataFrame, new: Mapping[str, Column], rename: Mapping[str, str] | None = None,
           drop: Sequence[str] = ()) -> DataFrame:
    """Add, rename and drop columns in one projection."""
    return require_frame(df).withColumns(dict(new)).withColumnsRenamed(rename or {}).drop(*drop)


def of_class(df: DataFrame, target: str, value: int) -> DataFrame:
    """Rows of one class."""
    return df.filter(F.col(target) == value)


def among(df: DataFrame, col: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose column is in a list (``isin``) or in a one-column table (semi join)."""
    if isinstance(values, DataFrame):
        key = values.columns[0]
        return df.join(values.select(F.col(key).alias(col)), col, "left_semi")
    return df.filter(F.col(col).isin(list(values)))


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with null or NaN in any of the columns."""
    return df.filter(~reduce(lambda a, b: a | b, [is_missing(df, c) for c in cols]))


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace null and NaN with a constant per column."""
    return df.withColumns({
        c: F.when(is_missing(df, c), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
                  name: str = "rn") -> DataFrame:
    """The first k rows of each group; Spark trims to k per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= k)


def left_with(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left equi-join on shared keys."""
    return df.join(other, list(on), "left")


def changed_rows(before: DataFrame, after: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows of ``after`` whose values differ from ``before``, matched by key."""
    same = reduce(lambda a, b: a & b, [
        F.col(f"a.{key}") == F.col(f"b.{key}"),
        *[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]])
    return after.alias("a").join(before.alias("b"), same, "left_anti")


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column,
                salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose ``big`` side may hold a hot key: its rows go to ``salts`` tasks per key.

    ``small`` has one row per key and is repeated ``salts`` times.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def argmax(df: DataFrame, item: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """L2: the item with the largest value (smallest item wins ties), without a sort."""
    per_value = df.groupBy(*by, value).agg(F.min(item).alias(item))
    return per_value.groupBy(*by).agg(F.max_by(item, value).alias(item),
                                      F.max(value).alias(value))
