"""Scans and sinks: parquet, catalog tables, CSV and local rows."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreflow.functions.core import require_frame


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan."""
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table or temporary view."""
    return spark.table(name)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """S3: CSV with a header. Without a schema the types are inferred (one more pass)."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def from_rows(spark: SparkSession, rows: Iterable[Any], schema: str | T.StructType) -> DataFrame:
    """A table from local rows, always with a stated schema."""
    return spark.createDataFrame(list(rows), schema)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Parquet sink."""
    writer = require_frame(df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header, one file per task."""
    require_frame(df).write.mode(mode).option("header", True).csv(path)


def prediction_sample(df: DataFrame, id_col: str, n: int = 1000) -> DataFrame:
    """The first n rows by id, the sample kept beside a stored run."""
    return df.orderBy(id_col).limit(n)


def summary_artifact(df: DataFrame, path: str) -> DataFrame:
    """Write the summary statistics of the numeric columns and return them."""
    from scoreflow.operators.profile import describe

    table = describe(df).withColumn("n", F.col("n").cast("bigint"))
    write_parquet(table, path)
    return read_parquet(df.sparkSession, path)
