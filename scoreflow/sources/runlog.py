"""Parameters, metrics and model paths of runs, as an append-only parquet table."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, ts timestamp, model string, kind string, key string, value string"


def new_run() -> str:
    return uuid.uuid4().hex


def log_run(spark: SparkSession, path: str, run_id: str, model: str,
            params: Mapping[str, Any] | None = None, metrics: Mapping[str, Any] | None = None,
            model_path: str | None = None) -> None:
    """Append the facts of one run."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = [(run_id, now, model, "param", str(k), str(v)) for k, v in (params or {}).items()]
    rows += [(run_id, now, model, "metric", str(k), repr(float(v)))
             for k, v in (metrics or {}).items() if v is not None]
    if model_path is not None:
        rows.append((run_id, now, model, "model", "path", model_path))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def run_metrics(runs: DataFrame) -> DataFrame:
    """(run_id, model, metric, value) of every logged run."""
    return runs.filter(F.col("kind") == "metric").select(
        "run_id", "model", F.col("key").alias("metric"), F.col("value").cast("double"))


def best_run(runs: DataFrame, metric: str) -> DataFrame:
    """The run with the highest value of a metric, ties by model name."""
    return run_metrics(runs).filter(F.col("metric") == metric).orderBy(
        F.desc_nulls_last("value"), "model").limit(1)
