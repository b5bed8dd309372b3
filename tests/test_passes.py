"""Frames that several passes read are computed once, and few strata never gather rows in one task."""

import datetime

import pytest
from pyspark.sql import functions as F

from scoreflow.catalog import QUERIES
from scoreflow.operators import association, mice, sampling, stability

SF = "/root/testdata/sf0.001"


@pytest.fixture
def counted(spark):
    """A frame that counts how often its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def made(i):
        seen.add(1)
        hole = None if i % 7 == 0 else float(i % 11)
        return i, datetime.date(2024, 1 + i % 6, 1), int(i % 3 == 0), hole, float(i % 5 + i % 13)

    shape = "id long, date date, target int, a double, b double"
    return spark.createDataFrame(spark.sparkContext.range(0, 210, 1, 4).map(made), shape), seen


def test_monthly_index_computes_its_rows_once(counted):
    df, seen = counted
    assert stability.psi_mean_by_month(df, "date", ["a", "b"]).count() == 2 and seen.value == 210


def test_areas_compute_their_rows_once(counted):
    df, seen = counted
    assert association.univariate_ranks(df, ["a", "b"], "target").count() == 2 and seen.value == 210


def test_imputation_computes_its_rows_once(counted):
    df, seen = counted
    out = mice.mice_impute(df.select("id", "a", "b"), "id", max_iter=2)
    assert out.filter("a is null").count() == 0 and seen.value == 210


@pytest.mark.parametrize("name", ["w3_ntile_missing", "b1_bands_missing", "l8_stratified_balanced", "l8_stratified_imbalanced"])
def test_joined_frame_is_read_from_where_it_was_stored(spark, name):
    files = QUERIES[name](spark, SF).inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_few_strata_are_broadcast(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 2).alias("target"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        train, test = sampling.split(df, "id", 0.2, stratify="target")
        plan = test._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert test.count() == 600 and train.count() == 2400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
