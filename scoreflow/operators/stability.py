"""Population stability between months and windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreflow.functions.core import (bounded_rows, checkpointed, edge_bin, equal_width_bin, known,
                                      month_of, stored)
from scoreflow.operators.prefix import quantiles, running_sums
from scoreflow.operators.profile import column_quantiles, median_fill

EPSILON = 1e-6
PSI_SCHEMA = "feature string, month string, baseline string, psi double"


def months_of(df: DataFrame, date: str) -> list[str]:
    """Sorted ``yyyy-MM`` keys of a frame: one for each calendar month."""
    months = df.filter(F.col(date).isNotNull()).select(month_of(F.col(date)).alias("m")).distinct()
    return sorted(r["m"] for r in months.collect())


def _window(months: Sequence[str]) -> tuple[Column, Column]:
    """First day of the first month, first day after the last: a filter on plain dates."""
    first = F.to_date(F.lit(months[0] + "-01"))
    return first, F.add_months(F.to_date(F.lit(months[-1] + "-01")), 1)


def between_months(df: DataFrame, date: str, months: Sequence[str]) -> DataFrame:
    """Rows of a run of months, by a date range that reaches the scan."""
    low, high = _window(months)
    kind = df.schema[date].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        low, high = low.cast(kind), high.cast(kind)
    return df.filter((F.col(date) >= low) & (F.col(date) < high))


def split_baseline(df: DataFrame, date: str, baseline_months: int = 3
                   ) -> tuple[DataFrame, DataFrame]:
    """(baseline, current) by the first m months; error with no later month."""
    months = months_of(df, date)
    if len(months) <= baseline_months:
        raise ValueError(f"need more than {baseline_months} months, found {len(months)}")
    return (between_months(df, date, months[:baseline_months]),
            between_months(df, date, months[baseline_months:]))


def in_baseline(df: DataFrame, date: str, baseline_months: int = 3) -> Column:
    """D4 as a flag: true in the first m months, false later, null without a date."""
    months = months_of(df, date)
    if len(months) <= baseline_months:
        raise ValueError(f"need more than {baseline_months} months, found {len(months)}")
    _, end = _window(months[:baseline_months])
    kind = df.schema[date].dataType
    end = end.cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else end
    return F.col(date) < end


def psi_term(current: Column, base: Column) -> Column:
    """(c - b) * ln((c + eps) / (b + eps))."""
    return (current - base) * F.log((current + EPSILON) / (base + EPSILON))


def psi_monthly(df: DataFrame, date: str, features: Sequence[str], bins: int = 10,
                baseline_months: int = 3, min_months: int = 6,
                approximate: float | None = None) -> DataFrame:
    """Stability index per (feature, month) against the mean of the baseline months.

    Bins are baseline quantiles with a bin of their own for missing values. One scan
    bins all features at once; after it everything has features x months x bins rows.
    Fewer than ``min_months`` months give an empty table.
    """
    spark = df.sparkSession
    months = months_of(df, date)
    if len(months) < min_months or len(months) <= baseline_months:
        return spark.createDataFrame([], PSI_SCHEMA)
    base = months[:baseline_months]
    probs = [i / bins for i in range(1, bins)]
    quantile_table = column_quantiles(between_months(df, date, base), features, probs, approximate)
    edges = {r["feature"]: r["edges"] for r in bounded_rows(
        quantile_table.groupBy("feature").agg(
            F.array_sort(F.collect_set("value")).alias("edges")),
        len(features), "edges")}
    slots = df.filter(F.col(date).isNotNull()).select(
        month_of(F.col(date)).alias("month"), *[
            edge_bin(known(df, f), F.array(*[F.lit(e) for e in edges.get(f, [])])
                     .cast("array<double>")).alias(f) for f in features])
    counts = slots.unpivot(["month"], list(features), "feature", "bin").groupBy(
        "feature", "month", "bin").agg(F.count(F.lit(1)).alias("n"))
    # One row per (feature, month) holding its bin counts: absent bins read as zero.
    wide = counts.groupBy("feature", "month").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("cells"),
        F.sum("n").alias("total"))
    shares = wide.select(
        "feature", "month", (F.col("month").isin(base)).alias("in_base"),
        F.transform(
            F.sequence(F.lit(-1), F.lit(bins - 1)),
            lambda b: F.coalesce(F.element_at(F.col("cells"), b), F.lit(0)) / F.col("total"),
        ).alias("shares"))
    slot = shares.select("feature", "month", "in_base", F.posexplode("shares").alias("bin", "c"))
    own = Window.partitionBy("feature", "bin")
    # Every baseline month counts in the mean, with zero for a bin it does not have.
    mean = F.avg(F.when(F.col("in_base"), F.col("c"))).over(own)
    joined = slot.withColumn("b", mean).filter(~F.col("in_base"))
    return joined.groupBy("feature", "month").agg(
        F.lit(",".join(base)).alias("baseline"),
        F.sum(psi_term(F.col("c"), F.col("b"))).alias("psi"))


def psi_of_counts(counts: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """PSI per ``keys`` from (keys, bin, base, current) counts, absent bins as zero."""
    cells = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("base", "current"))))
        .alias("cells"), (F.sum("base") + bins * EPSILON).alias("nb"),
        (F.sum("current") + bins * EPSILON).alias("nc"))
    slot = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(
        ((F.coalesce(F.element_at(F.col("cells"), b)["base"], F.lit(0)) + EPSILON)
         / F.col("nb")).alias("b"),
        ((F.coalesce(F.element_at(F.col("cells"), b)["current"], F.lit(0)) + EPSILON)
         / F.col("nc")).alias("c"))))
    rows = cells.select(*keys, slot.alias("s"))
    term = (F.col("s.c") - F.col("s.b")) * F.log(F.col("s.c") / F.col("s.b"))
    return rows.groupBy(*keys).agg(F.sum(term).alias("psi"))


def _filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    fill = median_fill(df, features)
    return df.withColumns({
        f: F.coalesce(known(df, f), F.lit(fill.get(f)).cast("double")) for f in features})


def psi_two_sample(base: DataFrame, current: DataFrame, features: Sequence[str],
                   bins: int = 10) -> DataFrame:
    """One index per feature, equal-width bins over both samples.

    Missing values are filled with the median of their own sample.
    """
    features = list(features)
    return psi_of_parts(base.select(*features).withColumn("_base", F.lit(True)).unionByName(
        current.select(*features).withColumn("_base", F.lit(False))), "_base", features, bins)


def psi_of_parts(df: DataFrame, is_base: str | Column, features: Sequence[str],
                 bins: int = 10) -> DataFrame:
    """D2 where a boolean column tells the baseline from the current rows; null belongs to none.

    Three passes: ends and missing flags of all features, medians of the features with
    missing values (left out if there are none), bins of all features.
    """
    features = list(features)
    flag = F.col(is_base) if isinstance(is_base, str) else is_base
    rows = df.select(flag.cast("int").alias("_base"), *[known(df, f).alias(f) for f in features])
    rows = rows.filter(F.col("_base").isNotNull())
    seen = rows.agg(*[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi"),
                               F.max(F.col(f).isNull()).alias("holes")).alias(f)
                      for f in features]).first()
    holes = [f for f in features if seen[f]["holes"]]
    fill: dict[str, dict[int, float]] = {f: {} for f in features}
    if holes:
        middle = quantiles(rows.unpivot(["_base"], holes, "feature", "value"), "value", [0.5],
                           ["feature", "_base"])
        for r in bounded_rows(middle, 2 * len(holes), "medians"):
            fill[r["feature"]][r["_base"]] = r["value"]

    def filled(f: str) -> Column:
        own = F.when(F.col("_base") == 1, F.lit(fill[f].get(1)).cast("double")).otherwise(
            F.lit(fill[f].get(0)).cast("double"))
        return F.coalesce(F.col(f), own)

    slots = rows.select("_base", *[
        equal_width_bin(filled(f), F.lit(seen[f]["lo"]), F.lit(seen[f]["hi"]), bins).alias(f)
        for f in features]).unpivot(["_base"], features, "feature", "bin")
    counts = slots.filter(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(
        F.sum("_base").alias("base"), F.sum(1 - F.col("_base")).alias("current"))
    return psi_of_counts(counts, ["feature"], bins)


def psi_mean_by_month(df: DataFrame, date: str, features: Sequence[str],
                      baseline_months: int = 3, bins: int = 10, limit: float = 0.1) -> DataFrame:
    """D3: mean over the later months of the two-sample index against the baseline.

    Edges are equal-width over baseline and month together, so they differ by month: one pass finds
    them, another counts the rows of the later months by bin. The baseline's rows below each edge are
    looked up in its running counts, where the edges stand as values of their own; that makes
    features x months x bins rows, whatever the number of values. The ends (features x calendar
    months rows) are broadcast.
    """
    features = list(features)
    df = stored(df.select(date, *features))
    base, later = split_baseline(df, date, baseline_months)
    whole_fill = median_fill(df, features)
    filled_later = later.select(month_of(F.col(date)).alias("month"), *[
        F.coalesce(known(later, f), F.lit(whole_fill.get(f)).cast("double")).alias(f)
        for f in features])
    current = filled_later.unpivot(["month"], features, "feature", "value").filter(
        F.col("value").isNotNull()).withColumn("n", F.lit(1))
    baseline = _filled(base.select(*features), features).unpivot(
        [], features, "feature", "value").filter(F.col("value").isNotNull()).withColumn("n", F.lit(1))
    return mean_index(current, baseline, bins, limit)


def mean_index(current: DataFrame, baseline: DataFrame, bins: int = 10, limit: float = 0.1) -> DataFrame:
    """D3 from rows (feature, month, value, n) of the later months and (feature, value, n) of the baseline.

    ``n`` is the number of rows that a row stands for; no value is missing.
    """
    base_ends = baseline.groupBy("feature").agg(
        F.min("value").alias("blo"), F.max("value").alias("bhi"), F.sum("n").alias("total"))
    # One row per (feature, month): the edges of that comparison.
    grid = checkpointed(current.groupBy("feature", "month").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi")).join(base_ends, "feature").select(
        "feature", "month", F.least("lo", "blo").alias("lo"), F.greatest("hi", "bhi").alias("hi"), "total"))
    slot = equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), bins)
    month_side = current.join(F.broadcast(grid), ["feature", "month"]).groupBy(
        "feature", "month", slot.alias("bin")).agg(
        F.lit(0).cast("long").alias("base"), F.sum("n").alias("current"))
    # Months that stay inside the baseline range share one set of edges.
    sets = grid.select("feature", "lo", "hi", "total").distinct()
    starts = checkpointed(sets.mapInArrow(lambda batches: _edge_rows(batches, bins),
                                          "feature string, lo double, hi double, bin int, value double"))
    counts = baseline.select("feature", "value", "n", F.lit(False).alias("edge")).unionByName(
        starts.select("feature", "value", F.lit(0).alias("n"), F.lit(True).alias("edge"))).groupBy(
        "feature", "value").agg(F.sum("n").alias("n"), F.max("edge").alias("edge"))
    run = running_sums(counts, "value", ["n"], ["feature"]).filter("edge").select(
        "feature", "value", (F.col("cum_n") - F.col("n")).alias("below"))
    below = starts.join(run, ["feature", "value"]).groupBy("feature", "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "below"))).alias("below"))
    # An edge that no value reaches has every row below it.
    under = lambda b: F.when(b <= 0, F.lit(0).cast("long")).otherwise(
        F.coalesce(F.element_at("below", b), F.col("total")))
    cells = sets.join(below, ["feature", "lo", "hi"], "left").withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    cells = cells.select("feature", "lo", "hi", "bin",
                         (under(F.col("bin") + 1) - under(F.col("bin"))).alias("base"))
    base_side = cells.join(grid, ["feature", "lo", "hi"]).select(
        "feature", "month", "bin", "base", F.lit(0).cast("long").alias("current"))
    both = month_side.unionByName(base_side).groupBy("feature", "month", "bin").agg(
        F.sum("base").alias("base"), F.sum("current").alias("current"))
    mean = psi_of_counts(both, ["feature", "month"], bins).groupBy("feature").agg(
        F.avg("psi").alias("psi"))
    return mean.withColumn("stable", F.col("psi") < limit)


def bin_starts(lo: np.ndarray, hi: np.ndarray, bins: int) -> np.ndarray:
    """The smallest double of each equal-width bin but the first, found by halving.

    Comparing with it is the same as the rounded division of F10; infinite without a width.
    """
    order = lambda x: np.where((i := x.view(np.int64)) < 0, np.int64(-2 ** 63) - i, i)
    value = lambda i: np.where(i < 0, np.int64(-2 ** 63) - i, i).view(np.float64)
    width = ((hi - lo) / float(bins))[:, None]
    steps = np.arange(1, bins)[None, :]
    flat = np.broadcast_to(width <= 0, (len(lo), bins - 1))
    low = np.repeat(order(lo + 0.0)[:, None], bins - 1, axis=1)
    high = np.repeat(order(hi + 0.0)[:, None], bins - 1, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        while (low < high).any():
            middle = (low >> 1) + (high >> 1) + (low & high & 1)
            inside = np.floor((value(middle) - lo[:, None]) / width) >= steps
            high = np.where(inside, middle, high)
            low = np.where(inside, low, np.minimum(middle + 1, high))
        reached = np.floor((value(high) - lo[:, None]) / width) >= steps
    return np.where(flat | ~reached, np.inf, value(high))


def _edge_rows(batches: Iterator[pa.RecordBatch], bins: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lo, hi = batch["lo"].to_numpy(), batch["hi"].to_numpy()
        starts = bin_starts(lo, hi, bins)
        row, step = np.nonzero(np.isfinite(starts))
        yield pa.RecordBatch.from_arrays(
            [batch["feature"].take(pa.array(row)), pa.array(lo[row]), pa.array(hi[row]),
             pa.array((step + 1).astype(np.int32)), pa.array(starts[row, step])],
            ["feature", "lo", "hi", "bin", "value"])


def stability_filter(psi: DataFrame, limit: float = 0.1) -> DataFrame:
    """Report rows from a table (feature, psi)."""
    status = F.when(F.col("psi") < limit, "kept").otherwise("removed")
    return psi.select("feature", F.lit("psi").alias("test"), status.alias("status"),
                      F.col("psi").alias("value"))
