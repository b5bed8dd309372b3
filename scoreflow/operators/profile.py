"""Column profiles: missing shares, modes, distinct counts, medians and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreflow.functions.core import (bounded_rows, is_missing, known, numeric_columns, ratio,
                                      unpivot)
from scoreflow.operators.prefix import quantiles, running_sums

SKETCH = 2000  # accuracy of the sketch that brackets quantiles: ranks are off by n / SKETCH at most
MARGIN = 4 / SKETCH


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4: count, mean, sample deviation, min and max per numeric column, typed, one pass."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    stats = {"n": F.count, "mean": F.avg, "stddev": F.stddev, "min": F.min, "max": F.max}
    wide = df.agg(*[
        F.struct(*[f(known(df, c)).cast("double").alias(k) for k, f in stats.items()])
        .alias(c) for c in cols])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in cols])).alias("r"))
    return long.select("r.feature", *[F.col(f"r.s.{k}").alias(k) for k in stats])


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count and ratio of every column in one aggregate."""
    cols = list(cols) if cols is not None else df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(is_missing(df, c)).alias(c) for c in cols])
    long = wide.unpivot(["_n"], cols, "feature", "n_missing")
    return long.select("feature", "n_missing", ratio(F.col("n_missing"), F.col("_n"))
                       .alias("missing_ratio"))


def has_missing(df: DataFrame, cols: Sequence[str]) -> bool:
    """V4: does any of the columns hold null or NaN."""
    found = df.agg(*[F.max(is_missing(df, c)).alias(c) for c in cols]).first()
    return any(bool(v) for v in found)


def as_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per (row, column) with the value as text; missing is null."""
    return df.select(*[
        F.when(~is_missing(df, c), F.col(c).cast("string")).alias(c) for c in cols
    ]).unpivot([], list(cols), "feature", "value")


def mode_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mode, its share over all rows, and distinct values, per column.

    Counted per (column, value) first, with map-side combine; the smallest number or
    text wins ties.
    """
    cols = list(cols) if cols is not None else df.columns
    counts = as_text(df, cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    numbers = set(numeric_columns(df))
    is_number = F.col("feature").isin([c for c in cols if c in numbers])
    # Ties: smaller number first, then smaller text.
    size = F.when(is_number, F.col("value").try_cast("double"))
    per_count = counts.filter(F.col("value").isNotNull()).groupBy("feature", "n").agg(
        F.min(F.struct(size.alias("size"), F.col("value").alias("value"))).alias("first"),
        F.count(F.lit(1)).alias("values"))
    modes = per_count.groupBy("feature").agg(
        F.max_by("first", "n").alias("first"), F.max("n").alias("mode_count"),
        F.sum("values").alias("n_distinct"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return modes.select("feature", F.col("first.value").alias("mode"), "mode_count",
                        ratio(F.col("mode_count"), total).alias("mode_share"), "n_distinct")


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column."""
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(F.when(~is_missing(df, c), F.col(c))).alias(c)
                        for c in cols])
        return wide.unpivot([], list(cols), "feature", "n_distinct")
    return (as_text(df, cols).filter(F.col("value").isNotNull()).distinct()
            .groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct")))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     approximate: float | None = None) -> DataFrame:
    """Quantiles per column as rows (feature, prob, value), exact by default.

    A sketch brackets each rank first; only values inside a bracket are then counted one by one, the
    others as rows below a bracket, so that the shuffle carries about ``2 * MARGIN`` of the values for
    each prob. A rank outside its bracket, which the sketch's bound excludes, is looked up among all
    values. ``approximate`` is the relative error of Spark's sketch instead. Columns without values
    have no rows.
    """
    if approximate is None:
        return _bracketed(df, list(dict.fromkeys(cols)), sorted({float(p) for p in probs}))
    accuracy = max(1, int(round(1 / approximate)))
    wide = df.agg(*[F.percentile_approx(known(df, c), [float(p) for p in probs],
                                        F.lit(accuracy)).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "feature", "v")
    return long.select("feature", F.posexplode("v").alias("pos", "value")).select(
        "feature", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("pos") + 1)
        .alias("prob"), "value")


def _bracketed(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    spark, shape = df.sparkSession, "feature string, prob double, value double"
    asked = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-MARGIN, MARGIN)})
    found = df.agg(*[F.percentile_approx(known(df, c), asked, F.lit(SKETCH)).alias(f"_{i}")
                     for i, c in enumerate(cols)]).first() if cols and probs else []
    spans = {c: _spans(probs, dict(zip(asked, found[i]))) for i, c in enumerate(cols) if found[i]} if found else {}
    if not spans:
        return spark.createDataFrame([], shape)
    low = F.lit(float("-inf"))
    marked = []
    for c, parts in spans.items():
        # A value between two brackets counts as the end of the one below it.
        x, place = known(df, c), low
        for start, end in parts:
            place = F.when(x > end, F.lit(end)).when(x >= start, x).otherwise(place)
        place = F.when(x.isNotNull(), place)
        marked.append(F.struct(place.alias("value"), (x == place).alias("own")).alias(c))
    counts = df.select(*marked).unpivot([], list(spans), "feature", "s").filter(
        F.col("s.value").isNotNull()).groupBy("feature", "s.value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("s.own").alias("own"))
    run = running_sums(counts, "value", ["n"], ["feature"])
    place = lambda p: F.lit(p) * (F.col("tot_n") - 1)
    ranks = F.inline(F.array(*[
        F.struct(F.lit(p).alias("prob"), F.lit(upper).alias("upper"),
                 ((F.ceil(place(p)) if upper else F.floor(place(p))) + 1).alias("rank"),
                 (place(p) - F.floor(place(p))).alias("w")) for p in probs for upper in (False, True)]))
    first = F.col("cum_n") - F.col("n")
    hits = run.select("*", ranks).filter((F.col("rank") > first) & (F.col("rank") <= F.col("cum_n")))
    rows = bounded_rows(hits.select(
        "feature", "prob", "upper", "value", "w", (F.col("rank") <= first + F.col("own")).alias("sure")),
        2 * len(cols) * len(probs), "quantiles")
    unsure = {r["feature"] for r in rows if not r["sure"]}
    ends = {(r["feature"], r["prob"], r["upper"]): r for r in rows if r["feature"] not in unsure}
    out = []
    for (c, p, upper), r in ends.items():
        if not upper:
            gap = ends[c, p, True]["value"] - r["value"]
            out.append((c, p, r["value"] + gap * r["w"] if gap else r["value"]))
    table = spark.createDataFrame(out, shape)
    if unsure:
        table = table.unionByName(quantiles(unpivot(df, sorted(unsure)), "value", probs, ["feature"]).select(
            "feature", F.col("prob").cast("double"), F.col("value").cast("double")))
    return table


def _spans(probs: list[float], at: dict[float, float]) -> list[tuple[float, float]]:
    """Brackets of the probs as disjoint ranges of values; the outermost are open."""
    parts: list[tuple[float, float]] = []
    for p in probs:
        start = at[p - MARGIN] if p - MARGIN > 0 else float("-inf")
        end = at[p + MARGIN] if p + MARGIN < 1 else float("inf")
        if parts and start <= parts[-1][1]:
            parts[-1] = (parts[-1][0], max(end, parts[-1][1]))
        else:
            parts.append((start, end))
    return parts


def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median per column."""
    return column_quantiles(df, cols, [0.5]).select("feature", F.col("value").alias("median"))


def median_fill(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Median of the columns that have missing values; one cheap pass finds them first."""
    flags = df.agg(*[F.max(is_missing(df, c)).alias(c) for c in cols]).first()
    holes = [c for c in cols if flags[c]]
    if not holes:
        return {}
    return {r["feature"]: r["median"] for r in bounded_rows(
        medians(df, holes), len(holes), "medians")}


def column_types(df: DataFrame) -> DataFrame:
    """One row per column with its kind (numeric, string, other)."""
    kinds = []
    for field in df.schema.fields:
        number, text = (isinstance(field.dataType, t) for t in (T.NumericType, T.StringType))
        kinds.append((field.name, "numeric" if number else "string" if text else "other"))
    return df.sparkSession.createDataFrame(kinds, "feature string, kind string")
