"""The counts that all selection filters share.

One pass over the input counts the rows of each (feature, value, month); a second table adds them up
per (feature, value), apart for baseline and later months. Both are written once, and every filter
reads them in place of the input: missing ratio, mode share, areas, information, and both stability
indices. Missing values (null or NaN) are counted as value null, rows without a date as month null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreflow.functions.core import bounded_rows, checkpointed, edge_bin, known, month_of
from scoreflow.operators import stability
from scoreflow.operators.metrics import rank_steps
from scoreflow.operators.prefix import counted_quantiles, running_sums

REPORT = "feature string, test string, status string, value double"
INFORMATION_BINS = 10
INNER = [i / INFORMATION_BINS for i in range(1, INFORMATION_BINS)]


def _status(removed: Column) -> Column:
    return F.when(removed, "removed").otherwise("kept").alias("status")


class SharedCounts:
    """Counts per (feature, value) of numeric columns, and the filters that read them.

    Values count as doubles. ``target`` may be left out; a target that is neither 0 nor 1 is a class
    of its own for the information and no row for the areas, as in the filters on rows.
    """

    def __init__(self, df: DataFrame, date: str, cols: Sequence[str], target: str | None = None,
                 baseline_months: int = 3):
        self.spark, self.cols = df.sparkSession, list(cols)
        hit = lambda v: F.lit(None).cast("boolean") if target is None else F.col(target) == v
        long = df.select(month_of(F.col(date)).alias("_month"), hit(0).alias("_good"), hit(1).alias("_bad"), *[
            known(df, c).alias(c) for c in self.cols]).unpivot(
            ["_month", "_good", "_bad"], self.cols, "feature", "value")
        self.monthly = checkpointed(long.groupBy("feature", "value", F.col("_month").alias("month")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("_good").alias("goods"), F.count_if("_bad").alias("bads")))
        # Calendar months are few; they are the same for every feature.
        self.months = sorted(r["month"] for r in self.monthly.filter("month is not null").select(
            "month").distinct().collect())
        self.baseline_months = baseline_months
        self.base = self.months[:baseline_months]
        part = F.col("month").isin(self.base)
        add = lambda c, when=None: F.coalesce(F.sum(c if when is None else F.when(when, F.col(c))), F.lit(0)).alias(c)
        self.values = checkpointed(self.monthly.groupBy("feature", "value").agg(
            add("n"), add("goods"), add("bads"), add("n", part).alias("base"), add("n", ~part).alias("current")))

    def of(self, cols: Sequence[str]) -> DataFrame:
        return self.values.filter(F.col("feature").isin(list(cols)))

    @cached_property
    def profile(self) -> dict:
        """Per feature: rows, missing rows, rows of the mode, distinct values, mean, ends; one row each."""
        there = F.col("value").isNotNull()
        span = there & (F.col("base") + F.col("current") > 0)
        rows = self.values.groupBy("feature").agg(
            F.sum("n").alias("n"), F.sum("goods").alias("goods"), F.sum("bads").alias("bads"),
            F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("missing"),
            F.max(F.when(there, F.col("n"))).alias("mode"), F.count("value").alias("distinct"),
            (F.sum(F.col("value") * F.col("n")) / F.sum(F.when(there, F.col("n")))).alias("mean"),
            F.min(F.when(span, F.col("value"))).alias("lo"), F.max(F.when(span, F.col("value"))).alias("hi"))
        return {r["feature"]: r for r in bounded_rows(rows, len(self.cols), "profiles")}

    def report(self, rows: Sequence[tuple]) -> DataFrame:
        return self.spark.createDataFrame(list(rows), REPORT)

    def majority(self) -> float:
        """Share of the larger class."""
        one = next(iter(self.profile.values()), None)
        both = one["goods"] + one["bads"] if one else 0
        return max(one["goods"], one["bads"]) / both if both else 0.0

    def missing_filter(self, cols: Sequence[str], limit: float) -> DataFrame:
        """V5 from the counts."""
        found = [(c, self.profile.get(c)) for c in cols]
        shares = [(c, p["missing"] / p["n"] if p else None) for c, p in found]
        return self.report((c, "missing", "removed" if v is not None and v > limit else "kept", v) for c, v in shares)

    def mode_filter(self, cols: Sequence[str], limit: float) -> DataFrame:
        """V6 from the counts; a column without values has no row."""
        found = [(c, p) for c in cols if (p := self.profile.get(c)) and p["mode"]]
        return self.report((c, "mode", "removed" if p["mode"] / p["n"] > limit and p["distinct"] > 1 else "kept",
                            p["mode"] / p["n"]) for c, p in found)

    def edges(self, cols: Sequence[str]) -> DataFrame:
        """Quantiles at the inner edges of the information's bins; the one at a half is the median."""
        known_values = self.of(cols).filter("value is not null").select("feature", "value", "n")
        return checkpointed(counted_quantiles(known_values, "value", INNER, ["feature"]))

    def univariate_filter(self, cols: Sequence[str], imbalanced: bool, min_information: float = 0.01) -> DataFrame:
        """C10-C12 from the counts: area above .2 (PR, imbalanced) or .55 (ROC), and information.

        Missing values are the median for the areas and a bin of their own for the information.
        """
        quantiles = self.edges(cols)
        # One row per feature: Spark broadcasts it by its size.
        edges = quantiles.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("edges"),
                                                 F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"))
        rows = self.of(cols).join(edges, "feature", "left")
        counts = rows.groupBy("feature", F.coalesce("value", "median").alias("value")).agg(
            F.sum("goods").alias("goods"), F.sum("bads").alias("bads"))
        areas = rank_steps(running_sums(counts, "value", ["goods", "bads"], ["feature"], True), "value", ["feature"])
        area, limit = ("pr_auc", 0.2) if imbalanced else ("auc", 0.55)
        slot = edge_bin(F.col("value"), F.coalesce("edges", F.array().cast("array<double>")))
        cells = rows.groupBy("feature", slot.alias("bin")).agg(
            F.sum("goods").alias("g"), F.sum("bads").alias("b"), F.sum(F.expr("n - goods - bads")).alias("o"))
        # At most features x (bins + 1) x 3 rows from here on.
        cells = cells.select("feature", "bin", F.posexplode(F.array("g", "b", "o")).alias("class", "n")).filter(
            "n > 0").withColumn("n", F.col("n").cast("double"))
        over = lambda *keys: F.sum("n").over(Window.partitionBy(*keys))
        term = F.col("n") / over("feature") * F.log(
            F.col("n") * over("feature") / (over("feature", "bin") * over("feature", "class")))
        information = cells.withColumn("t", term).groupBy("feature").agg(F.sum("t").alias("mutual_information"))
        table = areas.select("feature", area).join(information, "feature")
        ok = (F.col(area) > limit) & (F.col("mutual_information") > min_information)
        pair = [F.struct(F.lit(c).alias("test"), F.col(c).alias("value")) for c in (area, "mutual_information")]
        return table.select("feature", _status(~F.coalesce(ok, F.lit(False))), F.explode(F.array(*pair)).alias("p")).select(
            "feature", "p.test", "status", "p.value")

    def centre(self, cols: Sequence[str]) -> list[float]:
        """Means of the columns, 0 without values."""
        found = [self.profile.get(c) for c in cols]
        return [0.0 if p is None or p["mean"] is None else p["mean"] for p in found]

    def _need_later(self) -> None:
        if len(self.months) <= self.baseline_months:
            raise ValueError(f"need more than {self.baseline_months} months, found {len(self.months)}")

    def psi(self, cols: Sequence[str], bins: int = 10) -> DataFrame:
        """D2 of the later months against the baseline, missing values at the median of their part."""
        self._need_later()
        ends = {c: (p["lo"], p["hi"]) for c in cols if (p := self.profile.get(c))}
        rows = self.of(cols).select("feature", "value", F.inline(F.array(
            F.struct(F.lit(1).alias("_base"), F.col("base").alias("n")),
            F.struct(F.lit(0).alias("_base"), F.col("current").alias("n"))))).filter("n > 0")
        holes = [c for c in cols if self.profile[c]["missing"]]
        if holes:
            middle = counted_quantiles(rows.filter(F.col("feature").isin(holes) & F.col("value").isNotNull()),
                                       "value", [0.5], ["feature", "_base"])
            rows = rows.join(middle.select("feature", "_base", F.col("value").alias("_m")), ["feature", "_base"], "left")
            rows = rows.withColumn("value", F.coalesce("value", "_m"))
        # One row per feature: Spark broadcasts it by its size.
        spans = self.spark.createDataFrame([(c, *e) for c, e in ends.items()], "feature string, lo double, hi double")
        slot = stability.equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), bins)
        counts = rows.filter("value is not null").join(spans, "feature").groupBy("feature", slot.alias("bin")).agg(
            F.sum(F.col("n") * F.col("_base")).alias("base"), F.sum(F.col("n") * (1 - F.col("_base"))).alias("current"))
        return stability.psi_of_counts(counts, ["feature"], bins)

    def psi_mean_by_month(self, cols: Sequence[str], bins: int = 10, limit: float = 0.1) -> DataFrame:
        """D3 from the counts."""
        self._need_later()
        rows = self.monthly.filter(F.col("feature").isin(list(cols))).select("feature", "month", "value", "n")
        base = rows.filter(F.col("month").isin(self.base))
        later = rows.filter(~F.col("month").isin(self.base))

        def filled(part: DataFrame, own: DataFrame) -> DataFrame:
            known_values = own.filter("value is not null").groupBy("feature", "value").agg(F.sum("n").alias("n"))
            middle = counted_quantiles(known_values, "value", [0.5], ["feature"])
            return part.join(middle.select("feature", F.col("value").alias("_m")), "feature", "left").select(
                "feature", "month", F.coalesce("value", "_m").alias("value"), "n").filter("value is not null")

        return stability.mean_index(filled(later, rows), filled(base, base), bins, limit)
