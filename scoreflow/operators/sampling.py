"""Reproducible samples and splits ordered by the hash of an id.

A row's place depends on its id and the seed only, never on the partitioning, so a lost
executor recomputes the same sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreflow.functions.core import broadcast_if_few, checkpointed, hash_cell, hashed, month_of, uniform

# The bracket of a cut: deviations of its place among even hashes, rows added to both sides, and
# the hexadecimal digits of its ends (exact as a double).
DEVIATIONS, LEAST_ROWS, DIGITS = 8, 64, 13


def sample_size(population: int, confidence: float = 0.95, error: float = 0.05) -> int:
    """Rows needed to estimate a proportion in a finite population."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    n0 = z * z * 0.25 / (error * error)
    return math.ceil(n0 / (1 + (n0 - 1) / population))


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """N rows at random (all rows if fewer)."""
    quota = df.sparkSession.range(1).select(F.lit("all").alias("_s"), F.lit(n).alias("quota"))
    marked = df.withColumn("_s", F.lit("all"))
    return sample_by_quota(marked, id_col, ["_s"], quota, seed).drop("_s")


def sample_by_quota(df: DataFrame, id_col: str, strata: Sequence[str], quotas: DataFrame,
                    seed: int = 42, sizes: DataFrame | None = None) -> DataFrame:
    """The first ``quota`` rows of each stratum in hash order; strata without a quota are out."""
    return mark_by_quota(df, id_col, strata, quotas, "_in", seed, sizes).filter("_in").drop("_in")


def mark_by_quota(df: DataFrame, id_col: str, strata: Sequence[str], quotas: DataFrame,
                  name: str, seed: int = 42, sizes: DataFrame | None = None) -> DataFrame:
    """Flag the first ``quota`` rows of each stratum in hash order; a null quota takes all rows.

    Hashes spread evenly, so the size of a stratum tells where its cut lies, to within a few
    deviations: only rows whose hash lies in that bracket are looked at one by one (about
    16 * sqrt(rows), or less), those below it are one count. That gives the last (hash, id) of each
    quota, and every row compares itself with that key. No stratum is sorted or gathered, whatever
    its size. Where the cut lies outside its bracket, as ids that repeat very often can cause, the
    stratum is counted by hash cells. ``sizes`` has the strata and their ``_rows``, if known.
    """
    strata = list(strata)
    same = lambda other: reduce(lambda a, b: a & b, [
        F.col(s).eqNullSafe(F.col(f"{other}{i}")) for i, s in enumerate(strata)])
    named = lambda prefix: [F.col(s).alias(f"{prefix}{i}") for i, s in enumerate(strata)]
    if sizes is None:
        sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_rows"))
    wanted = sizes.join(quotas.select(*named("_w"), F.col("quota").alias("_quota")), same("_w"))
    share = F.col("_quota") / F.col("_rows")
    width = DEVIATIONS * F.sqrt(share * (1 - share) / F.col("_rows")) + LEAST_ROWS / F.col("_rows")
    digits = lambda x: F.lpad(F.lower(F.hex(F.floor(x * float(16 ** DIGITS)).cast("long"))), DIGITS, "0")
    cut = (F.col("_quota") > 0) & (F.col("_quota") < F.col("_rows"))
    low = F.when(share > width, digits(share - width)).otherwise("")
    high = F.when(share + width < 1, digits(share + width)).otherwise("g")
    # One row per stratum. Where they are few a join by stratum would gather each of them in one task.
    bounds = checkpointed(wanted.select(*named("_q"), "_quota", cut.alias("_cut"), F.when(cut, low).alias("_low"),
                                        F.when(cut, high).alias("_high")))
    h = hashed(id_col, seed)
    key = F.struct(F.col("_h").alias("h"), F.col(id_col).alias("i"))
    slots = [f"_q{i}" for i in range(len(strata))]
    near = df.select(*strata, id_col, h.alias("_h")).join(broadcast_if_few(bounds.filter("_cut")), same("_q")).filter("_h < _high")
    counts = near.groupBy(*slots, "_quota", F.when(F.col("_h") >= F.col("_low"), key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*slots).orderBy(F.asc_nulls_first("_key")).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("_u") >= F.col("_quota")
    lasts = counts.withColumn("_u", F.sum("_n").over(upto)).groupBy(*slots).agg(
        F.min(F.when(reached, F.col("_key"))).alias("_last"),
        F.coalesce(F.bool_or(reached & F.col("_key").isNull()), F.lit(False)).alias("_early"))
    of = lambda other: reduce(lambda a, b: a & b, [
        F.col(f"_q{i}").eqNullSafe(F.col(f"{other}{i}")) for i in range(len(strata))])
    found = lasts.select(*[F.col(f"_q{i}").alias(f"_p{i}") for i in range(len(strata))],
                         F.when(~F.col("_early"), F.col("_last")).alias("_last"))
    both = checkpointed(bounds.join(found, of("_p"), "left").select(*slots, "_quota", "_cut", "_last"))
    odd = both.filter("_cut and _last is null")
    if not odd.isEmpty():
        keyed = df.select(*strata, id_col, h.alias("_h")).join(
            broadcast_if_few(odd.select(*slots, "_quota")), same("_q"))
        exact = _lasts_by_cells(keyed, slots, id_col).select(
            *[F.col(f"_q{i}").alias(f"_e{i}") for i in range(len(strata))], F.col("_last").alias("_exact"))
        both = checkpointed(both.join(exact, of("_e"), "left").select(
            *slots, "_quota", "_cut", F.coalesce("_last", "_exact").alias("_last")))
    placed = df.withColumn("_h", h).join(
        broadcast_if_few(both).withColumn("_has", F.lit(True)), same("_q"), "left")
    taken = F.when(F.col("_quota") <= 0, False).when(F.col("_cut"), key <= F.col("_last")).otherwise(True)
    return placed.withColumn(name, F.coalesce(F.col("_has") & taken, F.lit(False))).select(*df.columns, name)


def _lasts_by_cells(keyed: DataFrame, slots: Sequence[str], id_col: str) -> DataFrame:
    """The last (hash, id) of each quota, whatever the distribution of the hashes.

    Rows are counted per (stratum, hash cell); only the cell that holds the cut is ranked.
    """
    keyed = keyed.withColumn("_c", hash_cell(F.col("_h")))
    cells = keyed.groupBy(*slots, "_quota", "_c").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*slots).orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("_u", F.sum("_n").over(upto)).filter("_u >= _quota")
    cuts = run.groupBy(*[F.col(s).alias(f"_x{s}") for s in slots]).agg(
        F.min(F.struct("_c", (F.col("_quota") - F.col("_u") + F.col("_n")).alias("left"))).alias("_cut"))
    on = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"_x{s}")) for s in slots])
    at_cut = keyed.join(cuts, on & (F.col("_c") == F.col("_cut._c")))
    rank = F.row_number().over(Window.partitionBy(*slots).orderBy("_h", id_col))
    key = F.struct(F.col("_h").alias("h"), F.col(id_col).alias("i"))
    return at_cut.withColumn("_k", rank).filter(F.col("_k") <= F.col("_cut.left")).groupBy(*slots).agg(
        F.max(key).alias("_last"))


def month_class_quotas(df: DataFrame, date: str, target: str | None, n: int,
                       imbalance: float = 0.8) -> DataFrame:
    """Rows wanted per (month, class), or per month when the classes are balanced.

    Imbalanced: floor(rows of the cell * n / rows), at least 1 for class 1.
    Otherwise: n div months for each month (class is null).
    """
    return _quotas_of(_month_class_counts(df, date, target), n, imbalance)


def _month_class_counts(df: DataFrame, date: str, target: str | None) -> DataFrame:
    month = month_of(F.col(date)).alias("month")
    kind = F.lit(None).cast("int") if target is None else F.col(target).cast("int")
    return df.groupBy(month, kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _quotas_of(cells: DataFrame, n: int, imbalance: float) -> DataFrame:
    whole = Window.partitionBy(F.lit(0))  # months x classes rows
    months = F.size(F.collect_set("month").over(whole))
    total = F.sum("n").over(whole)
    class_total = F.sum("n").over(Window.partitionBy("class"))
    cells = cells.withColumns({"months": months, "total": total, "class_total": class_total})
    skewed = F.max("class_total").over(whole) / F.col("total") > imbalance
    skewed = skewed & F.col("class").isNotNull()
    quota = F.floor(F.col("n") * n / F.col("total")).cast("long")
    quota = F.when(F.col("class") == 1, F.greatest(quota, F.lit(1))).otherwise(quota)
    flat = F.floor(F.lit(n) / F.col("months")).cast("long")
    out = cells.withColumn("skewed", skewed)
    return out.select(
        "month", F.when(F.col("skewed"), F.col("class")).alias("class"),
        F.when(F.col("skewed"), quota).otherwise(flat).alias("quota")).distinct()


def stratified_sample(df: DataFrame, id_col: str, date: str, target: str | None, n: int,
                      imbalance: float = 0.8, seed: int = 42) -> DataFrame:
    """Sample by month and, when the classes are imbalanced, by class."""
    counts = checkpointed(_month_class_counts(df, date, target))  # months x classes rows
    quotas = checkpointed(_quotas_of(counts, n, imbalance))
    # With balanced classes the quotas have no class, and a stratum is a month.
    by_class = bool(quotas.agg(F.bool_or(F.col("class").isNotNull())).first()[0])
    kind = F.col(target).cast("int") if by_class else F.lit(None).cast("int")
    marked = df.withColumn("_month", month_of(F.col(date))).withColumn("_class", kind)
    wanted = quotas.select(F.col("month").alias("_month"), F.col("class").alias("_class"), "quota")
    own = F.col("class") if by_class else F.lit(None).cast("int")
    sizes = counts.groupBy(F.col("month").alias("_month"), own.alias("_class")).agg(F.sum("n").alias("_rows"))
    return sample_by_quota(marked, id_col, ["_month", "_class"], wanted, seed, sizes).drop(
        "_month", "_class")


def _threshold(share: float) -> str:
    return format(min(int(share * 16**8), 16**8 - 1), "08x") if share < 1 else "g"


def in_share(id_col: str | Column, share: float, seed: int = 42) -> Column:
    """True for about ``share`` of the ids: leading hash digits below the threshold."""
    return F.substring(hashed(id_col, seed), 1, 8) < F.lit(_threshold(share))


def split(df: DataFrame, id_col: str, test_share: float = 0.2, seed: int = 42,
          stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test), disjoint and complete.

    With ``stratify`` the test set holds round(share * rows) of each class exactly.
    """
    if stratify is None:
        test = in_share(id_col, test_share, seed)
        return df.filter(~test), df.filter(test)
    quotas = df.groupBy(stratify).agg(
        F.round(F.count(F.lit(1)) * test_share).cast("long").alias("quota"))
    marked = mark_by_quota(df, id_col, [stratify], quotas, "_test", seed)
    return marked.filter(~F.col("_test")).drop("_test"), marked.filter("_test").drop("_test")


def fold_of(id_col: str | Column, folds: int, seed: int = 42) -> Column:
    """Fold number 0..folds-1 of an id."""
    digits = F.conv(F.substring(hashed(id_col, seed), 1, 8), 16, 10).cast("long")
    return (digits % folds).cast("int")


def bernoulli(df: DataFrame, id_col: str | Column, limit: int = 100_000,
              fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """Each row with probability min(fraction, limit / rows), decided by the hash of its id."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.least(F.lit(fraction), F.lit(float(limit)) / F.nullif(F.col("n"), F.lit(0)))).scalar()
    return df.filter(uniform(id_col, seed) < rows)


def weights(df: DataFrame, target: str, limit: float = 0.8, name: str = "weight") -> DataFrame:
    """Weight n0/n1 for class 1 when the majority share is above the limit, else 1."""
    zero, one = F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)
    share = F.greatest(zero, one) / F.nullif(zero + one, F.lit(0))
    value = F.when(share > limit, zero / F.nullif(one, F.lit(0))).otherwise(F.lit(1.0))
    weight = df.agg(value.cast("double")).scalar()
    return df.withColumn("_w", weight).withColumn(
        name, F.when(F.col(target) == 1, F.col("_w")).otherwise(F.lit(1.0))).drop("_w")
