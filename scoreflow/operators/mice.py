"""V8: chained-equation imputation.

Numeric columns that follow each other are renewed as one run, from one pass over the rows: the
pass adds up a Gram matrix for every pattern of missing cells in the run. A regression sweeps the
sum over the patterns in which its column is known; its result renews the column linearly, so the
matrices of the other patterns follow from a product and the next regression of the run sees the
new values without another pass. The result is that of renewing one column after the other.

Rows with equal cells get equal values. Where such rows are many, the rounds read each once with its number, and the
rows look their values up at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import (bounded_rows, broadcast_if_few, checkpointed, is_missing, known,
                                      numeric_columns, present, stored, string_columns, unpivot)
from scoreflow.functions.matrices import summed_matrix
from scoreflow.operators.clean import fill_values
from scoreflow.operators.encode import label_ranks, with_index
from scoreflow.operators.prefix import counted_quantiles
from scoreflow.operators.profile import missing_profile

COUNT = "__n"  # rows that a row of the rounds stands for
SHARED = 4  # equal rows are read once where a row has so many on average
RUN = 6  # numeric columns of one pass, so at most 2^6 patterns of missing cells
DENSE = 256  # inputs and levels of a Gram matrix; wider regressions go to MLlib's sparse solver


def mice_impute(df: DataFrame, id_col: str, cols: Sequence[str] | None = None,
                target: str | None = None, max_iter: int = 10, tol: float = 1e-4,
                max_missing: float = 0.3, use_target: bool = False) -> DataFrame:
    """Impute each column from all others, round after round.

    Columns above ``max_missing`` are dropped. Numbers are predicted by linear regression,
    text by multinomial logistic regression; both learn from the observed rows only. A missing
    target, as predictor, counts as the target's mean. The
    rounds stop when fewer than ``tol`` of the rows still change. Observed cells never change;
    the target is never imputed and only a predictor with ``use_target``.
    """
    outside = {id_col, target}
    cols = [c for c in (cols or df.columns) if c not in outside]
    numbers, texts = set(numeric_columns(df)), set(string_columns(df))
    cols = [c for c in cols if c in numbers or c in texts]
    # Every fill, every fit and every round reads the rows again.
    df = stored(df)
    share = {r["feature"]: r["missing_ratio"] for r in bounded_rows(
        missing_profile(df, cols), len(cols), "missing ratios")}
    dropped = [c for c in cols if share[c] > max_missing]
    cols = [c for c in cols if c not in dropped]
    holes = [c for c in cols if share[c] > 0]
    if not holes:
        return df.drop(*dropped)
    nums, cats = [c for c in cols if c in numbers], [c for c in cols if c not in numbers]

    extra = [target] if use_target and target is not None else []
    seen = [*cols, *extra]
    total = df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(
        *[present(df, c) for c in seen], *[F.col(c).isNull() for c in seen])).alias("d")).first()
    rows, counted = total["n"], total["n"] >= SHARED * total["d"]
    whole = df
    if counted:
        # Missing is null here, so that NaN and null are one.
        df = stored(df.groupBy(*[present(df, c).alias(c) for c in seen]).agg(
            F.count(F.lit(1)).cast("double").alias(COUNT)))
    # State per row: the mask of each imputed column and its value now and one round ago.
    # Text is held as its frequency index, so 0 is the mode.
    start: dict[str, float] = {}
    if any(c in holes for c in nums):
        filled = [c for c in nums if c in holes]
        start = _counted_medians(df, filled) if counted else fill_values(df, filled, "median")
    labels = {c: checkpointed(label_ranks(whole, c)) for c in cats}
    coded = with_index(df, labels, "__i")
    state = coded.select(
        *df.columns,
        *[is_missing(df, c).alias(f"{c}__m") for c in holes],
        *[F.coalesce(known(df, c), F.lit(start.get(c))).alias(f"{c}__v") for c in nums],
        *[F.when(is_missing(df, c), F.lit(0.0)).otherwise(F.col(f"{c}__i")).alias(f"{c}__v")
          for c in cats],
    )
    kept = state.columns
    weight = COUNT if counted else None
    sizes = {c: labels[c].count() for c in cats}
    runs = _runs(holes, numbers if 1 + len(nums) + len(extra) + sum(sizes.values()) <= DENSE else set())
    inputs = _Inputs(state, nums, extra, sizes, weight) if any(c in numbers for c in holes) else None
    for _ in range(max_iter):
        before = state.withColumns({f"{c}__p": F.col(f"{c}__v") for c in holes})
        state = before
        for dense, run in runs:
            if dense:
                state = inputs.renew(state, run)
                continue
            c = run[0]
            state = _one_column(state, c, [x for x in nums if x != c],
                                [x for x in cats if x != c], extra, c in numbers, weight)
        state = stored(state)
        moved = reduce(lambda a, b: a | b, [
            F.col(f"{c}__m") & (F.abs(F.col(f"{c}__v") - F.col(f"{c}__p"))
                                > 1e-6 * (1 + F.abs(F.col(f"{c}__p")))) for c in holes])
        changed = state.filter(moved).agg(F.coalesce(F.sum(weight), F.lit(0)) if weight else F.count(F.lit(1))).first()[0]
        state = state.select(*kept)
        if changed < tol * rows:
            break
    if counted:
        # The masks, not the holes' own values, decide what a row takes from its entry.
        entry = broadcast_if_few(state.select(*[F.col(c).alias(f"{c}__k") for c in seen],
                                              *[f"{c}__m" for c in holes], *[f"{c}__v" for c in holes]))
        state = whole.join(entry, reduce(lambda a, b: a & b, [present(whole, c).eqNullSafe(F.col(f"{c}__k")) for c in seen]))
    out = {c: F.when(F.col(f"{c}__m"), F.col(f"{c}__v")).otherwise(F.col(c).cast("double"))
           for c in holes if c in numbers}
    for c in (c for c in holes if c in texts):
        guess = labels[c].select(F.col("label").alias(f"{c}__l"), F.col("index").alias(f"{c}__n"))
        state = state.join(guess, F.col(f"{c}__m") & (F.col(f"{c}__v") == F.col(f"{c}__n")), "left")
        out[c] = F.coalesce(F.col(c), F.col(f"{c}__l"))
    return state.select(*[
        out[c].alias(c) if c in out else F.col(c) for c in whole.columns if c not in dropped])


def _counted_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """``fill_values`` by the median, of rows that each stand for ``COUNT`` ones."""
    values = unpivot(df, cols, [COUNT]).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.sum(COUNT).cast("long").alias("n"))
    found = bounded_rows(counted_quantiles(values, "value", [0.5], ["feature"]), len(cols), "medians")
    return {r["feature"]: r["value"] for r in found}


def _runs(holes: Sequence[str], dense: set[str]) -> list[tuple[bool, list[str]]]:
    """The columns in order: neighbours that share a pass, at most ``RUN``, or single ones."""
    out: list[tuple[bool, list[str]]] = []
    for c in holes:
        if c in dense and out and out[-1][0] and len(out[-1][1]) < RUN:
            out[-1][1].append(c)
        else:
            out.append((c in dense, [c]))
    return out


def sweep(matrix: np.ndarray, pivots: Sequence[int], tol: float = 1e-9) -> np.ndarray:
    """Sweep a Gram matrix on the pivots: row k of another column is then its coefficient on k.

    A pivot that the earlier ones explain keeps no weight.
    """
    a, start = matrix.astype(float).copy(), np.diag(matrix).copy()
    left_out = []
    for k in pivots:
        if a[k, k] <= tol * start[k]:
            left_out.append(k)
            continue
        d, row, col = a[k, k], a[k] / a[k, k], a[:, k].copy()
        a -= np.outer(col, row)
        a[k], a[:, k], a[k, k] = row, -col / d, 1.0 / d
    a[left_out] = 0.0
    return a


class _Inputs:
    """The inputs of the regressions as one vector: 1, numbers about their mean, 0/1 per level."""

    def __init__(self, state: DataFrame, nums: list[str], extra: list[str], sizes: dict[str, int],
                 weight: str | None = None):
        self.values = [*[f"{c}__v" for c in nums], *extra]
        self.cats = [f"{c}__v" for c in sizes]
        self.sizes = list(sizes.values())
        self.width = 1 + len(self.values) + sum(self.sizes)
        self.weight = weight
        if weight is None:
            found = state.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                                for c in self.values]).first()
        else:
            def mean(value: Column, c: str) -> Column:
                return F.sum(value * F.col(weight)) / F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))

            means = state.agg(*[mean(F.col(c), c).alias(c) for c in self.values]).first()
            spread = state.agg(*[F.sqrt(mean((F.col(c) - F.lit(means[c])) ** 2, c)).alias(c) for c in self.values]).first()
            found = {c: {"m": means[c], "s": spread[c]} for c in self.values}
        self.shift = np.array([found[c]["m"] or 0.0 for c in self.values])
        self.scale = np.array([found[c]["s"] or 1.0 for c in self.values])

    def grams(self, state: DataFrame, run: list[str]) -> np.ndarray:
        """One Gram matrix per pattern of missing cells, in one pass."""
        values, cats, sizes = self.values, self.cats, self.sizes
        shift, scale, width, masks = self.shift, self.scale, self.width, [f"{c}__m" for c in run]
        weight = self.weight

        def part(batch: pa.RecordBatch) -> np.ndarray:
            n = batch.num_rows
            z = np.zeros((n, width))
            z[:, 0] = 1.0
            for j, c in enumerate(values):
                x = batch[c].to_numpy(zero_copy_only=False).astype(float)
                z[:, 1 + j] = np.nan_to_num((x - shift[j]) / scale[j])
            at = 1 + len(values)
            for c, size in zip(cats, sizes):
                level = batch[c].to_numpy(zero_copy_only=False).astype(int)
                there = np.flatnonzero(level < size)
                z[there, at + level[there]] = 1.0
                at += size
            code = np.zeros(n, dtype=int)
            for i, c in enumerate(masks):
                code |= batch[c].to_numpy(zero_copy_only=False).astype(int) << i
            out = np.zeros((2 ** len(masks), width, width))
            number = batch[weight].to_numpy(zero_copy_only=False) if weight else np.ones(n)
            for p in np.unique(code):
                rows = z[code == p]
                out[p] = rows.T @ (rows * number[code == p, None])
            return out.reshape(-1, width)

        columns = [*[F.col(c).cast("double").alias(c) for c in values], *cats, *masks,
                   *([weight] if weight else [])]
        flat = summed_matrix(state.select(*columns), part, (2 ** len(masks) * width, width))
        return flat.reshape(-1, width, width)

    def renew(self, state: DataFrame, run: list[str]) -> DataFrame:
        """Fit each column of the run on its known rows and renew its missing cells, in order."""
        grams = self.grams(state, run)
        names = state.columns
        for i, c in enumerate(run):
            place = 1 + self.values.index(f"{c}__v")
            holds = (np.arange(len(grams)) >> i) & 1 == 1
            others = [k for k in range(self.width) if k != place]
            weights = sweep(grams[~holds].sum(axis=0), others)[:, place].copy()
            weights[place] = 0.0
            step = np.eye(self.width)
            step[place] = weights
            grams[holds] = step @ grams[holds] @ step.T
            renewed = F.when(F.col(f"{c}__m"), self.predicted(weights, place)).otherwise(F.col(f"{c}__v"))
            state = state.select(*[renewed.alias(n) if n == f"{c}__v" else F.col(n) for n in names])
        return state

    def predicted(self, weights: np.ndarray, place: int) -> Column:
        scale, n = self.scale[place - 1], len(self.values)
        slopes = scale * weights[1:1 + n] / self.scale
        out = F.lit(float(self.shift[place - 1] + scale * weights[0] - slopes @ self.shift))
        for c, slope, mean in zip(self.values, slopes, self.shift):
            if slope:
                out = out + F.lit(float(slope)) * F.coalesce(F.col(c).cast("double"), F.lit(float(mean)))
        at = 1 + n
        for c, size in zip(self.cats, self.sizes):
            effects = F.array(*[F.lit(float(scale * w)) for w in weights[at:at + size]])
            out = out + F.coalesce(F.get(effects, F.col(c).cast("int")), F.lit(0.0))
            at += size
        return out


def _one_column(state: DataFrame, col: str, nums: list[str], cats: list[str],
                extra: list[str], numeric: bool, weight: str | None = None) -> DataFrame:
    """Fit on the observed rows of a column and renew its missing cells."""
    inputs = [f"{c}__v" for c in nums] + list(extra)
    stages: list = []
    if cats:
        hot = [f"{c}__h" for c in cats]
        stages.append(OneHotEncoder(inputCols=[f"{c}__v" for c in cats], outputCols=hot,
                                    dropLast=True, handleInvalid="keep"))
        inputs = inputs + hot
    if not inputs:
        return state
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__x"))
    where = {"featuresCol": "__x", "labelCol": f"{col}__v", "predictionCol": "__y", **({"weightCol": weight} if weight else {})}
    if numeric:
        stages.append(LinearRegression(**where))
    else:
        stages.append(LogisticRegression(**where, family="multinomial", maxIter=20,
                                         probabilityCol="__pr", rawPredictionCol="__r"))
    model = Pipeline(stages=stages).fit(state.filter(~F.col(f"{col}__m")))
    renewed = F.when(F.col(f"{col}__m"), F.col("__y")).otherwise(F.col(f"{col}__v"))
    names = state.columns
    return model.transform(state).select(
        *[renewed.alias(c) if c == f"{col}__v" else F.col(c) for c in names])
