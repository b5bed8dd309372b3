"""Ordered running sums, ranks, ntile and quantiles without a one-task window.

A window with no partition key sends every row to one task. Here the rows are
first counted per distinct ordering value, the values are split into cells by
approximate percentiles, and each cell runs its own window on top of the sum of
the cells before it. The splits only balance the work: any splits give the same sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreflow.functions.core import bounded_rows, checkpointed, hash_cell, hashed, known

_CELL, _SPLITS, _BLOCK = "_cell", "_splits", "_block"


def default_cells(df: DataFrame) -> int:
    """Cells per run: a few per shuffle task, at least 32."""
    return max(32, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _with_cells(counts: DataFrame, order: str, values: Sequence[str], cells: int) -> DataFrame:
    # The splits read the same columns as the sums, so that all branches share one exchange.
    # Expressions as text: thousands of nested columns made one by one keep the driver busy for seconds.
    value = f"CAST({_quoted(order)} AS DOUBLE)"
    touched = " AND ".join(f"{_quoted(v)} >= 0" for v in values)
    probs = ", ".join(f"{i / cells!r}D" for i in range(1, cells))
    found = f"percentile_approx(CASE WHEN {touched} THEN {value} END, array({probs}), {10 * cells})"
    splits = counts.agg(F.expr(found).alias("s") if cells > 1 else F.lit(None).cast("array<double>").alias("s")).select(
        F.coalesce(F.array_distinct("s"), F.array().cast("array<double>")).alias("s"))
    # Two short searches, of the last split of each block, then inside one. Plain comparisons are compiled;
    # a lambda over the splits cost each row about 20 to 80 microseconds.
    size = math.isqrt(cells) + 1
    below = lambda at: f"CAST(coalesce(get({_SPLITS}, {at}) < {value}, false) AS INT)"
    heads = F.expr(" + ".join(below(i * size + size - 1) for i in range(size)))
    inside = F.expr(" + ".join(below(f"{_BLOCK} * {size} + {i}") for i in range(size)))
    return (
        counts.withColumn(_SPLITS, splits.scalar())
        .withColumn(_BLOCK, heads)
        .withColumn(_CELL, F.col(_BLOCK) * size + inside)
        .drop(_SPLITS, _BLOCK)
    )


def running_sums(counts: DataFrame, order: str, values: Sequence[str],
                 by: Sequence[str] = (), descending: bool = False,
                 cells: int | None = None) -> DataFrame:
    """Add ``cum_<v>`` (inclusive) and ``tot_<v>`` per group of ``by``.

    ``counts`` holds at most one row per (``by``, ``order``): equal ordering values
    are one step, as with the default window frame. ``values`` are non-negative.
    Rows whose ordering value is null are dropped.
    """
    by = list(by)
    counts = counts.filter(F.col(order).isNotNull())
    celled = _with_cells(counts, order, values, cells or default_cells(counts))

    def direction(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    totals = celled.groupBy(*by, _CELL).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    group = [F.col(b) for b in by] or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy(direction(_CELL)).rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(
        *[F.col(b).alias(f"_k_{b}") for b in by],
        F.col(_CELL).alias("_k_cell"),
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_t_{v}").over(whole).alias(f"tot_{v}") for v in values],
    )
    on = [F.col(_CELL) == F.col("_k_cell")] + [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by]
    inside = Window.partitionBy(*[F.col(b) for b in by], F.col(_CELL)).orderBy(direction(order))
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = celled.join(offsets, reduce(lambda a, b: a & b, on))
    return joined.select(
        *counts.columns,
        *[(F.col(f"_o_{v}") + F.sum(v).over(inside)).alias(f"cum_{v}") for v in values],
        *[F.col(f"tot_{v}") for v in values],
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (``by``, value) as column ``n``."""
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, value: str, probs: Sequence[float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles, one row per (``by``, ``prob``).

    The values are looked up by rank in the running counts, so neither a sort of
    all rows nor a per-group buffer of values is needed.
    """
    return counted_quantiles(value_counts(df, value, by), value, probs, by)


def counted_quantiles(counts: DataFrame, value: str, probs: Sequence[float],
                      by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of values counted as ``n`` per (``by``, value); null values are left out."""
    run = running_sums(counts.select(*by, value, "n"), value, ["n"], by)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    place = lambda p: p * (F.col("tot_n") - 1)
    first = F.col("cum_n") - F.col("n")  # ranks first+1 .. cum_n hold this value
    holds = lambda r: (r > first) & (r <= F.col("cum_n"))
    hit = lambda p: holds(F.floor(place(p)) + 1) | holds(F.ceil(place(p)) + 1)
    # Few rows hold a wanted rank: compiled comparisons find them, only those are looked up in the array.
    found = run.filter(reduce(lambda a, b: a | b, [hit(F.lit(float(p))) for p in probs]))
    rows = found.withColumn("prob", F.explode(F.filter(wanted, hit)))
    low, high = F.floor(place(F.col("prob"))) + 1, F.ceil(place(F.col("prob"))) + 1
    ends = rows.groupBy(*by, "prob").agg(
        F.max(F.when((low > first) & (low <= F.col("cum_n")), F.col(value))).alias("_lo"),
        F.max(F.when((high > first) & (high <= F.col("cum_n")), F.col(value))).alias("_hi"),
        F.max(place(F.col("prob")) - F.floor(place(F.col("prob")))).alias("_w"),
    )
    return ends.select(
        *by, "prob",
        (F.col("_lo").cast("double") + (F.col("_hi") - F.col("_lo")).cast("double") * F.col("_w"))
        .alias(value),
    )


def global_rank(df: DataFrame, id_col: str, seed: int, name: str = "rank") -> DataFrame:
    """A dense 1..n rank in hashed order of a unique id, spread over hash cells."""
    h = hashed(id_col, seed)
    keyed = df.withColumn("_h", h).withColumn("_c", hash_cell(F.col("_h")))
    sizes = df.select(hash_cell(h).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    # 65,536 cells at most, whatever the number of rows.
    offsets = sizes.select("_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_c").orderBy("_h", id_col)
    return (
        keyed.join(F.broadcast(offsets), F.col("_c") == F.col("_k"))
        .withColumn(name, F.col("_o") + F.row_number().over(inside))
        .drop("_h", "_c", "_k", "_o")
    )


def rank_by(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with its rank (from 0) in any order of columns: a range sort and counts per partition."""
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order)
                          .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # One row per partition.
    before = Window.partitionBy(F.lit(0)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(F.col("_part").alias("_of")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).select(
        "_of", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(starts, F.col("_part") == F.col("_of")).withColumn(
        name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_of", "_shift")


def ntile(df: DataFrame, score: str, id_col: str, n: int, name: str = "band",
          seed: int = 0) -> DataFrame:
    """Exact ``ntile(n)`` by (score, hash of id, id), ascending.

    Only the last keys of the first n-1 tiles are looked up (n-1 rows reach the driver);
    every row then compares itself with them, so the rows are never shuffled. Equal
    scores that straddle a tile edge are ordered by the hash of the id, cell by cell.
    Missing scores (null or NaN) are one tie below all others, so every row has a tile.
    """
    value = F.coalesce(known(df, score), F.lit(float("-inf")))
    edges = _tile_edges(df.select(value.alias("s")), n)
    split = [e for e in edges if e["r"] < e["n"]]
    ties = _tie_keys(df, value, id_col, split, seed) if split else {}
    tile = None
    own = F.struct(hashed(id_col, seed).alias("h"), F.col(id_col).cast("string").alias("i"))
    for edge in sorted(edges, key=lambda e: e["j"]):
        s = F.lit(edge["s"])
        if edge["j"] in ties:
            key = ties[edge["j"]]
            upto = (value < s) | ((value == s) & (own <= F.struct(F.lit(key["h"]).alias("h"),
                                                                  F.lit(key["i"]).alias("i"))))
        else:
            upto = value <= s
        tile = F.when(upto, edge["j"]) if tile is None else tile.when(upto, edge["j"])
    return df.withColumn(name, F.lit(n) if tile is None else tile.otherwise(n))


def _tile_edges(scores: DataFrame, n: int) -> list:
    """Score at the last rank of tiles 1..n-1, and that rank among the equal scores."""
    run = running_sums(value_counts(scores, "s"), "s", ["n"])
    total, first = F.col("tot_n"), F.col("cum_n") - F.col("n")
    last = lambda j: j * F.floor(total / n).cast("long") + F.least(j, total % n)
    tiles = F.array(*[F.lit(j).cast("long") for j in range(1, n)]) if n > 1 else None
    if tiles is None:
        return []
    hits = F.filter(tiles, lambda j: (last(j) > first) & (last(j) <= F.col("cum_n")))
    found = run.select("s", F.explode(hits).alias("j"), "n", "tot_n", "cum_n")
    return bounded_rows(found.select("s", "j", "n", (last(F.col("j")) - first).alias("r")),
                        n, "tile edges")


def _tie_keys(data: DataFrame, score: Column, id_col: str, split: list, seed: int) -> dict:
    """(hash, id) of the row at each split edge, found inside one hash cell per edge."""
    spark = data.sparkSession
    values = sorted({e["s"] for e in split})
    tied = data.filter(score.isin(values)).select(
        score.alias("s"), F.col(id_col).cast("string").alias("i"),
        hashed(id_col, seed).alias("h")).withColumn("c", hash_cell(F.col("h")))
    # One row per tile edge, so at most the number of tiles.
    edges = F.broadcast(spark.createDataFrame(
        [(e["s"], e["j"], e["r"]) for e in split], "es double, j long, r long"))
    sizes = tied.groupBy("s", "c").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("u", F.sum("n").over(upto)).join(edges, F.col("s") == F.col("es"))
    inside = (F.col("u") >= F.col("r")) & (F.col("u") - F.col("n") < F.col("r"))
    cells = bounded_rows(sizes.filter(inside).select(
        "j", "s", "c", (F.col("r") - F.col("u") + F.col("n")).alias("left")),
        len(split), "tie cells")
    wanted = F.broadcast(spark.createDataFrame(
        [(c["j"], c["s"], c["c"], c["left"]) for c in cells],
        "j long, ws double, wc int, left long"))
    rank = F.row_number().over(Window.partitionBy("j").orderBy("h", "i"))
    at_edge = tied.join(wanted, (F.col("s") == F.col("ws")) & (F.col("c") == F.col("wc")))
    keys = at_edge.withColumn("k", rank).filter(F.col("k") == F.col("left"))
    return {row["j"]: row for row in bounded_rows(keys.select("j", "h", "i"),
                                                  len(split), "tie keys")}


def difference(df: DataFrame, value: str, order: str, by: Sequence[str] = (),
               name: str = "delta") -> DataFrame:
    """Value minus the value of the row before it (0 before the first).

    Meant for band tables, a few rows per group.
    """
    group = [F.col(b) for b in by] or [F.lit(0)]
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))
