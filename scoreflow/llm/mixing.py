"""Mixing sources to target weights with Pfair windows and earliest deadline first.

Each source's rows, in hashed order, form blocks. Time is a sequence of slots of one block. A
source with ``a`` of the ``D`` slots of a period gets its k-th block released at floor(k D / a)
and due at ceil((k + 1) D / a); each slot takes the released block with the earliest deadline. All
windows are met, so after any number of slots each source is less than one block from its target,
and the schedule repeats every D slots. The schedule of one period (D entries, a parameter) is
all the driver makes (of a period longer than the table, only the blocks there are); a row's slot
follows from its rank within its source by arithmetic.

Every row is kept exactly once. A source that runs out leaves its slots empty, and the others keep
their shares relative to each other. Rows with null source form a source of their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NULL_SOURCE = "n"
ROWS_A_CELL = 2_000
MOST_BROADCAST = 65_536


def exact_shares(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole slots of the shortest period in which every source gets its exact share.

    A weight counts as the decimal number it is written as.
    """
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("target weights must be positive")
    parts = {s: Fraction(str(w)) for s, w in weights.items()}
    whole = math.lcm(*(w.denominator for w in parts.values()))
    least = math.gcd(*(int(w * whole) for w in parts.values()))
    return {s: int(w * whole) // least for s, w in parts.items()}


def turns_of(share: Mapping[str, int], blocks: Mapping[str, int]) -> tuple[list[str], np.ndarray]:
    """(source, block, slot) of the given numbers of blocks, up to one period: names, and an array.

    Each slot takes the released block with the earliest deadline; where none is released, time moves
    on to the next release. So the work is that of the blocks there are, however long the period. A
    source that has run out leaves slots to others within their windows, so all windows are met.
    """
    period, names = sum(share.values()), sorted(share)
    # Python integers: releases of long periods don't fit in 64 bits.
    parts, limit = [share[s] for s in names], [min(blocks[s], share[s]) for s in names]
    waiting = [(0, i, 0) for i in range(len(names)) if limit[i]]
    ready: list[tuple[int, int, int]] = []
    made = np.empty((sum(limit), 3), np.int64)
    t = 0
    for place in range(len(made)):
        if not ready and waiting[0][0] > t:
            t = waiting[0][0]
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // parts[i]), i, k))
        due, i, k = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        made[place] = i, k, t
        if k + 1 < limit[i]:
            heapq.heappush(waiting, ((k + 1) * period // parts[i], i, k + 1))
        t += 1
    return names, made


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = 64,
        key: str = "doc_id", source: str = "source",
        tie: str | None = "text", seed: int = 7, default_weight: float = 1.0) -> DataFrame:
    """All rows and columns of ``docs`` as struct ``row`` with ``block, slot, place``.

    ``slot, place`` order the mixture. ``weights`` maps sources to target weights; others get
    ``default_weight``. Rows of a source are ordered by md5 of key and seed, then key, then ``tie``.
    The period is the shortest that gives every source its exact share. The list of sources reaches
    the driver, and the driver places the blocks of one period at most, 24 bytes each: with weights
    of a long period that is every block, so ``block_rows`` is to grow with the table. Rows with null
    key are ordered like the key ''; rows alike in key and tie are interchangeable.
    """
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(NULL_SOURCE))
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    more = F.md5(F.coalesce(F.col(tie).cast("string"), F.lit(""))) if tie else F.lit("")
    rows = docs.select(F.struct("*").alias("row"), name.alias("src"),
                       F.md5(F.concat(text, F.lit(f"|{seed}"))).alias("h"), text.alias("id"),
                       more.alias("tie"))
    counts = {r["src"]: r["count"] for r in rows.groupBy("src").count().collect()}
    if not counts:
        return rows.select("row", F.lit(0).cast("long").alias("block"),
                           F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("place"))
    target = {s: float((weights or {}).get(None if s == NULL_SOURCE else s[1:], default_weight))
              for s in counts}
    share = exact_shares(target)
    length = sum(share.values())
    names, turns = turns_of(share, {s: -(-n // block_rows) for s, n in counts.items()})
    spark = docs.sparkSession
    plan = spark.createDataFrame(pa.table(dict(zip(("number", "turn", "at"), turns.T.copy()))))
    plan = F.broadcast(plan) if len(turns) <= MOST_BROADCAST else plan
    # Ranks without a one-task window: count per hash cell, add up the cells, rank inside a cell.
    digits = max(1, math.ceil(math.log(max(counts.values()) / ROWS_A_CELL + 1, 16)))
    rows = rows.withColumn("cell", F.substring("h", 1, digits))
    cells = rows.groupBy("src", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("src", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "cell").orderBy("h", "id", "tie")
    ranked = (rows.withColumn("rank", F.row_number().over(inside) - 1)
              .join(cells, ["src", "cell"]).withColumn("rank", F.col("rank") + F.col("before"))
              .withColumn("block", F.floor(F.col("rank") / block_rows)))
    share_of = F.broadcast(spark.createDataFrame(
        [(s, i, str(share[s])) for i, s in enumerate(names)], "src string, number long, share string"))
    # A share beyond the blocks there are, of any size, is one period that is not finished.
    ranked = ranked.join(share_of, "src").withColumn("share", F.coalesce(F.col("share").try_cast("long"), F.lit((1 << 63) - 1)))
    ranked = ranked.withColumn("turn", F.col("block") % F.col("share")).withColumn("round", F.expr("block div share"))
    placed = ranked.join(plan, ["number", "turn"])
    # Where a second round begins, the period is that of a share in 64 bits.
    whole = F.lit(length) if length < 1 << 62 else F.lit(0)
    return placed.select(
        "row", "block", (F.col("round") * whole + F.col("at")).alias("slot"),
        (F.col("rank") % block_rows).alias("place"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` sorted into the mixture: rows and columns as given, in order of slot and place."""
    return mix(docs, **parameters).orderBy("slot", "place").select("row.*")
