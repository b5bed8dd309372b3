"""Connected components of a link table, by alternating large-star and small-star rounds.

Tasks first replace the links they hold by stars (union-find), so rounds move one link for each node and
task. Links that one task may hold need no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed, packed
from scoreflow.llm.common import Forest

LINKS_AT_ONCE = 1 << 16  # links that a task joins together


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node next to it."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each LINKS_AT_ONCE rows of a task, as links of every node to the smallest it reaches by them."""
    held: list[np.ndarray] = []

    def joined() -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *held]), return_inverse=True)
        forest, ends = Forest(len(nodes)), at.reshape(-1, 2)
        forest.link(ends[:, 0], ends[:, 1])
        root = forest.roots()
        own = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])

    for batch in rows:
        both = np.stack([batch["u"].to_numpy(), batch["v"].to_numpy()], axis=1)
        while len(both):
            room = LINKS_AT_ONCE - sum(map(len, held))
            held.append(both[:room])
            both = both[room:]
            if sum(map(len, held)) == LINKS_AT_ONCE:
                yield joined()
                held = []
    if held:
        yield joined()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``node, component``: every linked node with the smallest node it can reach.

    ``links`` may repeat pairs, hold both directions and self-links; nodes are whole numbers. Nodes without
    a link do not appear. Each round is one reliable checkpoint; the number of rounds is logarithmic.
    """
    edges, rows = packed(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), LINKS_AT_ONCE)
    edges = checkpointed(edges.mapInArrow(_stars, "u long, v long"))
    before = _state(edges) if rows > LINKS_AT_ONCE else (0,)
    while before[0]:
        edges = checkpointed(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
