"""States at the borders of the parts of many sequences, by a tree of associative products.

Every part has a matrix (bytes) from entry states to exit states. Up the tree, ``FAN`` consecutive
matrices of a sequence become their product, until each sequence has one. Down the tree, the states
at the two ends of a product decide those between its factors. A task holds at most ``FAN`` matrices,
so a sequence of N parts takes log(N) / log(FAN) rounds and no task sees a whole sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed

FAN = 64
Product = Callable[[Sequence[bytes]], bytes]
Route = Callable[[Sequence[bytes], bytes, bytes], list[bytes]]
Ends = Callable[[bytes], tuple[bytes, bytes]]


def borders(parts: DataFrame, product: Product, ends: Ends, route: Route, fan: int = FAN) -> DataFrame:
    """Columns ``uid, chunk, entry, leave`` of every part; ``parts`` has ``uid, chunk, matrix``.

    Chunks of a sequence count from 0 without gaps. ``product`` multiplies matrices in order, ``ends``
    chooses the states at both ends of a whole sequence, and ``route(matrices, entry, leave)`` the
    states at all borders of a run, both ends included.
    """
    kind = parts.schema["uid"].dataType.simpleString()
    parts = parts.select("uid", F.col("chunk").cast("long").alias("chunk"), "matrix")

    def multiplied(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        return pd.DataFrame({"uid": group["uid"].iloc[:1], "chunk": group["up"].iloc[:1],
                             "matrix": [product(group["matrix"].tolist())]})

    def routed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        states = route(group["matrix"].tolist(), group["entry"].iloc[0], group["leave"].iloc[0])
        return pd.DataFrame({"uid": group["uid"], "chunk": group["chunk"], "entry": states[:-1], "leave": states[1:]})

    def whole(batches):
        for frame in batches:
            both = [ends(m) for m in frame["matrix"]]
            yield pd.DataFrame({"uid": frame["uid"], "chunk": frame["chunk"], "entry": [e for e, _ in both],
                                "leave": [x for _, x in both]})

    levels = [parts]
    most = parts.agg(F.max("chunk")).first()[0] or 0
    up = F.expr(f"chunk div {fan}").alias("up")
    while most:
        level = levels[-1].select("*", up).groupBy("uid", "up").applyInPandas(
            multiplied, f"uid {kind}, chunk long, matrix binary")
        levels.append(checkpointed(level))
        most //= fan
    states = levels[-1].mapInPandas(whole, f"uid {kind}, chunk long, entry binary, leave binary")
    for level in levels[-2::-1]:
        above = states.select("uid", F.col("chunk").alias("up"), "entry", "leave")
        states = level.select("*", up).join(above, ["uid", "up"]).groupBy("uid", "up").applyInPandas(
            routed, f"uid {kind}, chunk long, entry binary, leave binary")
    return states
