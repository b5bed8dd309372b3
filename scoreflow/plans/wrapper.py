"""Swarm search for the feature set with the best holdout KS."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from scoreflow.operators.sampling import split
from scoreflow.plans.tuning import each, fit_measure

HISTORY = "iteration int, fitness double, ks double, n_features int"


def wrapper_select(df: DataFrame, id_col: str, cols: Sequence[str], target: str,
                   particles: int = 30, iters: int = 50, penalty: float = 0.01,
                   family: str = "boosted", params: Mapping[str, Any] | None = None,
                   seed: int = 42, parallelism: int = 1) -> tuple[list[str], DataFrame]:
    """Minimise -KS + penalty * features; returns (features, history).

    The state of the swarm is particles x columns numbers on the driver. The value of a
    mask is one Spark fit on the training rows and the KS on the held-out rows; masks are
    never fitted twice. The positions of an iteration do not depend on each other's values, so its
    new masks are fitted ``parallelism`` at a time with the same result. A column is in when its
    position is above one half.
    """
    cols, rng = list(cols), random.Random(seed)
    train, test = split(df.select(id_col, target, *cols), id_col, 0.3, seed)
    train, test = train.persist(), test.persist()
    seen: dict[tuple[bool, ...], float] = {}

    def mask_of(position: list[float]) -> tuple[bool, ...]:
        return tuple(x > 0.5 for x in position)

    def ks_of(mask: tuple[bool, ...]) -> float:
        chosen = [c for c, used in zip(cols, mask) if used]
        found = fit_measure(family, params or {}, train, {"t": test}, chosen, target, seed)
        return found[1]["t"].get("ks") or 0.0

    def fit_new(positions: list[list[float]]) -> None:
        new = [m for m in dict.fromkeys(map(mask_of, positions)) if any(m) and m not in seen]
        seen.update(zip(new, each([lambda m=m: ks_of(m) for m in new], parallelism)))

    def fitness(position: list[float]) -> tuple[float, float, int]:
        mask = mask_of(position)
        value = seen.get(mask, 0.0)
        return -value + penalty * sum(mask), value, sum(mask)

    try:
        places = [[rng.random() for _ in cols] for _ in range(particles)]
        speeds = [[0.0] * len(cols) for _ in range(particles)]
        best = [(math.inf, 0.0, 0, p) for p in places]
        top: tuple = (math.inf, 0.0, 0, places[0])
        history = []
        for step in range(iters):
            fit_new(places)
            for i, place in enumerate(places):
                value, ks, size = fitness(place)
                if value < best[i][0]:
                    best[i] = (value, ks, size, list(place))
                if value < top[0]:
                    top = (value, ks, size, list(place))
            history.append((step, float(top[0]), float(top[1]), int(top[2])))
            for i, place in enumerate(places):
                for j in range(len(cols)):
                    pull = rng.random() * (best[i][3][j] - place[j])
                    pull += rng.random() * (top[3][j] - place[j])
                    speeds[i][j] = 0.5 * speeds[i][j] + 0.5 * pull
                    place[j] = min(1.0, max(0.0, place[j] + speeds[i][j]))
        names = [c for c, x in zip(cols, top[3]) if x > 0.5]
        return names, df.sparkSession.createDataFrame(history, HISTORY)
    finally:
        train.unpersist()
        test.unpersist()
