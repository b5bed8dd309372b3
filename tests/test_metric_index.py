"""The metric index against brute force, and what it compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreflow.operators import metric_index


def plain(x, keys, k):
    out = {}
    for i, key in enumerate(keys):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = sorted((float(d), keys[j], j) for j, d in enumerate(far) if j != i)[:k]
        out[key] = [(n, round(d, 9)) for d, n, _ in order]
    return out


def found(df, digits=9):
    by = {}
    for r in df.orderBy("key", "rank").collect():
        by.setdefault(r["key"], []).append((r["neighbour"], round(r["distance"], digits)))
    return by


def frame(spark, x, keys):
    cols = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(k, *map(float, r)) for k, r in zip(keys, x)], ["key", *cols]), cols


def clustered(n, width, groups, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, width))[rng.integers(groups, size=n)] * 8 + rng.normal(size=(n, width)) * 0.5


def test_exact_on_clusters_with_few_pairs(spark):
    x = clustered(1500, 6, 40, 1)
    points, cols = frame(spark, x, range(1500))
    got = found(metric_index.nearest_by_index(points, "key", cols, 4))
    assert got == plain(x, list(range(1500)), 4)
    assert metric_index.compared_share(points, "key", cols, 4, probes=2) < 0.2


def test_probes_alone_reach_the_recall(spark):
    x = clustered(1500, 6, 40, 2)
    points, cols = frame(spark, x, range(1500))
    want = plain(x, list(range(1500)), 4)
    got = found(metric_index.nearest_by_index(points, "key", cols, 4, exact=False))
    right = sum(len({n for n, _ in got.get(k, [])} & {n for n, _ in v}) for k, v in want.items())
    assert right >= 0.9 * 4 * 1500
    assert metric_index.compared_share(points, "key", cols, 4, exact=False) < 0.2


def test_exact_without_structure(spark, monkeypatch):
    monkeypatch.setattr(metric_index, "BLOCK_ROWS", 16)
    x = np.random.default_rng(3).normal(size=(300, 16))
    points, cols = frame(spark, x, range(300))
    assert found(metric_index.nearest_by_index(points, "key", cols, 3)) == plain(x, list(range(300)), 3)
    assert metric_index.compared_share(points, "key", cols, 3) > 0.5  # nothing to prune by


def test_ties_copies_and_small_tables(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, size=(200, 2)).astype(float)
    keys = [int(k) for k in rng.permutation(1000)[:200]]
    points, cols = frame(spark, x, keys)
    assert found(metric_index.nearest_by_index(points, "key", cols, 5)) == plain(x, keys, 5)
    holes = points.unionByName(spark.createDataFrame([(5000, None, 1.0)], points.schema))
    assert metric_index.nearest_by_index(holes, "key", cols, 5).where("key = 5000 or neighbour = 5000").count() == 0
    assert metric_index.nearest_by_index(points.limit(0), "key", cols, 5).count() == 0
    few = points.limit(3)
    assert all(len(v) == 2 for v in found(metric_index.nearest_by_index(few, "key", cols, 5)).values())
    named = points.select(F.format_string("k%04d", "key").alias("key"), *cols)
    assert {k: [int(n[1:]) for n, _ in v] for k, v in found(metric_index.nearest_by_index(named, "key", cols, 5)).items()} == {
        f"k{k:04d}": [n for n, _ in v] for k, v in plain(x, keys, 5).items()}
    with pytest.raises(Exception):
        metric_index.nearest_by_index(points, "key", ["none"], 5)


def test_least_pairs_are_those_of_brute_force():
    from scoreflow.operators.block_search import least_pairs, squares

    rng = np.random.default_rng(5)
    for width in (2, 16):
        a = np.round(rng.normal(size=(40, width)), 1)
        b = np.concatenate([a[:20], np.round(rng.normal(size=(60, width)), 1)])
        own = np.where(np.arange(40) < 20, np.arange(40), -1)
        row, column, far = least_pairs(a, b, own, 3)
        all_far = squares(a, b)
        all_far[np.arange(20), np.arange(20)] = np.inf
        want = np.argsort(all_far, axis=1, kind="stable")[:, :3]
        assert (column.reshape(40, 3) == want).all() and (row.reshape(40, 3) == np.arange(40)[:, None]).all()
        assert (far.reshape(40, 3) == np.take_along_axis(all_far, want, 1)).all()


def test_nearest_counts_copies_once_and_leaves_holes_out(spark):
    from scoreflow.operators import neighbours

    rng = np.random.default_rng(6)
    # Far from zero, so that wide cells of a projection hold all points.
    x = 1000.0 + np.concatenate([np.zeros((60, 5)), np.round(rng.normal(size=(80, 5)), 1)])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    cols = [f"c{i}" for i in range(5)]
    points = spark.createDataFrame([*rows, (1000, None, 0.0, 0.0, 0.0, 0.0)], "id int, " + ", ".join(f"{c} double" for c in cols))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    for found in (neighbours.nearest(points, "id", cols, 4),
                  neighbours.nearest_by_hashing(points, "id", cols, 4, num_hash_tables=1, together=1, bucket_length=1e6)):
        got = {(r["key"], r["rank"]): (r["neighbour"], r["distance"]) for r in found.collect()}
        assert len(got) == 4 * len(x) and not any(1000 in (k[0], v[0]) for k, v in got.items())
        for i in range(len(x)):
            want = np.sort(far[i])[:4]
            assert np.allclose([got[i, r][1] for r in range(1, 5)], want)
            assert all(abs(far[i, got[i, r][0]] - got[i, r][1]) < 1e-9 for r in range(1, 5))
