"""Hand-computed frames, properties and brute-force comparisons."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreflow.functions import core
from scoreflow.operators import (association, balance, clean, curves, encode, frame, metrics,
                                 mice, neighbours, prefix, profile, sampling, scorecard, sets,
                                 stability)
from scoreflow.plans import models, tuning
from scoreflow.plans.wrapper import wrapper_select
from scoreflow.sources import runlog, tables


def scored(spark, n=400, seed=1, ties=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        s = rng.gauss(1.0 * y, 1.0)
        rows.append((f"r{i}", y, round(s, 1) if ties else s))
    return spark.createDataFrame(rows, "id string, target int, score double"), rows


def brute_auc(rows):
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def brute_ks(rows):
    pos, neg = sum(y for _, y, _ in rows), sum(1 - y for _, y, _ in rows)
    return max(sum(y for _, y, s in rows if s >= t) / pos
               - sum(1 - y for _, y, s in rows if s >= t) / neg for _, _, t in rows)


def test_rank_metrics_match_brute_force(spark):
    df, rows = scored(spark)
    got = metrics.rank_metrics(df, "score", "target").first()
    assert got["auc"] == pytest.approx(brute_auc(rows))
    assert got["ks"] == pytest.approx(brute_ks(rows))
    assert got["gini"] == pytest.approx(2 * brute_auc(rows) - 1)


def test_metrics_do_not_depend_on_partitions_or_cells(spark):
    df, _ = scored(spark)
    results = {
        tuple(round(x, 12) for x in metrics.rank_metrics(
            df.repartition(p), "score", "target").select("ks", "auc", "pr_auc").first())
        for p in (1, 8, 200)}
    assert len(results) == 1
    counts = prefix.value_counts(df, "score")
    sums = {tuple(sorted(map(tuple, prefix.running_sums(counts, "score", ["n"], cells=c)
                             .collect()))) for c in (1, 2, 7, 300)}
    assert len(sums) == 1


def test_increasing_map_keeps_ks_and_reversal_flips_auc(spark):
    df, _ = scored(spark)
    moved = df.withColumn("score", F.exp("score"))
    assert metrics.ks(df, "score", "target").first()["ks"] == pytest.approx(
        metrics.ks(moved, "score", "target").first()["ks"])
    turned = df.withColumn("score", -F.col("score"))
    assert metrics.roc_auc(turned, "score", "target").first()["auc"] == pytest.approx(
        1 - metrics.roc_auc(df, "score", "target").first()["auc"])


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, target int")
    row = metrics.rank_metrics(df, "score", "target").first()
    assert row["ks"] is None and row["auc"] is None


def test_hot_score_ntile_is_exact(spark):
    # A third of the rows share one score.
    rows = [(f"i{i}", 5.0 if i % 3 == 0 else float(i % 17)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, score double")
    sizes = prefix.ntile(df, "score", "id", 7).groupBy("band").count().collect()
    assert sorted(r["count"] for r in sizes) == [142] * 1 + [143] * 6
    low_high = prefix.ntile(df, "score", "id", 7).groupBy("band").agg(
        F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("band").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(low_high, low_high[1:]))


def test_ntile_more_bands_than_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, score double")
    assert sorted(r["band"] for r in prefix.ntile(df, "score", "id", 5).collect()) == [1, 2]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=301), 2).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["prob"]: r["v"] for r in prefix.quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0])
           .collect()}
    for p, v in got.items():
        assert v == pytest.approx(float(np.quantile(values, p)))


def test_partial_gini_of_given_bands(spark):
    bands = spark.createDataFrame(
        [(1, 50, 30), (2, 100, 20), (3, 200, 10), (4, 250, 5)], "band int, goods int, bads int")
    row = scorecard.partial_gini(bands).agg(
        F.sum("partial_auc").alias("a"), F.sum("partial_gini").alias("g")).first()
    assert row["g"] == pytest.approx(2 * row["a"] - 1)
    gaps = [r["ks"] for r in scorecard.band_cumulative(bands).orderBy("band").collect()]
    assert gaps[0] == pytest.approx(abs(50 / 600 - 30 / 65))


@pytest.mark.parametrize("x, want", [(0.05, "0.1"), (0.25, "0.3"), (-988.25, "-988.3"), (7.0, "7.0"), (99.94, "99.9")])
def test_one_decimal_rounds_half_up(spark, x, want):
    assert spark.createDataFrame([(x,)], "x double").select(core.one_decimal(F.col("x"))).first()[0] == want


def test_guard_and_missing(spark):
    with pytest.raises(TypeError):
        core.require_frame([1, 2])
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, t string")
    assert df.filter(core.is_missing(df, "x")).count() == 2
    assert df.filter(core.is_missing(df, "t")).count() == 1
    assert frame.drop_missing(df, ["x", "t"]).count() == 1
    assert profile.has_missing(df, ["x"]) and not profile.has_missing(df.limit(1), ["x"])


def test_text_to_numbers(spark):
    df = spark.createDataFrame(
        [("1.234,56", "R$ 1.000,50", "12,5%", "1.5E3", "abc"), ("-100,5", "R$ 2,25", "3%", "2E-2", "1"),
         ("7,25", None, "50%", "7.0", "x")], "a string, b string, c string, d string, e string")
    out = clean.convert_numeric_columns(df)
    rows = out.collect()
    assert [r["a"] for r in rows] == [1234.56, -100.5, 7.25]
    assert [r["b"] for r in rows] == [1000.5, 2.25, None]
    assert [r["c"] for r in rows] == pytest.approx([0.125, 0.03, 0.5])
    assert [r["d"] for r in rows] == [1500.0, 0.02, 7.0]
    assert [r["e"] for r in rows] == ["abc", "1", "x"]
    negative = spark.createDataFrame([("-1.234,5",), ("2,5",)], "a string")
    assert [r[0] for r in clean.convert_numeric_strings(negative).collect()] == [-1234.5, 2.5]


def test_mode_prefers_smaller_number_on_ties(spark):
    df = spark.createDataFrame([(10.0,), (9.0,), (None,)], "x double")
    row = profile.mode_profile(df, ["x"]).first()
    assert float(row["mode"]) == 9.0 and row["mode_share"] == pytest.approx(1 / 3)


def test_samples_and_splits(spark):
    df, _ = scored(spark, 1000)
    a, b = sampling.split(df, "id", 0.2, stratify="target")
    assert a.count() + b.count() == 1000 and a.join(b, "id").count() == 0
    for y in (0, 1):
        n = df.filter(F.col("target") == y).count()
        assert b.filter(F.col("target") == y).count() == round(0.2 * n)
    assert sampling.sample_rows(df, "id", 137).count() == 137
    assert sampling.sample_rows(df, "id", 5000).count() == 1000
    assert sampling.sample_rows(df, "id", 0).count() == 0
    one = {r["id"] for r in sampling.sample_rows(df.repartition(1), "id", 50).collect()}
    many = {r["id"] for r in sampling.sample_rows(df.repartition(64), "id", 50).collect()}
    assert one == many
    assert sampling.sample_size(10**9) == 385
    folds = df.select(sampling.fold_of("id", 5).alias("f")).groupBy("f").count().collect()
    assert sorted(r["f"] for r in folds) == [0, 1, 2, 3, 4]


def test_quota_skips_strata_without_quota(spark):
    df = spark.createDataFrame([(f"{i}", "a" if i < 60 else "b") for i in range(100)],
                               "id string, s string")
    quotas = spark.createDataFrame([("a", 7)], "s string, quota long")
    got = sampling.sample_by_quota(df, "id", ["s"], quotas).collect()
    assert len(got) == 7 and {r["s"] for r in got} == {"a"}


def test_feature_sets(spark):
    a = spark.createDataFrame([("renda",), ("idade",)], "feature string")
    b = spark.createDataFrame([("renda",), ("limite",)], "feature string")
    got = {r["feature"]: r["where"] for r in sets.compare_features(a, b).collect()}
    assert got == {"renda": "both", "idade": "only_a", "limite": "only_b"}


def test_bin_starts_agree_with_division():
    rng = np.random.default_rng(2)
    lo = np.concatenate([[0.0, 1.0, -5.0, 2.0, -1e-9, 0.0], rng.normal(size=200) * 10.0 ** rng.integers(-6, 7, 200)])
    hi = lo + np.concatenate([[0.1, 48.0, 10.0, 0.0, 1.0, 0.07], rng.random(200) * 10.0 ** rng.integers(-3, 7, 200)])
    starts = stability.bin_starts(lo, hi, 10)
    assert np.isinf(starts[3]).all()
    for a, b, row in zip(lo, hi, starts):
        width = (b - a) / 10.0
        for k, v in enumerate(row, 1):
            if np.isfinite(v):
                assert np.floor((v - a) / width) >= k > np.floor((np.nextafter(v, -np.inf) - a) / width)


@pytest.mark.parametrize("sketch", [2000, 3])
def test_bracketed_quantiles_are_exact(spark, sketch, monkeypatch):
    """Also with a sketch so coarse that ranks leave their brackets."""
    monkeypatch.setattr(profile, "SKETCH", sketch)
    monkeypatch.setattr(profile, "MARGIN", 4 / 2000)
    rng = np.random.default_rng(5)
    n = 6000
    wide, ties = rng.normal(size=n) * 1e6, rng.integers(0, 4, n) * 0.1
    holes = np.where(rng.random(n) < 0.4, np.nan, rng.exponential(size=n))
    rows = [(float(wide[i]), float(ties[i]), float(holes[i]), None, 7) for i in range(n)]
    df = spark.createDataFrame(rows, "wide double, ties double, holes double, none double, same int").repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.5004, 0.9, 1.0]
    got = {(r["feature"], r["prob"]): r["value"] for r in profile.column_quantiles(
        df, df.columns, probs).collect()}
    assert len(got) == 4 * len(probs)
    for name, x in (("wide", wide), ("ties", ties), ("holes", holes[~np.isnan(holes)]), ("same", np.full(n, 7.0))):
        for p in probs:
            assert got[name, p] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)
    assert profile.column_quantiles(df.limit(0), ["wide"], [0.5]).count() == 0
    few = profile.column_quantiles(df.filter("same = 7").limit(3), ["wide"], [0.1, 0.9])
    assert few.count() == 2


def test_psi_of_equal_samples_is_zero(spark):
    df, _ = scored(spark)
    assert stability.psi_two_sample(df, df, ["score"]).first()["psi"] == pytest.approx(0.0)
    short = df.withColumn("date", F.to_date(F.lit("2020-01-05")))
    assert stability.psi_monthly(short, "date", ["score"]).count() == 0
    with pytest.raises(ValueError):
        stability.split_baseline(short, "date")


def test_association(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    rows = [(float(v), float(2 * v), float(w), int(v + w > 0))
            for v, w in zip(x, rng.normal(size=300))]
    df = spark.createDataFrame(rows, "a double, b double, c double, target int")
    vifs = {r["feature"]: r["vif"] for r in association.vif(df, ["a", "b", "c"]).collect()}
    assert math.isinf(vifs["a"]) and math.isinf(vifs["b"]) and vifs["c"] < 1.1
    assert association.select_non_collinear(df, ["a", "b", "c"], "target") != []
    chosen = association.select_non_collinear(df, ["a", "b", "c"], "target", 5.0)
    assert "c" in chosen
    total = association.class_stats(df, ["a"], "target", "total").first()["r_pb"]
    assert total == pytest.approx(df.select(F.corr("a", "target")).first()[0])
    removed = association.correlation_filter(df, ["a", "b", "c"]).filter("status = 'removed'")
    assert [r["feature"] for r in removed.collect()] == ["b"]


def test_neighbours_match_brute_force(spark):
    rng = random.Random(5)
    points = [(i, rng.gauss(0, 1), rng.gauss(0, 100), float(rng.randint(0, 3)))
              for i in range(1200)]
    df = spark.createDataFrame(points, "key long, a double, b double, c double")
    got = {}
    for r in neighbours.nearest(df, "key", ["a", "b", "c"], 4).collect():
        got.setdefault(r["key"], []).append((r["rank"], r["neighbour"]))
    for key, *x in points[::100]:
        order = sorted((math.dist(x, y), k) for k, *y in points if k != key)
        assert [n for _, n in sorted(got[key])] == [k for _, k in order[:4]]
    assert len(got) == 1200


def test_smote_takes_the_first_row_among_equal_distances(spark):
    # Every inner point has a mate on both sides, equally far: the one with the smaller id is the neighbour.
    df = spark.createDataFrame([(i, float(10 * i), "x", 1) for i in range(1, 41)] + [(99, 5.0, "x", 0)],
                               "id long, a double, c string, target int")
    made = balance.smote(df, "target", "id", ["a"], ["c"], k=1).filter("synthetic").collect()
    assert len(made) == 40
    for r in made:
        i = int(r["id"].split("#")[0])
        assert (10 <= r["a"] <= 20) if i == 1 else (10 * i - 10 <= r["a"] <= 10 * i)


def test_smote_lies_between_parents_and_keeps_rows(spark):
    rng = random.Random(2)
    # A third of the minority rows are copies of one point.
    rows = [(str(i), 1, 1.0 if i % 3 == 0 else rng.random(), 2.0 if i % 3 == 0 else rng.random(),
             rng.choice("xyz")) for i in range(90)]
    rows += [(str(i), 0, rng.random(), rng.random(), "w") for i in range(90, 300)]
    rows.append(("300", 1, None, 1.0, "x"))
    df = spark.createDataFrame(rows, "id string, target int, a double, b double, c string")
    out = balance.smote(df, "target", "id", ["a", "b"], ["c"], k=5, multiplier=2)
    assert out.count() == 300 + 180
    made = out.filter("synthetic").collect()
    assert len({r["id"] for r in made}) == 180
    minority = [(r[2], r[3]) for r in rows[:90]]
    for r in made[::9]:
        base = minority[int(r["id"].split("#")[0])]
        between = any(min(base[0], q[0]) - 1e-9 <= r["a"] <= max(base[0], q[0]) + 1e-9
                      and min(base[1], q[1]) - 1e-9 <= r["b"] <= max(base[1], q[1]) + 1e-9
                      for q in minority)
        assert between and r["c"] in "xyz"
    none = df.filter("target = 0")
    assert balance.smote(none, "target", "id", ["a", "b"], ["c"]).count() == 210


def test_mice_fills_and_keeps_observed(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        x = rng.random()
        rows.append((str(i), x, None if i % 5 == 0 else 3 * x + 1,
                     None if i % 7 == 0 else ("hi" if x > 0.5 else "lo"), None))
    df = spark.createDataFrame(rows, "id string, x double, y double, c string, gone double")
    out = {r["id"]: r for r in mice.mice_impute(df, "id", max_iter=3).collect()}
    assert len(out) == 200 and "gone" not in out["0"].asDict()
    for r in rows:
        got = out[r[0]]
        assert got["y"] == pytest.approx(3 * r[1] + 1, abs=0.2)
        assert got["c"] in ("hi", "lo")
        if r[2] is not None:
            assert got["y"] == r[2]
        if r[3] is not None:
            assert got["c"] == r[3]


def _chained(x, mask, hot, rounds):
    """Column after column by least squares, each on its known rows, as the operator must do."""
    x = x.copy()
    for j in range(x.shape[1]):
        x[mask[:, j], j] = np.median(x[~mask[:, j], j])
    for _ in range(rounds):
        for j in range(x.shape[1]):
            if not mask[:, j].any():
                continue
            z = np.column_stack([np.ones(len(x)), np.delete(x, j, axis=1), hot])
            known = ~mask[:, j]
            w = np.linalg.lstsq(z[known], x[known, j], rcond=None)[0]
            x[mask[:, j], j] = z[mask[:, j]] @ w
    return x


@pytest.mark.parametrize("width", [4, 9])
def test_mice_equals_columns_one_after_the_other(spark, width):
    """Runs of one pass (and two runs, for nine columns) give what sequential regressions give."""
    rng = np.random.default_rng(width)
    base = rng.normal(size=(400, 3))
    x = base @ rng.normal(size=(3, width)) * 50 + rng.normal(size=(400, width)) + 1e4
    kind = rng.integers(0, 3, 400)
    x += 20 * kind[:, None]
    mask = rng.random((400, width)) < 0.15
    mask[:, 1] = False
    rows = [(str(i), "abc"[kind[i]], *[None if mask[i, j] else float(x[i, j]) for j in range(width)])
            for i in range(400)]
    names = [f"v{j}" for j in range(width)]
    df = spark.createDataFrame(rows, "id string, k string, " + ", ".join(f"{n} double" for n in names))
    for rounds in (1, 3):
        got = {r["id"]: r for r in mice.mice_impute(df, "id", max_iter=rounds, tol=0.0).collect()}
        want = _chained(x, mask, np.eye(3)[kind], rounds)
        have = np.array([[got[str(i)][n] for n in names] for i in range(400)])
        assert np.allclose(have, want, rtol=1e-6, atol=1e-5)


def _dummy_vif(rows, cols):
    """Dense rebuild: every 0/1 column, correlations per pair of columns over rows where both are known."""
    names, data = [], []
    for i, c in enumerate(cols):
        seen = [r[i] for r in rows if r[i] is not None]
        levels = sorted(set(seen), key=lambda x: (-seen.count(x), x))
        for level in levels[:-1]:
            names.append(f"{c}={level}")
            data.append([math.nan if r[i] is None else float(r[i] == level) for r in rows])
    x = np.array(data)
    m = np.eye(len(x))
    for i in range(len(x)):
        for j in range(i):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            m[i, j] = m[j, i] = np.corrcoef(x[i][both], x[j][both])[0, 1]
    return dict(zip(names, association.vif_from(m)))


@pytest.mark.parametrize("holes", [0.0, 0.1])
def test_categorical_vif_equals_dense_matrix(spark, holes):
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        a = min(int(rng.expovariate(0.15)), 30)
        row = [f"a{a}", f"b{(a + rng.randrange(4)) % 5}", f"c{rng.randrange(3)}", "only"]
        rows.append(tuple(None if rng.random() < holes else v for v in row))
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = {r["feature"]: r["vif"] for r in association.vif_categorical(df, names).collect()}
    want = _dummy_vif(rows, names)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6)


def test_categorical_vif_edges(spark, monkeypatch):
    shape = "a string, b string"
    assert association.vif_categorical(spark.createDataFrame([], shape), ["a", "b"]).count() == 0
    rows = [(x, x.upper()) for x in "aabbbbcccccc"]
    df = spark.createDataFrame(rows, shape)
    same = association.vif_categorical(df, ["a", "b"]).collect()
    assert len(same) == 4 and all(math.isinf(r["vif"]) for r in same)
    alone = {r["feature"]: r["vif"] for r in association.vif_categorical(df, ["a"]).collect()}
    assert alone == pytest.approx(_dummy_vif(rows, ["a"]))
    monkeypatch.setattr(association, "DENSE_LEVELS", 2)
    with pytest.raises(ValueError):
        association.vif_categorical(df, ["a", "b"])


def test_mice_sweep_leaves_out_explained_inputs():
    z = np.random.default_rng(1).normal(size=(50, 3))
    z = np.column_stack([z, z[:, 0] + z[:, 1], z @ [1.0, 2.0, 3.0]])
    w = mice.sweep(z.T @ z, [0, 1, 2, 3])[:4, 4]
    assert np.allclose(w, [1, 2, 3, 0])


def test_swarm_in_parallel_gives_the_serial_result(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        x, y = rng.randrange(2), rng.randrange(2)
        rows.append((str(i), x, y, rng.randrange(2), int(rng.random() < 0.2 + 0.6 * x)))
    df = spark.createDataFrame(rows, "id string, x int, y int, z int, target int")
    runs = [wrapper_select(df, "id", ["x", "y", "z"], "target", particles=5, iters=2, family="tree",
                           params={"maxDepth": 1}, parallelism=p) for p in (1, 4)]
    assert runs[0][0] == runs[1][0] == ["x"]
    assert runs[0][1].collect() == runs[1][1].collect()


def test_models_store_and_log(spark, tmp_path):
    df, _ = scored(spark, 300, ties=False)
    df = df.withColumn("x2", F.col("score") ** 2)
    model = models.make_model("logistic", {"maxIter": 5}, ["score", "x2"], "target").fit(df)
    path = models.save_model(model, {"maxIter": 5}, "m", str(tmp_path))
    before = {r["id"]: r["score"] for r in models.predict(model, df, ["id"]).collect()}
    after = {r["id"]: r["score"] for r in models.score(path, df, ["id"]).collect()}
    assert before == after
    with pytest.raises(ValueError):
        models.make_model("unknown", {}, ["score"], "target")
    log = str(tmp_path / "runs")
    runlog.log_run(spark, log, "a", "m", {"p": 1}, {"ks": 0.2}, path)
    runlog.log_run(spark, log, "b", "n", {}, {"ks": 0.4})
    assert runlog.best_run(runlog.read_runs(spark, log), "ks").first()["model"] == "n"


def test_search_is_seeded_and_failures_are_reported(spark):
    assert tuning.draw(tuning.CREDIT["boosted"], random.Random(1)) == tuning.draw(
        tuning.CREDIT["boosted"], random.Random(1))
    points = [tuning.draw(space, random.Random(i)) for i in range(20)
              for space in tuning.CREDIT.values()]
    assert all(p for p in points)
    df, _ = scored(spark, 300, ties=False)
    done = tuning.compare_models(df, "id", ["score"], "target",
                                 {"tree": {"maxDepth": 2}, "mlp": {"hidden": [0]}}, "auc", 0)
    assert done.best == "tree"
    assert done.board.filter("error is not null").select("model").first()[0] == "mlp"


def test_every_credit_space_fits(spark):
    df, _ = scored(spark, 200, ties=False)
    df = df.withColumn("x2", F.col("score") * 2 + F.rand(1))
    for name in ("naive_bayes", "mlp", "ovr"):
        params = tuning.draw(tuning.CREDIT[name], random.Random(7))
        params.update({k: 5 for k in ("maxIter",) if k in params})
        models.make_model(name, params, ["score", "x2"], "target").fit(df)


def test_wrapper_history_never_worsens(spark):
    df, _ = scored(spark, 300, ties=False)
    df = df.withColumn("noise", F.rand(3))
    names, history = wrapper_select(df, "id", ["score", "noise"], "target", 3, 3,
                                    family="tree", params={"maxDepth": 2})
    values = [r["fitness"] for r in history.orderBy("iteration").collect()]
    assert values == sorted(values, reverse=True) and set(names) <= {"score", "noise"}


def test_shapley_adds_up(spark):
    from scoreflow.operators import explain

    df, _ = scored(spark, 200, ties=False)
    df = df.withColumn("x2", F.col("score") * F.rand(5))
    model = models.make_model("tree", {"maxDepth": 3}, ["score", "x2"], "target").fit(df)
    parts = explain.sampled_shapley(model, df, "id", ["score", "x2"], n_rows=20, n_perm=6)
    total = {r["id"]: r["t"] for r in parts.groupBy("id").agg(F.sum("contribution").alias("t"))
             .collect()}
    scores = {r["id"]: r["score"] for r in models.predict(model, df, ["id"]).collect()}
    ground = statistics.mean(scores[r["id"]] for r in sampling.sample_rows(df, "id", 6, 43)
                             .collect())
    assert len(total) == 20
    for key, value in total.items():
        assert value == pytest.approx(scores[key] - ground, abs=1e-9)


def test_scaling_is_learned_on_development_only(spark):
    dev = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    oot = spark.createDataFrame([(10.0,)], "x double")
    fitted = encode.scaling(["x"]).fit(dev)
    scaled, raw = encode.scaled_and_raw(fitted, oot, [])
    assert scaled.first()[0][0] == pytest.approx(10 / math.sqrt(2)) and raw.first()[0][0] == 10
    assert encode.families_for(True) == encode.RAW_FAMILIES
    assert {encode.input_for(f) for f in encode.SCALED_FAMILIES} == {"scaled"}


def test_curve_thinning_keeps_one_point_per_slot(spark):
    df, _ = scored(spark, 400, ties=False)
    thin = curves.thin(curves.roc_points(df, "score", "target"), "fpr", 20)
    assert thin.count() <= 21


def test_checkpoint_folder_comes_from_the_session(spark):
    assert core.shared_folder(spark)
    assert core.checkpointed(spark.range(5)).count() == 5


def test_csv_and_rows(spark, tmp_path):
    df = tables.from_rows(spark, [(1, "a"), (2, "b")], "k int, t string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), "k int, t string")
                      .collect())) == [(1, "a"), (2, "b")]


def test_all_pairs_of_partitions_give_one_rank(spark):
    df, _ = scored(spark, 100)
    ranks = [sorted((r["id"], r["rank"]) for r in prefix.global_rank(
        df.repartition(p), "id", 3).collect()) for p in (1, 30)]
    assert ranks[0] == ranks[1]
    assert sorted(r for _, r in ranks[0]) == list(itertools.chain(range(1, 101)))


@pytest.mark.parametrize("x, dof, want", [
    (3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (11.070498, 5, 0.05), (18.307038, 10, 0.05),
    (2.705543, 1, 0.1), (6.251389, 3, 0.1), (24.724970, 11, 0.01), (0.0, 3, 1.0), (None, 3, None), (1.0, 0, None)])
def test_chi_tail_is_the_table(x, dof, want):
    got = association._chi_tail(x, dof)
    assert got is None if want is None else abs(got - want) < 1e-6


def test_chi_square_tests_each_column_alone(spark):
    rows = [("a", "x", 1), ("a", None, 0), ("b", "y", 0), ("b", "x", 0), (None, "y", 1), ("a", "x", 1)]
    df = spark.createDataFrame(rows, "p string, q string, target int")
    both = {r["feature"]: r for r in association.chi_square(df, ["p", "q"], "target").collect()}
    for c in ("p", "q"):
        assert association.chi_square(df, [c], "target").first() == both[c]


def test_correlation_is_pairwise(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) + 1e6
    x[:, 3] = x[:, 0] * 2
    x[rng.random((200, 4)) < 0.4] = np.nan
    x[:100, 1], x[100:, 2] = np.nan, np.nan  # never together
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double")
    got = association.correlation_array(df, ["a", "b", "c", "d"])
    for i in range(4):
        for j in range(4):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = np.corrcoef(x[ok, i], x[ok, j])[0, 1] if ok.sum() > 1 else np.nan
            assert np.isclose(got[i, j], want, atol=1e-9, equal_nan=True)
    assert association.correlation_filter(df, ["a", "b", "c", "d"]).count() == 4


def test_variance_inflation_by_one_decomposition():
    import time

    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6))
    r = np.corrcoef(x.T)
    assert np.allclose(association.vif_from(r), np.diag(np.linalg.inv(r)))
    y = np.column_stack([x, x[:, 0] + x[:, 1], np.zeros(500)])
    with np.errstate(invalid="ignore", divide="ignore"):
        values = association.vif_from(np.corrcoef(y.T))
    assert np.isinf([values[i] for i in (0, 1, 6, 7)]).all() and np.isfinite([values[i] for i in (2, 3, 4, 5)]).all()
    big = np.corrcoef(rng.normal(size=(400, 900)))
    start = time.perf_counter()
    association.vif_from(big)
    assert time.perf_counter() - start < 2


def test_non_collinear_by_downdating():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    x = np.column_stack([x, x[:, 0] + 0.1 * rng.normal(size=300), x[:, 1] - x[:, 2]])
    r = np.corrcoef(x.T)
    inverse, left = association._Inverse(r), list(range(7))
    for gone in (6, 3, 0):
        left.remove(gone)
        inverse.drop(gone)
        assert np.allclose(inverse.factors(left), association.vif_from(r[np.ix_(left, left)]))


def test_tiles_keep_missing_scores(spark):
    rows = [(i, None if i % 5 == 0 else float("nan") if i % 5 == 1 else float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, s double")
    got = prefix.ntile(df, "s", "id", 10).groupBy("band").count().collect()
    assert sorted((r["band"], r["count"]) for r in got) == [(b, 5) for b in range(1, 11)]
    low = prefix.ntile(df, "s", "id", 10).where("s is null or isnan(s)").agg(F.max("band")).first()[0]
    assert low == 4


def test_quota_marks_null_strata(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(60)], "id long, g string")
    quotas = spark.createDataFrame([(None, 7), ("a", 100)], "g string, quota long")
    got = sampling.sample_by_quota(df, "id", ["g"], quotas)
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {None: 7, "a": 20}


def test_missing_route(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (3.0, float("nan"))], "a double, b double")
    frame_, cols, families = encode.missing_route(df, ["a", "b"])
    assert cols == ["a", "b", "a_missing", "b_missing"] and set(families) == set(encode.RAW_FAMILIES)
    assert [tuple(r) for r in frame_.select(*cols).collect()][1] == (2.0, 3.0, 1.0, 0.0)
    assert encode.missing_route(df.limit(1), ["a", "b"])[1:] == (["a", "b"], encode.families_for(False))


def test_hashed_neighbours_find_near_points(spark):
    """Recall and share of pairs compared, on the given vectors and a near copy of each."""
    from scoreflow.operators import neighbours

    x = np.array(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()["embedding"].tolist())
    x = np.concatenate([x, x + np.random.default_rng(1).normal(size=x.shape) * 0.3 / 8])  # a near copy of each
    cols = [f"v{i}" for i in range(64)]
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["key", *cols])
    gap = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(gap, np.inf)
    near = {(i, j) for i, j in zip(*np.nonzero(gap < 0.4))}
    got = neighbours.nearest_by_hashing(points, "key", cols, 10)
    found = {(r["key"], r["neighbour"]) for r in got.collect()}
    top = {(i, j) for i in range(len(x)) for j in np.argsort(gap[i], kind="stable")[:10]}
    wanted = near & top
    assert len(wanted & found) >= 0.9 * len(wanted) > 0
    base = points.withColumn("x", F.array(*cols))
    tables = neighbours.hashed_tables(base, cols, 8, 6, None, 42)
    sizes = tables.groupBy("table", "bucket").count().agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0]
    assert sizes < 0.5 * len(x) * (len(x) - 1)


def test_hashed_neighbours_query_recall(spark):
    """Recall of the five nearest of every vector of the table itself."""
    from scoreflow.catalog import QUERIES

    x = np.array(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").toPandas()["embedding"].tolist())
    gap = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(gap, np.inf)
    want = {(i, j) for i in range(len(x)) for j in np.argsort(gap[i], kind="stable")[:5].tolist()}
    got = {(r["key"], r["neighbour"]) for r in QUERIES["j7_nearest_by_hashing"](spark, "/root/testdata/sf0.01").collect()}
    print("recall at 5:", len(got & want) / len(want))
    assert len(got) == 5 * len(x) and len(got & want) >= 0.9 * len(want)


def test_hashed_neighbours_of_equal_points(spark):
    from scoreflow.operators import neighbours

    points = spark.createDataFrame([(i, 1.0, 2.0) for i in range(10)] + [(10, 1.0, 2.5)], "key long, a double, b double")
    got = {}
    for r in neighbours.nearest_by_hashing(points, "key", ["a", "b"], 2, bucket_length=50.0).collect():
        got.setdefault(r["key"], []).append((r["rank"], r["neighbour"], r["distance"]))
    assert sorted(got[0]) == [(1, 1, 0.0), (2, 2, 0.0)] and sorted(got[7]) == [(1, 0, 0.0), (2, 1, 0.0)]
    assert sorted(got[10]) == [(1, 0, 0.5), (2, 1, 0.5)] and len(got) == 11


def test_counted_folds_are_shared_by_all_fits(spark, monkeypatch):
    """Training and test rows of each fold are those of the fold mark; a search counts once and learns scales once a fold."""
    from scoreflow.operators.sampling import fold_of
    from scoreflow.plans import models, tuning

    df = spark.range(400).select("id", (F.col("id") % 7 > 2).cast("int").alias("y"), (F.col("id") % 5).cast("double").alias("x"),
                                 (F.col("id") % 11 / 4).alias("z"))
    marked = df.withColumn("_fold", fold_of("id", 3, 42))
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    for k, (train, test) in enumerate(tuning.counted_folds(df, "id", ["y", "x", "z"], 3, 42)):
        for got, part in ((train, marked.where(F.col("_fold") != k)), (test, marked.where(F.col("_fold") == k))):
            assert rows(got) == rows(part.groupBy("y", "x", "z").agg(F.count(F.lit(1)).cast("double").alias("n")))
    calls, learned, stored, scales = [], [], tuning.stored, models._deviations
    monkeypatch.setattr(tuning, "stored", lambda d: calls.append(1) or stored(d))
    monkeypatch.setattr(models, "_deviations", lambda *a: learned.append(1) or scales(*a))
    best, trials = tuning.search("logistic", df, None, "id", ["x", "z"], "y", "ks", n_trials=3)
    assert len(calls) == 1 and len(learned) == 3 and trials.where("value is null").count() == 0
    one = tuning.cross_validate("logistic", best, df, "id", ["x", "z"], "y", 3)
    assert abs(one["ks"] - trials.agg(F.max("value")).first()[0]) < 1e-9


def test_mice_reads_equal_rows_once(spark, monkeypatch):
    """the rounds hold distinct rows with their number, and give each row what they give all rows."""
    rng = random.Random(6)
    rows = []
    for i in range(2400):
        x = rng.randrange(6)
        y = None if rng.random() < 0.15 else 2.0 * x + rng.randrange(3)
        z = (None if i % 2 else float("nan")) if rng.random() < 0.1 else float(x - rng.randrange(2))
        rows.append((str(i), x, y, z, None if rng.random() < 0.2 else rng.choice("abc" + 9 * "abc"[x // 2]), float(i % 2), i))
    df = spark.createDataFrame(rows, "id string, x int, y double, z double, k string, t double, other int")
    sizes, stored = [], mice.stored
    monkeypatch.setattr(mice, "stored", lambda d: sizes.append((made := stored(d)).count()) or made)
    for options in ({"target": "t", "use_target": True},):
        got = []
        for shared in (4, math.inf):
            monkeypatch.setattr(mice, "SHARED", shared)
            sizes.clear()
            out = mice.mice_impute(df, "id", ["x", "y", "z", "k"], max_iter=2, tol=0.0, **options)
            got.append({r["id"]: r for r in out.collect()})
            assert max(sizes[1:]) <= (600 if shared == 4 else 2400) and out.columns == df.columns
        one, all_rows = got
        assert len(one) == len(all_rows) == 2400
        for r in rows:
            a, b = one[r[0]], all_rows[r[0]]
            assert a["k"] == b["k"] and a["other"] == r[6] and [a["y"], a["z"]] == pytest.approx([b["y"], b["z"]], rel=1e-6)
            assert a["k"] is not None and (r[2] is None or a["y"] == r[2]) and (r[4] is None or a["k"] == r[4])
