"""Shared counts of the selection against the filters on rows; quotas against sorted rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scoreflow.operators import association, clean, sampling, stability
from scoreflow.operators.prefix import running_sums
from scoreflow.plans import models, tuning
from scoreflow.plans.select import model_filter, select_features
from scoreflow.plans.shared import SharedCounts


def rows_of(df):
    return sorted((r["feature"], r["test"], r["status"], None if r["value"] is None else round(r["value"], 9))
                  for r in df.collect())


@pytest.fixture(scope="module")
def frame(spark):
    rnd, rows = random.Random(5), []
    for i in range(1500):
        y = rnd.random() < 0.3
        x = rnd.gauss(1.0 if y else 0.0, 1.0)
        rows.append((f"{2020 + i % 8 // 4}-{1 + i % 8 % 4:02d}-15" if i % 50 else None,
                     None if i % 97 == 0 else int(y), round(x, 1) if i % 7 else None,
                     float("nan") if i % 5 == 0 else rnd.randrange(6) + (i % 8) * 0.5, 2.0 * x + 0.01 * rnd.random(),
                     1.0 if i % 40 else -0.0, None, rnd.random()))
    return spark.createDataFrame(
        rows, "day string, target int, month double, b double, c double, d double, e double, f double").withColumn(
        "day", F.to_date("day"))


COLS = ["month", "b", "c", "d", "e", "f"]


def test_shared_counts_give_what_the_filters_on_rows_give(frame):
    shared, left = SharedCounts(frame, "day", COLS, "target"), ["month", "b", "c", "f"]
    assert rows_of(shared.missing_filter(COLS, 0.5)) == rows_of(clean.missing_filter(frame, COLS, 0.5))
    assert rows_of(shared.mode_filter(COLS, 0.9)) == rows_of(clean.mode_filter(frame, COLS, 0.9))
    assert shared.majority() == pytest.approx(association.ratio_of_majority(frame, "target"))
    for imbalanced in (False, True):
        assert rows_of(shared.univariate_filter(left, imbalanced)) == rows_of(
            association.univariate_filter(frame, left, "target", imbalanced))
    assert rows_of(association.correlation_filter(frame, left, 0.9, shared.centre(left))) == rows_of(
        association.correlation_filter(frame, left))
    two = {r["feature"]: r["psi"] for r in shared.psi(left).collect()}
    want = stability.psi_of_parts(frame, stability.in_baseline(frame, "day"), left)
    assert two == pytest.approx({r["feature"]: r["psi"] for r in want.collect()})
    monthly = {r["feature"]: r["psi"] for r in shared.psi_mean_by_month(left).collect()}
    # The form on rows takes no column of the name month.
    want = stability.psi_mean_by_month(frame.withColumnRenamed("month", "a"), "day", ["a", *left[1:]])
    assert monthly == pytest.approx({{"a": "month"}.get(r["feature"], r["feature"]): r["psi"] for r in want.collect()})


def test_selection_edges(spark, frame):
    with pytest.raises(ValueError):
        select_features(frame.limit(0), "day", cols=COLS)
    chosen, report = select_features(frame, "day", "target", COLS, missing=0.5, use_model=False, psi=10.0)
    assert {"e", "d", "c"}.isdisjoint(chosen) and "month" in chosen
    assert select_features(frame, "day", cols=[])[0] == []
    one, report = select_features(frame.select("day", "f"), "day", psi=10.0)
    assert one == ["f"] and {r["test"] for r in report.collect()} == {"missing", "mode", "psi"}


def brute(rows, quotas, seed=42):
    taken = set()
    for stratum, quota in quotas.items():
        mine = sorted((hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i) for i, s in rows if s == stratum)
        if quota is None or quota >= len(mine):
            taken |= {i for _, i in mine}
        elif quota > 0:
            taken |= {i for h, i in mine if (h, i) <= mine[quota - 1]}
    return taken


@pytest.mark.parametrize("size", [40, 6000])
def test_quota_takes_the_first_rows_in_hash_order(spark, size):
    rows = [(i, "abcde"[i % 5] if i % 11 else None) for i in range(size)]
    quotas = {"a": size // 9, "b": 0, "c": 10 * size, None: 3, "e": 1}
    df = spark.createDataFrame(rows, "id int, quota string")  # a clashing name
    table = spark.createDataFrame([(k, v) for k, v in quotas.items()], "k string, n int")
    marked = sampling.mark_by_quota(df.withColumn("s", F.col("quota")), "id", ["s"],
                                    table.select(F.col("k").alias("s"), F.col("n").alias("quota")), "hit")
    assert marked.columns == ["id", "quota", "s", "hit"] and marked.count() == size
    assert {r["id"] for r in marked.filter("hit").collect()} == brute(rows, quotas)


def test_quota_with_an_id_that_holds_most_rows(spark):
    """The cut lies far outside its bracket; all rows of the id at the cut share its key."""
    rows = [(7, "a")] * 3000 + [(i, "a") for i in range(100, 600)]
    keys = sorted((hashlib.md5(f"{i}|42".encode()).hexdigest(), i) for i, _ in rows)
    for quota in (100, 2000, 3400):
        df = spark.createDataFrame(rows, "id int, s string")
        got = sampling.sample_by_quota(df, "id", ["s"], spark.createDataFrame([("a", quota)], "s string, quota int"))
        assert sorted(r["id"] for r in got.collect()) == sorted(i for h, i in keys if (h, i) <= keys[quota - 1])


def test_sample_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id int, day date, y int")
    assert sampling.sample_rows(empty, "id", 5).count() == 0
    assert sampling.stratified_sample(empty, "id", "day", "y", 5).count() == 0


@pytest.mark.parametrize("cells", [1, 2, 5, 32, 97])
def test_running_sums_find_the_cell_without_a_lambda(spark, cells):
    """every distinct value looks its cell up, so the search over the splits has to be compiled."""
    rows = [(f, float(v % 53), 1 + v % 3) for f in "ab" for v in range(0, 60, 1 if f == "a" else 7)]
    df = spark.createDataFrame(rows, "f string, v double, n long").groupBy("f", "v").agg(F.sum("n").alias("n"))
    found = running_sums(df, "v", ["n"], ["f"], cells=cells)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        assert r["cum_n"] == sum(n for f, v, n in rows if f == r["f"] and v <= r["v"])
        assert r["tot_n"] == sum(n for f, v, n in rows if f == r["f"])


@pytest.mark.parametrize("name, params, weight", [
    ("logistic", {"regParam": 0.3, "elasticNetParam": 0.4}, None), ("logistic", {"regParam": 0.3}, "w"),
    ("tree", {"minInstancesPerNode": 60}, None), ("tree", {"minInstancesPerNode": 400}, None), ("tree", {}, "w"),
    ("boosted", {"maxIter": 3, "minInstancesPerNode": 50}, None)])
def test_fit_on_counted_rows_is_the_fit_on_rows(spark, name, params, weight):
    rnd = random.Random(3)
    rows = [(i, float(i % 7), float(i % 5), int(rnd.random() < 0.2 + 0.08 * (i % 7))) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").withColumn("w", F.when(F.col("y") == 1, 1.7).otherwise(0.6))
    keys = ["y", "a", "b"] + ([weight] if weight else [])
    one, found = tuning.fit_measure(name, params, df, {"t": df}, ["a", "b"], "y", weight=weight)
    two, again = tuning.fit_measure(name, params, models.counted(df, keys), {"t": models.counted(df, keys)}, ["a", "b"], "y",
                                    weight=weight)
    assert found["t"] == pytest.approx(again["t"])
    scores = [{r["id"]: r["score"] for r in models.predict(m, df, ["id"]).collect()} for m in (one, two)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)


@pytest.mark.parametrize("apart", [True, False])
def test_a_search_fits_equal_rows_once(spark, monkeypatch, apart):
    """the fits of a search don't grow with the copies of a row."""
    df = spark.range(600).select("id", (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 3 > 0).cast("int").alias("y"))
    seen, fit = [], tuning.fit_measure
    monkeypatch.setattr(tuning, "fit_measure", lambda n, p, train, *a: seen.append(train.count()) or fit(n, p, train, *a))
    tuning.search("tree", df, df if apart else None, "id", ["x"], "y", "accuracy", 2)
    assert len(seen) == (2 if apart else 6) and max(seen) <= 4


@pytest.mark.parametrize("params", [{}, {"factorSize": 3, "regParam": 0.05, "stepSize": 0.1, "maxIter": 15},
                                    {"fitIntercept": False, "fitLinear": False, "maxIter": 4}, {"tol": 0.3, "stepSize": 0.3}])
def test_factorisation_machines_from_counted_rows_are_those_of_mllib(spark, tmp_path, params):
    """Equal rows once, the same steps as on the rows themselves."""
    rnd = random.Random(5)
    rows = [(i, float(i % 7), float(i % 5), int(rnd.random() < 0.1 + 0.1 * (i % 7))) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    assert models.fits_counts("fm", params) and not models.fits_counts("fm", {"solver": "gd"})
    counts = models.counted(df, ["y", "a", "b"])
    assert counts.count() <= 70
    one = models.make_model("fm", params, ["a", "b"], "y").fit(df)
    two = models.fit_counted("fm", params, ["a", "b"], "y", counts)
    path = models.save_model(two, params, "fm", str(tmp_path))
    for m in (two, models.load_model(path)):
        scores = [{r["id"]: (r["prediction"], r["score"]) for r in models.predict(x, df, ["id"]).collect()} for x in (one, m)]
        assert all(scores[0][i] == pytest.approx(scores[1][i], abs=1e-9) for i in scores[0])


def test_factorisation_machines_refuse_other_classes(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 2)], "a double, y int")
    with pytest.raises(Exception, match="classes 0 and 1"):
        models.fit("fm", {}, ["a"], "y", df)


def test_trees_read_cells_of_bins_and_lots_keep_every_row(spark, monkeypatch):
    """what a tree reads is bounded by its bins, not by the rows."""
    rnd = random.Random(7)
    rows = [(x, float(i % 9), int(x + rnd.random() > 1.1 + 0.05 * (i % 9))) for i in range(3000) for x in [rnd.random()]]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    counts = models.counted(df, ["y", "a", "b"]).withColumn("_weight", F.col("_rows"))
    assert counts.count() == 3000
    stages, inputs, cells = models.binned(counts, ["a", "b"], "y", 16, ["_rows", "_weight"])
    assert inputs == ["_bin_a", "b"] and cells.count() <= 2 * 16 * 9
    assert cells.agg(F.sum("_rows")).first()[0] == 3000 and cells.select("_bin_a").distinct().count() == 16
    parts = models.lots(cells).groupBy("y", *inputs).agg(F.sum("_rows").alias("n"), F.sum("_weight").alias("w"),
                                                         F.count(F.lit(1)).alias("lots"), (F.max("_rows") - F.min("_rows")).alias("d"))
    both = parts.join(cells, ["y", *inputs]).collect()
    assert len(both) == cells.count() and all(
        r["n"] == r["_rows"] == pytest.approx(r["w"]) and r["d"] <= 1 and r["lots"] == min(8, r["n"]) for r in both)
    seen, group = [], models.stored
    monkeypatch.setattr(models, "stored", lambda d: seen.append(group(d)) or seen[-1])
    for name, params in (("tree", {"maxDepth": 3}), ("boosted", {"maxIter": 4})):
        one = models.make_model(name, params, ["a", "b"], "y").fit(df)
        two = models.fit(name, params, ["a", "b"], "y", df)
        assert seen[-1].count() <= 2 * 32 * 9
        aucs = [tuning.measure(models.predict(m, df, ["y"]), "y")["auc"] for m in (one, two)]
        assert aucs[0] == pytest.approx(aucs[1], abs=0.01)
    kept = model_filter(df, ["a", "b"], "y", False, rounds=4).collect()
    assert seen[-1].count() <= 2 * 32 * 9 and [r["feature"] for r in kept] == ["a", "b"]


@pytest.mark.parametrize("params", [{"maxIter": 15}, {"hidden": 3, "maxIter": 8, "tol": 1e-3}, {"hidden1": 4, "hidden2": 3, "maxIter": 6}])
def test_perceptrons_from_counted_rows_are_those_of_mllib(spark, tmp_path, params):
    """equal rows once, MLlib's own steps; full blocks, so that MLlib's mean over blocks is that over rows."""
    rnd = random.Random(5)
    rows = [(i, float(i % 7), float(i % 5), int(rnd.random() < 0.1 + 0.1 * (i % 7))) for i in range(1280)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").coalesce(1)
    assert models.fits_counts("mlp", params) and not models.fits_counts("mlp", {"solver": "gd"})
    counts = models.counted(df, ["y", "a", "b"])
    one = models.make_model("mlp", params, ["a", "b"], "y").fit(df)
    two = models.fit_counted("mlp", params, ["a", "b"], "y", counts)
    path = models.save_model(two, params, "mlp", str(tmp_path))
    for m in (two, models.load_model(path)):
        scores = [{r["id"]: (r["prediction"], r["score"]) for r in models.predict(x, df, ["id"]).collect()} for x in (one, m)]
        assert all(scores[0][i] == pytest.approx(scores[1][i], abs=1e-7) for i in scores[0])


def test_perceptrons_of_a_search_share_their_passes(spark, monkeypatch):
    """a search takes as many passes as its longest fit; a point that can't be fitted fails alone."""
    from scoreflow.plans import perceptron

    df = spark.range(600).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 2).cast("int").alias("y"))
    passes, sums = [], perceptron._sums
    monkeypatch.setattr(perceptron, "_sums", lambda points: passes.append(len(points)) or sums(points))
    space = {"hidden": [2, 3], "maxIter": [2, 4]}
    best, trials = tuning.search("mlp", df, df, "id", ["x"], "y", "accuracy", 5, space=space)
    assert passes[0] == 5 and len(passes) < 5 * 4 and passes == sorted(passes, reverse=True)
    assert trials.where("value is null").count() == 0
    counts = models.counted(df, ["y", "x"])
    alone = [tuning.measure(tuning.predict(models.fit_counted("mlp", p, ["x"], "y", counts), df, ["y"]), "y")["ks"]
             for p in ({"maxIter": 3}, {"hidden": 3, "maxIter": 5})]
    good, bad, also = models.fit_perceptrons([{"maxIter": 3}, {"hidden": [0]}, {"hidden": 3, "maxIter": 5}], ["x"], "y", counts)
    assert isinstance(bad, Exception)
    together = tuning.measure_models([good, bad, also], [counts] * 3, "y")
    assert together[1] is bad and [together[0]["ks"], together[2]["ks"]] == pytest.approx(alone, abs=1e-9)


def test_models_measured_together_have_their_own_figures(spark):
    rnd = random.Random(9)
    rows = [(rnd.randrange(2), rnd.randrange(2), round(rnd.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, prediction int, score double")
    frames = [df, df.withColumn("score", 1 - F.col("score")), df.drop("score"), df.where("y = 1"), df.limit(0)]
    found = tuning.measure_all(frames, "y")
    for one, frame in zip(found, frames):
        assert one == pytest.approx(tuning.measure(frame, "y"))
    assert found[1]["auc"] == pytest.approx(1 - found[0]["auc"]) and "auc" not in found[2] and "auc" not in found[3]
    assert found[4]["accuracy"] is None


@pytest.mark.parametrize("family", ["tree", "logistic"])
def test_a_run_out_of_time_reads_its_rows_once(spark, monkeypatch, family):
    """one pass counts the folds of both numbers and all rows; trees are measured on cells; figures as on the rows."""
    rnd = random.Random(11)
    rows = [(i, x, float(i % 9), int(x + rnd.random() > 1.1 + 0.05 * (i % 9))) for i in range(1200) for x in [round(rnd.random(), 4)]]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    dev, oot = df.where("id < 900"), df.where("id >= 900")
    counts, passes, seen = tuning.folds_and_rows, [], []
    monkeypatch.setattr(tuning, "folds_and_rows", lambda *a: passes.append(a[3]) or counts(*a))
    both = tuning.measure_all
    monkeypatch.setattr(tuning, "measure_all", lambda made, *a: seen.extend(d.count() for d in made) or both(made, *a))
    done = tuning.dev_oot_run(dev, oot, "id", ["a", "b"], "y", {family: {}}, "ks", folds=3, tune_folds=2, n_trials=2)
    assert passes == [[3, 2]]
    assert family != "tree" or max(seen) <= 300 and len(seen) == 3 + 1 + 2 * 2 + 1
    values = {(r["model"], r["split"]): r["value"] for r in done.board.where("metric = 'auc'").collect()}
    for name, params in ((family, {}), (f"{family}_tuned", done.params)):
        model = models.fit(family, params, ["a", "b"], "y", dev)
        assert values[name, "oot"] == pytest.approx(both([models.predict(model, oot, ["y"])], "y")[0]["auc"], abs=1e-9)
    cv = tuning.cross_validate(family, {}, dev, "id", ["a", "b"], "y", 3)
    assert values[family, "cv"] == pytest.approx(cv["auc"], abs=1e-9)
