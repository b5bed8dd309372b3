"""Model queries whose results follow from the tables, so SQL can check them.

Three frames make that possible. In ``apart`` two inputs tell the classes apart by a wide
margin, so every family has to predict every row. In ``two_valued`` one 0/1 input makes a
logistic model without penalty and a tree of depth one both predict the bad rate of each value. On
``stump`` a tree of depth one must find the split with the largest Gini gain.
"""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from scoreflow.catalog.base_queries import scratch
from scoreflow.catalog.frames import LINE_ID_SQL, SCORE_SQL, line_id, table, with_score, with_sql
from scoreflow.catalog.registry import query
from scoreflow.operators import explain
from scoreflow.operators.sampling import split
from scoreflow.plans import models, tuning
from scoreflow.plans.wrapper import wrapper_select
from scoreflow.sources import runlog

TARGET_SQL = f"CAST({SCORE_SQL} + CAST(day(l_shipdate) AS DOUBLE) / 31.0 > 1.2 AS INTEGER)"
STUMP = ["l_quantity", "l_discount", "l_tax"]
SAVED = ("accuracy", "ks")
NOT_TEST = "substr(md5(id || '|42'), 1, 8) >= '33333333'"


def target():
    noise = F.dayofmonth("l_shipdate") / 31.0
    return (F.col("score") + noise > 1.2).cast("int").alias("target")


def lines(spark, d):
    return with_score(table(spark, d, "lineitem")).withColumn("id", line_id())


# Every row is predicted ----------------------------------------------------------------------
def apart(spark, d):
    high = (F.col("l_quantity") > 25).cast("int")
    return lines(spark, d).select("id", high.alias("target"), (high + F.col("l_tax")).alias("a"),
                                  (1 - high + F.col("l_tax")).alias("b"))


APART_SQL = f"SELECT {LINE_ID_SQL} AS id, CAST(l_quantity > 25 AS INTEGER) AS prediction FROM lineitem"


def _apart(number, name):
    @query(f"t{number}_{name}_apart", APART_SQL)
    def run(spark, d):
        df = apart(spark, d)
        train, _ = split(df, "id")
        model = models.fit(name, {}, ["a", "b"], "target", train)
        return models.predict(model, df, ["id"]).select("id", "prediction")


for _number, _name in enumerate(
        ("logistic", "tree", "forest", "boosted", "svc", "naive_bayes", "mlp", "fm"), 1):
    _apart(_number, _name)


# One input says nothing about the class, both together all: linear families can't tell it.
CROSSED_SQL = f"""SELECT {LINE_ID_SQL} AS id, CAST((l_quantity > 25) <> (l_discount > 0.05) AS INTEGER) AS prediction
FROM lineitem"""
CROSSED = {"tree": {}, "forest": {}, "boosted": {}, "mlp": {"hidden": [8], "maxIter": 200}, "fm": {"maxIter": 300, "stepSize": 0.1}}


def _crossed(number, name):
    @query(f"t{number}_{name}_crossed", CROSSED_SQL)
    def run(spark, d):
        high, deep = (F.col(c) > v for c, v in (("l_quantity", 25), ("l_discount", 0.05)))
        side = lambda c: F.when(c, 1.0).otherwise(-1.0)
        df = lines(spark, d).select("id", (high != deep).cast("int").alias("target"), (side(high) + F.col("l_tax")).alias("a"),
                                    (side(deep) - F.col("l_tax")).alias("b"))
        train, _ = split(df, "id")
        model = models.fit(name, CROSSED[name], ["a", "b"], "target", train)
        return models.predict(model, df, ["id"]).select("id", "prediction")


for _number, _name in ((2, "tree"), (3, "forest"), (4, "boosted"), (7, "mlp"), (8, "fm")):
    _crossed(_number, _name)


@query("t9_ovr_apart", f"""SELECT {LINE_ID_SQL} AS id, CASE WHEN l_quantity <= 17 THEN 0
 WHEN l_quantity <= 34 THEN 1 ELSE 2 END AS prediction FROM lineitem""")
def _(spark, d):
    q = F.col("l_quantity")
    kind = F.when(q <= 17, 0).when(q <= 34, 1).otherwise(2)
    df = lines(spark, d).select("id", kind.alias("target"), *[
        ((kind == i).cast("int") + F.col("l_tax")).alias(f"a{i}") for i in range(3)])
    model = models.make_model("ovr", {}, ["a0", "a1", "a2"], "target", n_classes=3).fit(df)
    return models.predict(model, df, ["id"]).select("id", "prediction")


@query("m10_margin_score_apart", APART_SQL)
def _(spark, d):
    """The sigmoid of the margin is above one half exactly for class 1."""
    df = apart(spark, d)
    model = models.make_model("svc", {}, ["a", "b"], "target").fit(df)
    scored = models.predict(model, df, ["id"])
    return scored.select("id", (F.col("score") > 0.5).cast("int").alias("prediction"))


# Rates of a 0/1 input ------------------------------------------------------------------------
def two_valued(spark, d):
    high = (F.col("l_discount") >= 0.05).cast("int")
    return lines(spark, d).select("id", target(), high.alias("x"), "l_shipdate",
                                  (F.col("l_tax") >= 0.04).cast("int").alias("y"))


TWO_SQL = f"""two AS (SELECT {LINE_ID_SQL} AS id, {TARGET_SQL} AS target,
 CAST(l_discount >= 0.05 AS INTEGER) AS x, CAST(l_tax >= 0.04 AS INTEGER) AS y, l_shipdate FROM lineitem),
 marked AS (SELECT *, {NOT_TEST} AS train FROM two)"""


def rates_sql(name, rows, col="x"):
    return f"{name} AS (SELECT {col} AS x, avg(target) AS p FROM {rows} GROUP BY 1)"


def measured_sql(rows, rates, col="x"):
    """Accuracy and KS of predicting the rates of each value."""
    return f"""SELECT avg(CAST((p > 0.5) = (target = 1) AS INTEGER)) AS accuracy,
 abs(avg({rates}.x) FILTER (target = 1) - avg({rates}.x) FILTER (target = 0)) AS ks
 FROM {rows} AS o JOIN {rates} ON o.{col} = {rates}.x"""


def board(table, *keys):
    """The saved metrics of a leaderboard as columns."""
    kept = table.filter(F.col("metric").isin(*SAVED))
    wide = kept.groupBy(*keys).pivot("metric", list(SAVED)).agg(F.max("value"))
    return wide.select(*keys, *[F.round(m, 5).alias(m) for m in SAVED])


ROUNDED = "round(accuracy, 5) AS accuracy, round(ks, 5) AS ks"


@query("t1_logistic_rates", with_sql(TWO_SQL, rates_sql("r", "two")) + """
SELECT id, round(p, 3) AS score FROM two JOIN r USING (x)""")
def _(spark, d):
    df = two_valued(spark, d)
    model = models.make_model("logistic", {}, ["x"], "target").fit(df)
    return models.predict(model, df, ["id"]).select("id", F.round("score", 3).alias("score"))


@query("s7_s8_stored_model_rates", with_sql(TWO_SQL, rates_sql("r", "two")) + """
SELECT id, round(p, 3) AS score FROM two JOIN r USING (x)""")
def _(spark, d):
    """The same rates from the model written and read again."""
    df = two_valued(spark, d)
    model = models.make_model("logistic", {}, ["x"], "target").fit(df)
    path = models.save_model(model, {}, "logistic", scratch(spark, "rates"))
    return models.score(path, df, ["id"]).select("id", F.round("score", 3).alias("score"))


@query("t11_m11_compare_rates", with_sql(TWO_SQL, "tr AS (SELECT * FROM marked WHERE train)",
                                         "te AS (SELECT * FROM marked WHERE NOT train)",
                                         rates_sql("r", "tr"), f"m AS ({measured_sql('te', 'r')})") + f"""
SELECT unnest(['logistic', 'tree']) AS model, {ROUNDED} FROM m""")
def _(spark, d):
    done = tuning.compare_models(two_valued(spark, d), "id", ["x"], "target",
                                 {"logistic": {}, "tree": {"maxDepth": 1}}, "ks", n_trials=0)
    wide = tuning.metrics_table(done.board, "test")
    return wide.select("model", *[F.round(m, 5).alias(m) for m in SAVED])


@query("t18_failed_model_rows", with_sql(
    TWO_SQL, "tr AS (SELECT * FROM marked WHERE train)", "te AS (SELECT * FROM marked WHERE NOT train)",
    rates_sql("r", "tr"), f"m AS ({measured_sql('te', 'r')})") + """
SELECT 'tree' AS model, false AS failed, round(accuracy, 5) AS accuracy FROM m
UNION ALL SELECT 'mlp', true, NULL""")
def _(spark, d):
    done = tuning.compare_models(two_valued(spark, d), "id", ["x"], "target",
                                 {"tree": {"maxDepth": 1}, "mlp": {"hidden": [0]}}, "auc", n_trials=0)
    return done.board.groupBy("model").agg(
        F.bool_or(F.col("error").isNotNull()).alias("failed"),
        F.round(F.max(F.when(F.col("metric") == "accuracy", F.col("value"))), 5).alias("accuracy"))


@query("l4_rank_model_rates", with_sql(
    TWO_SQL, "tr AS (SELECT * FROM marked WHERE train)", "te AS (SELECT * FROM marked WHERE NOT train)",
    rates_sql("rx", "tr"), rates_sql("ry", "tr", "y"), f"mx AS ({measured_sql('te', 'rx')})",
    f"my AS ({measured_sql('te', 'ry', 'y')})") + """
SELECT model, round(ks, 5) AS value FROM (SELECT 'by_x' AS model, ks FROM mx
 UNION ALL SELECT 'by_y', ks FROM my) ORDER BY ks DESC, model LIMIT 1""")
def _(spark, d):
    train, test = split(two_valued(spark, d), "id")
    rows = []
    for col in ("x", "y"):
        found = tuning.fit_measure("tree", {"maxDepth": 1}, train, {"t": test}, [col], "target")[1]["t"]
        rows += [(f"by_{col}", "test", k, v, None) for k, v in found.items()]
    best = tuning.rank(tuning.as_board(spark, rows), "ks", "test").limit(1)
    return best.select("model", F.round("value", 5).alias("value"))


FOLD_SQL = "CAST(CAST('0x' || substr(md5(id || '|42'), 1, 8) AS BIGINT) % 5 AS INTEGER)"


def cv_sql(rows):
    return f"""f AS (SELECT *, {FOLD_SQL} AS fold FROM {rows}),
 fr AS (SELECT k.fold, x, avg(target) AS p FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY 1, 2),
 fm AS (SELECT f.fold, avg(CAST((p > 0.5) = (target = 1) AS INTEGER)) AS accuracy,
  abs(avg(f.x) FILTER (target = 1) - avg(f.x) FILTER (target = 0)) AS ks
  FROM f JOIN fr ON f.fold = fr.fold AND f.x = fr.x GROUP BY 1)"""


@query("t12_cross_validate_rates", with_sql(TWO_SQL, cv_sql("two")) + """
SELECT 'tree' AS model, round(avg(accuracy), 5) AS accuracy, round(avg(ks), 5) AS ks FROM fm""")
def _(spark, d):
    found = tuning.cross_validate("tree", {"maxDepth": 1}, two_valued(spark, d), "id", ["x"], "target")
    rows = [("tree", "cv", k, v, None) for k, v in found.items()]
    return board(tuning.as_board(spark, rows), "model")


@query("t13_t15_dev_oot_rates", with_sql(
    TWO_SQL, "dev AS (SELECT * FROM two WHERE l_shipdate < '2000-07-01')",
    "oot AS (SELECT * FROM two WHERE l_shipdate >= '2000-07-01')", cv_sql("dev"), rates_sql("r", "dev"),
    f"m AS ({measured_sql('oot', 'r')})") + f"""
SELECT 'tree' AS model, 'cv' AS split, round(avg(accuracy), 5) AS accuracy, round(avg(ks), 5) AS ks FROM fm
UNION ALL SELECT unnest(['tree', 'tree_tuned']), 'oot', {ROUNDED} FROM m""")
def _(spark, d):
    df = two_valued(spark, d)
    first = F.col("l_shipdate") < F.lit("2000-07-01").cast("date")
    done = tuning.dev_oot_run(df.filter(first), df.filter(~first), "id", ["x"], "target",
                              {"tree": {"maxDepth": 1}}, "ks", n_trials=0)
    return board(done.board, "model", "split")


@query("t14_search_rates", with_sql(
    TWO_SQL, "tr AS (SELECT * FROM marked WHERE train)", "te AS (SELECT * FROM marked WHERE NOT train)",
    rates_sql("r", "tr"), f"m AS ({measured_sql('te', 'r')})") + """
SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS trial, round(ks, 5) AS value FROM m""")
def _(spark, d):
    """With one 0/1 input every tree of the search space makes the same split."""
    train, test = split(two_valued(spark, d), "id")
    trials = tuning.search("tree", train, test, "id", ["x"], "target", "ks")[1]
    return trials.select("trial", F.round("value", 5).alias("value"))


# A logistic model of two 0/1 inputs and their product gives the rate of each of the four cells, so
# the value of every drawn threshold follows from the rates.
CELLS, SPACE = ["x", "y", "xy"], {"threshold": (0.05, 0.95)}


def cells(spark, d):
    return two_valued(spark, d).withColumn("xy", F.col("x") * F.col("y"))


def drawn(n, seed=42):
    """The thresholds that a search draws, as rows (trial, t, params) of SQL."""
    rng = random.Random(seed)
    points = [tuning.draw(SPACE, rng) for _ in range(n)]
    rows = ", ".join("({}, CAST('{!r}' AS DOUBLE), '{}')".format(
        i, p["threshold"], str(sorted(p.items())).replace("'", "''")) for i, p in enumerate(points))
    return f"drawn(trial, t, params) AS (VALUES {rows})"


def cell_rates(name, rows):
    return f"{name} AS (SELECT x, y, avg(target) AS p FROM {rows} GROUP BY 1, 2)"


HIT = "avg(CAST((p > t) = (target = 1) AS INTEGER))"
SPLIT_SQL = ("tr AS (SELECT * FROM marked WHERE train)", "te AS (SELECT * FROM marked WHERE NOT train)")
BEST = "(SELECT trial FROM v ORDER BY round(value, 9) DESC, trial LIMIT 1)"


@query("t14_search_thresholds", with_sql(
    TWO_SQL, *SPLIT_SQL, cell_rates("r", "tr"), drawn(10),
    f"v AS (SELECT trial, params, {HIT} AS value FROM te JOIN r USING (x, y), drawn GROUP BY 1, 2)") + f"""
SELECT CAST(trial AS INTEGER) AS trial, params, round(value, 5) AS value, trial = {BEST} AS best FROM v""")
def _(spark, d):
    """Every draw has its own value; the winner and its parameters are checked."""
    train, test = split(cells(spark, d), "id")
    best, trials = tuning.search("logistic", train, test, "id", CELLS, "target", "accuracy", space=SPACE)
    return trials.select("trial", "params", F.round("value", 5).alias("value"),
                         (F.col("params") == str(sorted(best.items()))).alias("best"))


@query("t14_search_thresholds_folds", with_sql(
    TWO_SQL, f"f AS (SELECT *, {FOLD_SQL.replace('% 5', '% 3')} AS fold FROM two)", drawn(4),
    "r AS (SELECT k.fold, x, y, avg(target) AS p FROM (SELECT DISTINCT fold FROM f) k "
    "JOIN f ON f.fold <> k.fold GROUP BY 1, 2, 3)",
    f"w AS (SELECT trial, fold, {HIT} AS value FROM f JOIN r USING (fold, x, y), drawn GROUP BY 1, 2)",
    "v AS (SELECT trial, avg(value) AS value FROM w GROUP BY 1)") + f"""
SELECT CAST(trial AS INTEGER) AS trial, round(value, 5) AS value, trial = {BEST} AS best FROM v""")
def _(spark, d):
    """Without a test frame every draw is measured by cross-validation."""
    best, trials = tuning.search("logistic", cells(spark, d), None, "id", CELLS, "target", "accuracy", 4,
                                 space=SPACE)
    return trials.select("trial", F.round("value", 5).alias("value"),
                         (F.col("params") == str(sorted(best.items()))).alias("best"))


@query("t11_compare_tuned", with_sql(
    TWO_SQL, *SPLIT_SQL, cell_rates("r", "tr"), drawn(10),
    f"v AS (SELECT trial, t, {HIT} AS value FROM te JOIN r USING (x, y), drawn GROUP BY 1, 2)",
    f"m AS (SELECT {HIT} AS value FROM te JOIN r USING (x, y), (SELECT 0.5 AS t) q)") + f"""
SELECT 'logistic' AS model, round(value, 5) AS accuracy, 0.5 AS threshold FROM m
UNION ALL SELECT 'logistic_tuned', round(value, 5), round(t, 6) FROM v WHERE trial = {BEST}""")
def _(spark, d):
    """The winner is tuned, fitted again with the best draw and measured."""
    done = tuning.compare_models(cells(spark, d), "id", CELLS, "target", {"logistic": {}}, "accuracy", space=SPACE)
    found = F.when(F.col("model") == done.best, round(done.params["threshold"], 6)).otherwise(0.5)
    return done.board.filter("metric = 'accuracy'").select(
        "model", F.round("value", 5).alias("accuracy"), found.alias("threshold"))


@query("t13_t15_tuned_out_of_time", with_sql(
    TWO_SQL, "dev AS (SELECT * FROM two WHERE l_shipdate < '2000-07-01')",
    "oot AS (SELECT * FROM two WHERE l_shipdate >= '2000-07-01')",
    f"f AS (SELECT *, {FOLD_SQL.replace('% 5', '% 3')} AS fold FROM dev)", drawn(4),
    "fr AS (SELECT k.fold, x, y, avg(target) AS p FROM (SELECT DISTINCT fold FROM f) k "
    "JOIN f ON f.fold <> k.fold GROUP BY 1, 2, 3)",
    f"w AS (SELECT trial, t, fold, {HIT} AS value FROM f JOIN fr USING (fold, x, y), drawn GROUP BY 1, 2, 3)",
    "v AS (SELECT trial, t, avg(value) AS value FROM w GROUP BY 1, 2)", cell_rates("r", "dev"),
    f"q AS (SELECT 'logistic' AS model, 0.5 AS t UNION ALL SELECT 'logistic_tuned', t FROM v WHERE trial = {BEST})")
    + f"""SELECT model, round({HIT}, 5) AS accuracy, round(t, 6) AS threshold FROM oot JOIN r USING (x, y), q
 GROUP BY model, t""")
def _(spark, d):
    """Tuned by cross-validation on the development rows, fitted on all of them, measured out of time."""
    df = cells(spark, d)
    first = F.col("l_shipdate") < F.lit("2000-07-01").cast("date")
    done = tuning.dev_oot_run(df.filter(first), df.filter(~first), "id", CELLS, "target", {"logistic": {}},
                              "accuracy", folds=2, n_trials=4, space=SPACE)
    found = F.when(F.col("model") == done.best, round(done.params["threshold"], 6)).otherwise(0.5)
    return done.board.filter("metric = 'accuracy' AND split = 'oot'").select(
        "model", F.round("value", 5).alias("accuracy"), found.alias("threshold"))


def _alone_sql(col):
    return f"""SELECT '{col}' AS feature, abs(avg({col}) FILTER (target = 1) - avg({col}) FILTER (target = 0)) AS ks
 FROM k WHERE substr(md5(id || '|42'), 1, 8) < '4ccccccd'"""


@query("g4_g5_best_of_three", with_sql(
    f"k AS (SELECT {LINE_ID_SQL} AS id, {TARGET_SQL} AS target, CAST(l_discount >= 0.05 AS INTEGER) AS x, "
    "CAST(l_tax >= 0.04 AS INTEGER) AS y, CAST(l_quantity >= 25 AS INTEGER) AS z FROM lineitem)",
    "v AS (" + " UNION ALL ".join(_alone_sql(c) for c in "xyz") + ")") + """
SELECT feature, round(ks, 5) AS ks, round(0.01 - ks, 5) AS fitness FROM v ORDER BY ks DESC, feature LIMIT 1""")
def _(spark, d):
    """A tree of depth one gains nothing from a second input that costs 0.01, so the best of the seven
    masks is the input with the largest KS alone. The first positions hold every mask."""
    df = lines(spark, d).select("id", target(), *[(F.col(c) >= v).cast("int").alias(n) for c, v, n in (
        ("l_discount", 0.05, "x"), ("l_tax", 0.04, "y"), ("l_quantity", 25, "z"))])
    names, history = wrapper_select(df, "id", list("xyz"), "target", particles=40, iters=3, family="tree",
                                    params={"maxDepth": 1}, parallelism=4)
    last = history.filter("iteration = 2")
    return last.select(F.lit(",".join(names)).alias("feature"), F.round("ks", 5).alias("ks"),
                       F.round("fitness", 5).alias("fitness"))


@query("t16_s9_tracked_rates", with_sql(
    TWO_SQL, "tr AS (SELECT * FROM marked WHERE train)", "te AS (SELECT * FROM marked WHERE NOT train)",
    rates_sql("r", "tr"), f"m AS ({measured_sql('te', 'r')})") + f"""
SELECT 'tree' AS model, {ROUNDED} FROM m""")
def _(spark, d):
    train, test = split(two_valued(spark, d), "id")
    folder = scratch(spark, "tracked-rates")
    tuning.tracked_run(train, test, "id", ["x"], "target", folder, "tree", {"maxDepth": 1})
    return board(runlog.run_metrics(runlog.read_runs(spark, f"{folder}/runs")), "model")


@query("t17_score_rates", with_sql(
    TWO_SQL, rates_sql("rx", "two"), rates_sql("ry", "two", "y"), f"mx AS ({measured_sql('two', 'rx')})",
    f"my AS ({measured_sql('two', 'ry', 'y')})") + f"""
SELECT model, best, {ROUNDED} FROM (SELECT 'by_x' AS model, mx.ks >= my.ks AS best, mx.* FROM mx, my
 UNION ALL SELECT 'by_y', mx.ks < my.ks, my.* FROM mx, my)""")
def _(spark, d):
    df, folder, paths = two_valued(spark, d), scratch(spark, "score-rates"), {}
    for col in ("x", "y"):
        model = models.make_model("logistic", {}, [col], "target").fit(df)
        paths[f"by_{col}"] = models.save_model(model, {}, f"by_{col}", folder)
    return board(tuning.score_runs(paths, df, "target"), "model", "best")


# The best split ------------------------------------------------------------------------------
STUMP_SQL = f"""rows AS (SELECT {LINE_ID_SQL} AS id, {TARGET_SQL} AS target, l_quantity, l_discount, l_tax FROM lineitem),
 long AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, target FROM rows" for c in STUMP) + """),
 counted AS (SELECT feature, v, count(*) AS n, sum(target) AS k FROM long GROUP BY 1, 2),
 cut AS (SELECT feature, v, (v + lead(v) OVER w) / 2 AS threshold, sum(n) OVER w AS nl, sum(k) OVER w AS kl,
  sum(n) OVER (PARTITION BY feature) AS n, sum(k) OVER (PARTITION BY feature) AS k FROM counted
  WINDOW w AS (PARTITION BY feature ORDER BY v)),
 best AS (SELECT * FROM cut WHERE threshold IS NOT NULL ORDER BY
  kl*(nl - kl)/nl + (k - kl)*(n - nl - k + kl)/(n - nl), feature LIMIT 1),
 leaf AS (SELECT feature, threshold, kl/nl AS low, (k - kl)/(n - nl) AS high FROM best)"""
LEAF_SQL = ("CASE WHEN CASE leaf.feature WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount "
            "ELSE l_tax END <= threshold THEN low ELSE high END")


def stump(spark, d):
    df = lines(spark, d).select("id", target(), *STUMP)
    # More bins than distinct values: every split is a candidate.
    return df, models.make_model("tree", {"maxDepth": 1, "maxBins": 64}, STUMP, "target").fit(df)


@query("t2_tree_first_split", with_sql(STUMP_SQL) + """SELECT feature, round(threshold, 5) AS threshold,
 round(low, 6) AS low, round(high, 6) AS high FROM leaf""")
def _(spark, d):
    _, model = stump(spark, d)
    root = model.stages[-1]._call_java("rootNode")
    share = lambda node: float(node.impurityStats().stats()[1] / sum(node.impurityStats().stats()))
    row = (STUMP[root.split().featureIndex()], root.split().threshold(), share(root.leftChild()),
           share(root.rightChild()))
    return spark.createDataFrame([row], "feature string, threshold double, low double, high double").select(
        "feature", F.round("threshold", 5).alias("threshold"), F.round("low", 6).alias("low"),
        F.round("high", 6).alias("high"))


@query("k8_importance_of_split", with_sql(STUMP_SQL) + "SELECT feature, CAST(1 AS DOUBLE) AS importance FROM leaf "
       + "UNION ALL SELECT f, 0 FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS f), leaf WHERE f <> feature")
def _(spark, d):
    return models.importance(stump(spark, d)[1], STUMP)


@query("l3_top_feature_of_split", with_sql(STUMP_SQL) + "SELECT feature FROM leaf")
def _(spark, d):
    names = models.top_features(models.importance(stump(spark, d)[1], STUMP), 1)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("x1_permutation_of_split", with_sql(STUMP_SQL) + """SELECT f AS feature, f = feature AS used
FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS f), leaf""")
def _(spark, d):
    """Only the feature of the split loses by a permutation, the others lose exactly nothing."""
    df, model = stump(spark, d)
    found = explain.permutation_importance(model, df, "id", STUMP, "target")
    return found.select("feature", (F.col("importance") > 0.001).alias("used"))


@query("x3_x5_shapley_of_split", with_sql(STUMP_SQL) + f""", back AS (SELECT avg({LEAF_SQL}) AS mean FROM
 (SELECT * FROM rows ORDER BY md5(id || '|43'), id LIMIT 20) s, leaf),
 picked AS (SELECT * FROM rows ORDER BY md5(id || '|42'), id LIMIT 100)
SELECT id, leaf.feature, CASE leaf.feature WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount
 ELSE l_tax END AS value, round({LEAF_SQL} - mean, 6) AS contribution FROM picked, leaf, back""")
def _(spark, d):
    """With one split the contribution of its feature is the score less the mean background score."""
    df, model = stump(spark, d)
    parts = explain.sampled_shapley(model, df, "id", STUMP)
    top = models.top_features(models.importance(model, STUMP), 1)
    out = explain.dependence(parts, df, "id", top)
    return out.select("id", "feature", "value", F.round("contribution", 6).alias("contribution"))
