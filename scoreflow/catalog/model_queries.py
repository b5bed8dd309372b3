"""Queries on models, tuning, imputation, oversampling, selection and explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreflow.catalog.base_queries import scratch
from scoreflow.catalog.frames import (IMBALANCED_SQL, LINE_ID_SQL, MISSING_SQL, NUMERIC,
                                      SIGNAL_SQL, imbalanced, line_id, missing, table, vectors, with_score,
                                      with_sql)
from scoreflow.catalog.registry import query
from scoreflow.operators import explain, metric_index, mice, neighbours
from scoreflow.operators.balance import smote
from scoreflow.operators.sampling import split, weights
from scoreflow.operators.stability import between_months, months_of
from scoreflow.plans import models, tuning
from scoreflow.plans.select import model_filter
from scoreflow.plans.wrapper import wrapper_select
from scoreflow.sources import runlog

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Every family with its own defaults.
PLAIN = {name: {} for name in ("logistic", "tree", "forest", "boosted", "svc", "naive_bayes",
                               "mlp", "fm")}


def training(spark, d):
    """Line items with the separable target of the signal frame."""
    df = with_score(table(spark, d, "lineitem"))
    noise = F.dayofmonth("l_shipdate") / 31.0
    return df.select(line_id().alias("id"), (F.col("score") + noise > 1.2).cast("int")
                     .alias("target"), *LINE, F.col("l_shipdate").alias("date"))


def _family(number, name):
    @query(f"t{number}_{name}")
    def run(spark, d):
        train, test = split(training(spark, d), "id")
        _, found = tuning.fit_measure(name, PLAIN[name], train, {"test": test}, LINE, "target")
        rows = [(name, "test", k, v, None) for k, v in found["test"].items()]
        return tuning.as_board(spark, rows)

    return run


for _number, _name in enumerate(PLAIN, 1):
    _family(_number, _name)


@query("t6_naive_bayes_priors", with_sql(SIGNAL_SQL) + """SELECT CAST(target AS INTEGER) AS class,
 round(ln(count(*) + 1) - ln(sum(count(*)) OVER () + 2), 6) AS log_prior FROM signal GROUP BY 1""")
def _(spark, d):
    fitted = models.make_model("naive_bayes", {"smoothing": 1.0}, LINE, "target").fit(
        training(spark, d))
    rows = [(i, round(float(v), 6)) for i, v in enumerate(fitted.stages[-1].pi.toArray())]
    return spark.createDataFrame(rows, "class int, log_prior double")


@query("t9_ovr")
def _(spark, d):
    cols = [f"v{i}" for i in range(64)]
    train, test = split(vectors(spark, d), "id")
    _, found = tuning.fit_measure("ovr", {}, train, {"test": test}, cols, "label",
                                  n_classes=10)
    return tuning.as_board(spark, [("ovr", "test", k, v, None) for k, v in found["test"].items()])


@query("m10_margin_score")
def _(spark, d):
    train, test = split(training(spark, d), "id")
    model = models.make_model("svc", {}, LINE, "target").fit(train)
    return models.predict(model, test, ["id", "target"])


@query("k8_importance")
def _(spark, d):
    model = models.make_model("forest", {}, LINE, "target").fit(training(spark, d))
    return models.importance(model, LINE)


@query("l3_top_features")
def _(spark, d):
    model = models.make_model("tree", {}, LINE, "target").fit(training(spark, d))
    names = models.top_features(models.importance(model, LINE))
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, feature string")


@query("s7_s8_stored_model")
def _(spark, d):
    df = training(spark, d)
    model = models.make_model("logistic", {}, LINE, "target").fit(df)
    path = models.save_model(model, {}, "logistic", scratch(spark, "model"))
    return models.score(path, df, ["id", "target"])


@query("t11_m11_compare_models")
def _(spark, d):
    done = tuning.compare_models(training(spark, d), "id", LINE, "target", PLAIN, "ks")
    return tuning.metrics_table(done.board, "test")


@query("t18_failed_model")
def _(spark, d):
    broken = {"tree": {}, "mlp": {"hidden": [0]}}
    done = tuning.compare_models(training(spark, d), "id", LINE, "target", broken, "auc",
                                 n_trials=0)
    return done.board


@query("l4_rank_models")
def _(spark, d):
    train, test = split(training(spark, d), "id")
    rows = []
    for depth in (2, 4):
        found = tuning.fit_measure("tree", {"maxDepth": depth}, train, {"test": test}, LINE,
                                   "target")[1]["test"]
        rows += [(f"tree_{depth}", "test", k, v, None) for k, v in found.items()]
    return tuning.rank(tuning.as_board(spark, rows), "ks", "test").limit(1)


@query("t12_cross_validate")
def _(spark, d):
    found = tuning.cross_validate("tree", {}, training(spark, d), "id", LINE, "target")
    return tuning.as_board(spark, [("tree", "cv", k, v, None) for k, v in found.items()])


@query("t14_search")
def _(spark, d):
    train, test = split(training(spark, d), "id")
    return tuning.search("tree", train, test, "id", LINE, "target", "ks")[1]


@query("t14_search_credit")
def _(spark, d):
    """The credit space with PR-AUC as the goal and class weights."""
    train, test = split(weights(training(spark, d), "target"), "id")
    return tuning.search("logistic", train, test, "id", LINE, "target", "pr_auc",
                         space=tuning.CREDIT["logistic"], weight="weight")[1]


@query("t13_t15_dev_oot")
def _(spark, d):
    df = training(spark, d)
    months = months_of(df, "date")
    dev = between_months(df, "date", months[:-12])
    oot = between_months(df, "date", months[-12:])
    done = tuning.dev_oot_run(dev, oot, "id", LINE, "target", {"tree": {}, "logistic": {}}, "ks",
                              folder=scratch(spark, "dev-oot"))
    return done.board


@query("t16_s9_tracked_run")
def _(spark, d):
    train, test = split(training(spark, d), "id")
    folder = scratch(spark, "tracked")
    tuning.tracked_run(train, test, "id", LINE, "target", folder, "forest", {})
    return runlog.read_runs(spark, f"{folder}/runs")


@query("t17_score_runs")
def _(spark, d):
    train, test = split(training(spark, d), "id")
    folder = scratch(spark, "runs")
    paths = {}
    for depth in (2, 4):
        name = f"tree_{depth}"
        model = models.make_model("tree", {"maxDepth": depth}, LINE, "target").fit(train)
        paths[name] = models.save_model(model, {"maxDepth": depth}, name, folder)
    return tuning.score_runs(paths, test, "target")


# Imputation, neighbours, oversampling --------------------------------------------------------
@query("v8_mice_one_by_one", with_sql(MISSING_SQL) + """, c AS (SELECT
 regr_slope(l_quantity, l_extendedprice) AS b, regr_intercept(l_quantity, l_extendedprice) AS a
 FROM missing) SELECT id, round(coalesce(l_quantity, a + b*l_extendedprice), 5) AS l_quantity
FROM missing, c""")
def _(spark, d):
    df = missing(spark, d).select("id", "l_quantity", "l_extendedprice")
    out = mice.mice_impute(df, "id", max_iter=1)
    return out.select("id", F.round("l_quantity", 5).alias("l_quantity"))


@query("v8_mice_mixed")
def _(spark, d):
    df = missing(spark, d).select("id", "l_quantity", "l_tax", "l_discount", "o_orderpriority")
    return mice.mice_impute(df, "id")


@query("j7_nearest_neighbours", """WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id AS key, b.vec_id AS neighbour, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e),
 lambda t: pow(t[1] - t[2], 2)))), 5) AS distance FROM p a JOIN p b ON a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(list_sum(list_transform(list_zip(a.e, b.e),
 lambda t: pow(t[1] - t[2], 2)))), b.vec_id) <= 5""")
def _(spark, d):
    cols = [f"v{i}" for i in range(64)]
    points = vectors(spark, d).withColumn("key", F.col("id").cast("long"))
    out = neighbours.nearest(points, "key", cols, 5)
    return out.select("key", "neighbour", F.round("distance", 5).alias("distance"))


@query("j7_nearest_in_plane", """WITH p AS (SELECT c_custkey AS k, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y
 FROM customer)
SELECT a.k AS key, b.k AS neighbour, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 5) AS distance
FROM p a JOIN p b ON a.k <> b.k QUALIFY row_number() OVER (PARTITION BY a.k
 ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.k) <= 3""")
def _(spark, d):
    """The exact form where it is meant to be used: few columns that spread along a line."""
    points = table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
    out = neighbours.nearest(points, "key", ["c_acctbal", "n"], 3)
    return out.select("key", "neighbour", F.round("distance", 5).alias("distance"))


@query("j7_nearest_by_hashing")
def _(spark, d):
    cols = [f"v{i}" for i in range(64)]
    points = vectors(spark, d).withColumn("key", F.col("id").cast("long"))
    # Wide cells of few projections: the vectors have no structure that narrower ones could use.
    one = points.agg(F.sqrt(sum(F.var_pop(c) for c in cols) / len(cols))).first()[0] or 0.5
    return neighbours.nearest_by_hashing(points, "key", cols, 5, num_hash_tables=12, together=3, bucket_length=3.0 * one)


@query("j7_nearest_by_index", """WITH p AS (SELECT p_partkey AS k, CAST(20 * p_size AS DOUBLE) AS x,
 floor(CAST(p_retailprice AS DOUBLE)) AS y, CAST(50 * length(p_name) AS DOUBLE) AS z FROM part)
SELECT a.k AS key, b.k AS neighbour, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)
 + (a.z - b.z) * (a.z - b.z)), 5) AS distance FROM p a JOIN p b ON a.k <> b.k QUALIFY row_number() OVER (PARTITION BY a.k
 ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.k) <= 4""")
def _(spark, d):
    """The metric index with its exact completion; whole coordinates, so equal distances are equal."""
    points = table(spark, d, "part").select(
        F.col("p_partkey").alias("key"), (20 * F.col("p_size")).cast("double").alias("x"),
        F.floor(F.col("p_retailprice").cast("double")).cast("double").alias("y"),
        (50 * F.length("p_name")).cast("double").alias("z"))
    out = metric_index.nearest_by_index(points, "key", ["x", "y", "z"], 4)
    return out.select("key", "neighbour", F.round("distance", 5).alias("distance"))


@query("e9_smote")
def _(spark, d):
    return smote(imbalanced(spark, d), "target", "doc_id", ["n_chars", "quality"],
                 ["lang", "source"], k=5, multiplier=2)


@query("e9_smote_counts", with_sql(IMBALANCED_SQL) + """SELECT target, false AS synthetic,
 count(*) AS n FROM imbalanced GROUP BY 1 UNION ALL
SELECT 1, true, 2 * count(*) FILTER (target = 1) FROM imbalanced""")
def _(spark, d):
    out = smote(imbalanced(spark, d), "target", "doc_id", ["n_chars", "quality"], ["lang"],
                multiplier=2)
    return out.groupBy("target", "synthetic").agg(F.count(F.lit(1)).alias("n"))


# Random numbers, ranks and mates follow from hashes of the ids, so SQL can make every synthetic row.
_U = "(CAST('0x' || substr(md5({} || '|{}'), 1, 8) AS BIGINT) / 4294967296.0)"
SMOTE_SQL = with_sql(IMBALANCED_SQL) + f""", minority AS (SELECT *, CAST(doc_id AS VARCHAR) AS i FROM imbalanced
 WHERE target = 1 AND n_chars IS NOT NULL AND quality IS NOT NULL AND lang IS NOT NULL),
stand AS (SELECT * FROM minority QUALIFY row_number() OVER (PARTITION BY n_chars, quality ORDER BY md5(i)) <= 6),
near AS (SELECT a.doc_id AS base, struct_pack(x := b.n_chars, q := b.quality, l := b.lang) AS mate, row_number() OVER
 (PARTITION BY a.doc_id ORDER BY pow(a.n_chars - b.n_chars, 2) + pow(a.quality - b.quality, 2), b.doc_id) AS rn
 FROM minority a JOIN stand b ON a.doc_id <> b.doc_id QUALIFY rn <= 5),
mates AS (SELECT base, list(mate ORDER BY rn) AS mates FROM near GROUP BY 1),
drawn AS (SELECT m.*, mates, i || '#' || r AS d FROM minority m JOIN mates ON base = doc_id, (VALUES (1), (2)) t(r)),
made AS (SELECT *, mates[1 + least(CAST(floor({_U.format('d', 42)} * len(mates)) AS BIGINT), len(mates) - 1)] AS mate,
 {_U.format('d', 43)} AS u FROM drawn)
SELECT d AS doc_id, round(n_chars + u * (mate.x - n_chars), 6) AS n_chars, round(quality + u * (mate.q - quality), 6) AS quality,
 CASE WHEN {_U.format("(d || '#0')", 44)} < 0.5 THEN lang ELSE mate.l END AS lang FROM made"""


@query("e9_smote_rows", SMOTE_SQL)
def _(spark, d):
    """Every synthetic row: on the segment between its row and the mate drawn, its language from one of both."""
    out = smote(imbalanced(spark, d), "target", "doc_id", ["n_chars", "quality"], ["lang"], k=5, multiplier=2)
    return out.filter("synthetic").select("doc_id", F.round("n_chars", 6).alias("n_chars"),
                                          F.round("quality", 6).alias("quality"), "lang")


# Selection -----------------------------------------------------------------------------------
@query("g3_model_filter")
def _(spark, d):
    return model_filter(training(spark, d), LINE, "target", False)


@query("g4_g5_wrapper_select")
def _(spark, d):
    return wrapper_select(training(spark, d), "id", LINE, "target", family="tree")[1]


# Explanation ---------------------------------------------------------------------------------
WEIGHTS = {"l_quantity": 0.02, "l_discount": 5.0, "l_tax": -2.0}


@query("x2_linear_contributions", " UNION ALL ".join(
    f"SELECT {LINE_ID_SQL} AS id, '{c}' AS feature, round({w}*({c} - (SELECT avg({c}) FROM lineitem)), 6) "
    f"AS contribution FROM lineitem" for c, w in WEIGHTS.items()))
def _(spark, d):
    out = explain.linear_contributions(training(spark, d), "id", WEIGHTS)
    return out.withColumn("contribution", F.round("contribution", 6))


@query("x4_contribution_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(abs({w}*({c} - m))), 6) AS mean_abs FROM lineitem, "
    f"(SELECT avg({c}) AS m FROM lineitem)" for c, w in WEIGHTS.items()))
def _(spark, d):
    parts = explain.linear_contributions(training(spark, d), "id", WEIGHTS)
    return explain.contribution_summary(parts).withColumn("mean_abs", F.round("mean_abs", 6))


@query("x1_permutation_importance")
def _(spark, d):
    train, test = split(training(spark, d), "id")
    model = models.make_model("tree", {}, LINE, "target").fit(train)
    return explain.permutation_importance(model, test, "id", LINE, "target")


@query("x3_x5_sampled_shapley")
def _(spark, d):
    df = training(spark, d)
    model = models.make_model("tree", {}, LINE, "target").fit(df)
    parts = explain.sampled_shapley(model, df, "id", LINE, n_rows=100)
    top = models.top_features(models.importance(model, LINE))
    return explain.dependence(parts, df, "id", top)
