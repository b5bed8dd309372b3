"""Queries on ranking metrics, curves and the scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreflow.catalog.frames import (MISSING_SQL, SCORED_SQL, SIGNAL_SQL, IMBALANCED_SQL, imbalanced, missing, scored,
                                      signal, with_sql)
from scoreflow.catalog.registry import query
from scoreflow.functions.core import sigmoid, stored
from scoreflow.operators import curves, metrics, prefix, scorecard


def r(df, **digits):
    """Round the named columns."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def r6(df, *cols):
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# Per-score steps in SQL, used by most checks below.
def steps_sql(frame: str, by: str = "", score: str = "score", name: str = "steps") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""{name}_c AS (SELECT {lead}{score} AS score, count(*) FILTER (target = 0) AS g,
      count(*) FILTER (target = 1) AS b FROM {frame} GROUP BY ALL),
    {name} AS (SELECT *, sum(g) OVER w AS cg, sum(b) OVER w AS cb,
      sum(g) OVER ({part}) AS tg, sum(b) OVER ({part}) AS tb FROM {name}_c
      WINDOW w AS ({part} ORDER BY score DESC))"""


AUC = "sum(g*(cb - b/2.0)) / nullif(max(tg)*max(tb), 0)"
KS = "max(cb/tb - cg/tg)"


@query("w1_running_sum", with_sql(SCORED_SQL, steps_sql("scored")) + """
SELECT round(score, 6) AS score, CAST(g AS BIGINT) AS goods, CAST(b AS BIGINT) AS bads,
  CAST(cg AS BIGINT) AS cum_goods, CAST(cb AS BIGINT) AS cum_bads FROM steps""")
def _(spark, d):
    return metrics.score_steps(scored(spark, d), "score", "target").select(
        F.round("score", 6).alias("score"), "goods", "bads", "cum_goods", "cum_bads")


@query("w2_global_rank", with_sql(SCORED_SQL) + """
SELECT id, row_number() OVER (ORDER BY md5(id || '|7'), id) AS rank FROM scored""")
def _(spark, d):
    return prefix.global_rank(scored(spark, d).select("id"), "id", 7)


@query("w3_ntile", with_sql(SCORED_SQL) + """
SELECT id, ntile(10) OVER (ORDER BY score, md5(id || '|0'), id) AS band FROM scored""")
def _(spark, d):
    out = prefix.ntile(scored(spark, d), "score", "id", 10)
    return out.select("id", F.col("band").cast("bigint").alias("band"))


# The tax of the frame with holes: every third line is without a score.
HOLES_SQL = with_sql(MISSING_SQL)


@query("w3_ntile_missing", HOLES_SQL + """SELECT id,
 ntile(10) OVER (ORDER BY l_tax NULLS FIRST, md5(id || '|0'), id) AS band FROM missing""")
def _(spark, d):
    out = prefix.ntile(stored(missing(spark, d).select("id", "l_tax")), "l_tax", "id", 10)
    return out.select("id", F.col("band").cast("bigint").alias("band"))


@query("b1_bands_missing", HOLES_SQL + """, t AS (SELECT l_tax, target,
 ntile(10) OVER (ORDER BY l_tax NULLS FIRST, md5(id || '|0'), id) AS band FROM missing)
SELECT band, count(*) AS total, count(l_tax) AS scored, min(l_tax) AS min_score,
 max(l_tax) AS max_score, count(*) FILTER (target = 1) AS bads FROM t GROUP BY 1""")
def _(spark, d):
    banded = scorecard.score_bands(stored(missing(spark, d).select("id", "target", "l_tax")), "l_tax", "id")
    table = scorecard.band_table(banded, "l_tax", "target").select(
        F.col("band").cast("bigint").alias("band"), "total", "min_score", "max_score", "bads")
    known = banded.groupBy(F.col("band").cast("bigint").alias("band")).agg(
        F.count("l_tax").alias("scored"))
    return table.join(known, "band")


@query("m1_ks_missing", HOLES_SQL + """, known AS (SELECT l_tax, target FROM missing WHERE l_tax IS NOT NULL),
 c AS (SELECT l_tax, sum(count(*) FILTER (target=1)) OVER (ORDER BY l_tax DESC) AS cb,
  sum(count(*) FILTER (target=0)) OVER (ORDER BY l_tax DESC) AS cg,
  sum(count(*) FILTER (target=1)) OVER () AS tb, sum(count(*) FILTER (target=0)) OVER () AS tg
  FROM known GROUP BY 1)
SELECT round(max(cb/tb - cg/tg), 6) AS ks,
 (SELECT count(*) - count(l_tax) FROM missing) AS no_score, CAST(0 AS BIGINT) AS no_target FROM c""")
def _(spark, d):
    df = missing(spark, d).withColumn("l_tax", F.coalesce("l_tax", F.lit(float("nan"))))
    found = metrics.ks(df, "l_tax", "target").select(F.round("ks", 6).alias("ks"))
    return found.crossJoin(metrics.left_out(df, "l_tax", "target"))  # one row each


@query("w4_totals", with_sql(SCORED_SQL) + """
SELECT l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM scored GROUP BY 1""")
def _(spark, d):
    df = scored(spark, d)
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return df.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share", F.round(F.col("n") / total, 6))


@query("w6_band_difference", with_sql(SCORED_SQL) + """, b AS (SELECT ntile(10) OVER (ORDER BY score, md5(id || '|0'), id) AS band, target FROM scored),
t AS (SELECT band, sum(target) AS bads FROM b GROUP BY 1)
SELECT band, CAST(bads AS BIGINT) AS bads,
  CAST(bads - coalesce(lag(bads) OVER (ORDER BY band), 0) AS BIGINT) AS delta FROM t
""")
def _(spark, d):
    bands = prefix.ntile(scored(spark, d), "score", "id", 10)
    table_ = bands.groupBy(F.col("band").cast("bigint").alias("band")).agg(
        F.sum("target").alias("bads"))
    return prefix.difference(table_, "bads", "band")


RANKS_SQL = f"""round({KS}, 6) AS ks, round(max(abs(cb/tb - cg/tg)), 6) AS ks_two_sided,
  round({AUC}, 6) AS auc, round(2*({AUC}) - 1, 6) AS gini"""


@query("m1_ks", with_sql(SIGNAL_SQL, steps_sql("signal")) + f"""
SELECT round({KS}, 6) AS ks, round(max_by(score, (cb/tb - cg/tg, score)), 6) AS threshold
FROM steps""")
def _(spark, d):
    return r6(metrics.ks(signal(spark, d), "score", "target"), "ks", "threshold")


@query("m1_ks_two_sided", with_sql(SCORED_SQL, steps_sql("scored", "l_linestatus")) + """
SELECT l_linestatus, round(max(abs(cb/tb - cg/tg)), 6) AS ks FROM steps GROUP BY 1""")
def _(spark, d):
    out = metrics.ks(scored(spark, d), "score", "target", ["l_linestatus"], two_sided=True)
    return r6(out, "ks").select("l_linestatus", "ks")


@query("m2_roc_auc", with_sql(SIGNAL_SQL, steps_sql("signal")) + f"""
SELECT round({AUC}, 6) AS auc, round(2*({AUC}) - 1, 6) AS gini FROM steps""")
def _(spark, d):
    return r6(metrics.roc_auc(signal(spark, d), "score", "target"), "auc", "gini")


@query("m2_roc_auc_by_group", with_sql(SIGNAL_SQL, steps_sql("signal", "l_linestatus")) + f"""
SELECT l_linestatus, round({AUC}, 6) AS auc, round(2*({AUC}) - 1, 6) AS gini
FROM steps GROUP BY 1""")
def _(spark, d):
    return r6(metrics.roc_auc(signal(spark, d), "score", "target", ["l_linestatus"]),
              "auc", "gini")


PR_SQL = """SELECT round(sum(b/tb * (cb/(cb+cg) +
  CASE WHEN cb+cg = b+g THEN 1.0 ELSE (cb-b)/nullif(cb+cg-b-g, 0) END)/2.0), 6) AS pr_auc,
  round(sum(b/tb * cb/(cb+cg)), 6) AS average_precision FROM steps"""


@query("m3_pr_auc", with_sql(IMBALANCED_SQL, steps_sql("imbalanced", score="n_chars")) + PR_SQL)
def _(spark, d):
    return r6(metrics.pr_auc(imbalanced(spark, d), "n_chars", "target"),
              "pr_auc", "average_precision")


@query("m4_gini", with_sql(SCORED_SQL, steps_sql("scored")) + f"""
SELECT round(2*({AUC}) - 1, 6) AS gini FROM steps""")
def _(spark, d):
    return r6(metrics.rank_metrics(scored(spark, d), "score", "target"), "gini").select("gini")


CELLS_SQL = """, pred AS (SELECT target AS actual, CAST(prob > 0.5 AS INTEGER) AS predicted
  FROM signal), c AS (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY 1, 2),
rep AS (SELECT label, (SELECT coalesce(sum(n),0) FROM c WHERE actual = label) AS support,
  (SELECT coalesce(sum(n),0) FROM c WHERE predicted = label) AS chosen,
  (SELECT coalesce(sum(n),0) FROM c WHERE predicted = label AND actual = label) AS hit
  FROM (VALUES (0), (1)) v(label)) """


def predicted(spark, d):
    return signal(spark, d).withColumn("prediction", metrics.label_at("prob", 0.5))


@query("m5_weighted_metrics", with_sql(SIGNAL_SQL) + CELLS_SQL + """
SELECT round(sum(hit)/sum(support), 6) AS accuracy,
  round(sum(coalesce(hit/nullif(chosen,0),0)*support)/sum(support), 6) AS weighted_precision,
  round(sum(hit/support*support)/sum(support), 6) AS weighted_recall,
  round(sum(2*hit/(chosen+support)*support)/sum(support), 6) AS f1 FROM rep""")
def _(spark, d):
    out = metrics.weighted_metrics(predicted(spark, d), "target", "prediction")
    return r6(out, *out.columns)


@query("m6_class_report", with_sql(SIGNAL_SQL) + CELLS_SQL + """
SELECT label, round(coalesce(hit/nullif(chosen,0),0), 6) AS precision,
  round(hit/support, 6) AS recall, round(2*hit/(chosen+support), 6) AS f1,
  CAST(support AS BIGINT) AS support FROM rep""")
def _(spark, d):
    out = metrics.class_report(predicted(spark, d), "target", "prediction").drop("hit")
    return r6(out, "precision", "recall", "f1")


@query("m7_label_at", with_sql(SIGNAL_SQL) + """
SELECT CAST(prob > 0.5 AS INTEGER) AS prediction, count(*) AS n FROM signal GROUP BY 1""")
def _(spark, d):
    return predicted(spark, d).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("m8_ks_verdict", with_sql(SIGNAL_SQL, steps_sql("signal", "l_linestatus")) + f"""
SELECT l_linestatus, CASE WHEN ks < .2 THEN 'weak' WHEN ks < .3 THEN 'fair'
  WHEN ks < .5 THEN 'good' ELSE 'very strong' END AS verdict
FROM (SELECT l_linestatus, {KS} AS ks FROM steps GROUP BY 1)""")
def _(spark, d):
    out = metrics.ks(signal(spark, d), "score", "target", ["l_linestatus"])
    return out.select("l_linestatus", metrics.ks_verdict(F.col("ks")).alias("verdict"))


@query("m9_evaluate", with_sql(SIGNAL_SQL) + CELLS_SQL + f""",
{steps_sql("signal", score="prob")},
w AS (SELECT sum(hit)/sum(support) AS accuracy,
  sum(coalesce(hit/nullif(chosen,0),0)*support)/sum(support) AS weighted_precision,
  sum(hit/support*support)/sum(support) AS weighted_recall,
  sum(2*hit/(chosen+support)*support)/sum(support) AS f1 FROM rep),
k AS (SELECT {AUC} AS auc, 2*({AUC})-1 AS gini, {KS} AS ks, sum(b/tb * (cb/(cb+cg) +
  CASE WHEN cb+cg = b+g THEN 1.0 ELSE (cb-b)/nullif(cb+cg-b-g, 0) END)/2.0) AS pr_auc FROM steps)
SELECT metric, round(value, 6) AS value FROM (
  SELECT * FROM (UNPIVOT w ON COLUMNS(*) INTO NAME metric VALUE value)
  UNION ALL SELECT * FROM (UNPIVOT k ON COLUMNS(*) INTO NAME metric VALUE value))""")
def _(spark, d):
    return r6(metrics.evaluate(predicted(spark, d), "target", "prediction", "prob"), "value")


@query("f7_sigmoid", with_sql(SCORED_SQL) + """
SELECT id, round(1/(1+exp(-score)), 6) AS p FROM scored""")
def _(spark, d):
    return scored(spark, d).select("id", F.round(sigmoid(F.col("score")), 6).alias("p"))


@query("k1_confusion_grid", with_sql(SIGNAL_SQL) + """, pred AS (SELECT target AS actual,
  CAST(prob > 2 AS INTEGER) AS predicted FROM signal)
SELECT a AS actual, p AS predicted, (SELECT count(*) FROM pred WHERE actual = a AND predicted = p)
  AS n FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(p)""")
def _(spark, d):
    df = signal(spark, d).withColumn("prediction", metrics.label_at("prob", 2.0))
    return curves.confusion_grid(df, "target", "prediction")


@query("k2_roc_points", with_sql(SIGNAL_SQL, steps_sql("signal")) + """
SELECT score AS threshold, round(cg/tg, 6) AS fpr, round(cb/tb, 6) AS tpr FROM steps""")
def _(spark, d):
    return r6(curves.roc_points(signal(spark, d), "score", "target"), "fpr", "tpr")


@query("k2_roc_thin", with_sql(SIGNAL_SQL, steps_sql("signal")) + """
, p AS (SELECT score AS threshold, cg/tg AS fpr, cb/tb AS tpr FROM steps)
SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM (
 SELECT *, row_number() OVER (PARTITION BY floor(fpr*100) ORDER BY fpr, threshold) AS rn FROM p)
WHERE rn = 1""")
def _(spark, d):
    points = curves.roc_points(signal(spark, d), "score", "target")
    return r6(curves.thin(points, "fpr", 100), "fpr", "tpr")


@query("k3_pr_points", with_sql(SIGNAL_SQL, steps_sql("signal")) + """
SELECT score AS threshold, round(cb/tb, 6) AS recall, round(cb/(cb+cg), 6) AS precision
FROM steps""")
def _(spark, d):
    return r6(curves.pr_points(signal(spark, d), "score", "target"), "recall", "precision")


@query("k4_histogram", with_sql(SIGNAL_SQL) + """
SELECT target, CAST(least(floor((prob - 0.0) / (1.0/30)), 29) AS INTEGER) AS bin, count(*) AS n
FROM signal GROUP BY 1, 2""")
def _(spark, d):
    return curves.score_histogram(signal(spark, d), "prob", "target")


@query("k5_calibration", with_sql(SIGNAL_SQL) + """
SELECT CAST(greatest(ceil(prob*10) - 1, 0) AS INTEGER) AS bin, count(*) AS n,
  round(avg(prob), 6) AS mean_score, round(avg(target), 6) AS positive_rate
FROM signal GROUP BY 1""")
def _(spark, d):
    return r6(curves.calibration(signal(spark, d), "prob", "target"),
              "mean_score", "positive_rate")


@query("k6_ks_curve", with_sql(SIGNAL_SQL, steps_sql("signal")) + """
SELECT score, round(cg/tg, 6) AS cum_good, round(cb/tb, 6) AS cum_bad,
  round(cb/tb - cg/tg, 6) AS difference FROM steps""")
def _(spark, d):
    return r6(curves.ks_curve(signal(spark, d), "score", "target"),
              "cum_good", "cum_bad", "difference")


@query("k7_gain_lift", with_sql(SIGNAL_SQL, steps_sql("signal")) + """
SELECT score AS threshold, round((cg+cb)/(tg+tb), 6) AS population, round(cb/tb, 6) AS gain,
  round(cb/tb/((cg+cb)/(tg+tb)), 4) AS lift FROM steps""")
def _(spark, d):
    out = curves.gain_lift(signal(spark, d), "score", "target")
    return r(out, population=6, gain=6, lift=4)


@query("w7_running_fraction", with_sql(SCORED_SQL, steps_sql("scored", "l_linestatus")) + """
SELECT l_linestatus, score AS threshold, round(cb/tb, 6) AS gain FROM steps""")
def _(spark, d):
    out = curves.gain_lift(scored(spark, d), "score", "target", ["l_linestatus"])
    return r6(out, "gain").select("l_linestatus", "threshold", "gain")


# Scorecard -----------------------------------------------------------------------------------
BANDS_SQL = """, banded AS (SELECT id, target, score,
  ntile(10) OVER (ORDER BY score, md5(id || '|0'), id) AS band FROM signal),
bt AS (SELECT band, min(score) AS min_score, max(score) AS max_score, count(*) AS total,
  count(*) FILTER (target = 0) AS goods, count(*) FILTER (target = 1) AS bads,
  avg(score) AS mean_score FROM banded GROUP BY 1),
bands AS (SELECT *, bads/total AS pd, CASE WHEN goods > 0 AND bads > 0
  THEN ln((1 - bads/total)/(bads/total)) END AS log_odds FROM bt)"""


def banded(spark, d):
    return scorecard.score_bands(signal(spark, d), "score", "id").withColumn(
        "band", F.col("band").cast("bigint"))


@query("b1_score_bands", with_sql(SIGNAL_SQL) + BANDS_SQL + "SELECT id, band FROM banded")
def _(spark, d):
    return banded(spark, d).select("id", "band")


@query("b2_band_table", with_sql(SIGNAL_SQL) + BANDS_SQL + """
SELECT band, min_score, max_score, total, goods, bads, round(mean_score, 6) AS mean_score,
  round(pd, 6) AS pd, round(log_odds, 6) AS log_odds FROM bands""")
def _(spark, d):
    return r6(scorecard.band_table(banded(spark, d), "score", "target"),
              "mean_score", "pd", "log_odds")


@query("b3_align_score", with_sql(SIGNAL_SQL) + BANDS_SQL + """
, line AS (SELECT regr_slope(log_odds, mean_score) AS b, regr_intercept(log_odds, mean_score) AS a
  FROM bands) SELECT id, round(a + b*score, 5) AS aligned FROM signal, line""")
def _(spark, d):
    df = signal(spark, d)
    bands = scorecard.band_table(banded(spark, d), "score", "target")
    return r(scorecard.align_score(df, bands, "score"), aligned=5).select("id", "aligned")


BAND_STEPS = steps_sql("banded", "band")


@query("b4_band_metrics", with_sql(SIGNAL_SQL) + BANDS_SQL + f""", {BAND_STEPS}
SELECT band, CASE WHEN max(tg) > 0 AND max(tb) > 0 THEN round({KS}, 6) END AS ks,
  round({AUC}, 6) AS auc, round(2*({AUC}) - 1, 6) AS gini FROM steps GROUP BY 1""")
def _(spark, d):
    out = scorecard.band_metrics(banded(spark, d), "score", "target", ascending=False)
    return r6(out, "ks", "auc", "gini")


SCORECARD_SQL = f""", {BAND_STEPS}, bm AS (SELECT band,
  CASE WHEN max(tg) > 0 AND max(tb) > 0 THEN {KS} END AS ks,
  {AUC} AS auc, 2*({AUC}) - 1 AS gini FROM steps GROUP BY 1),
card AS (SELECT CAST(band AS VARCHAR) AS band, printf('%.1f - %.1f', round(min_score, 1), round(max_score, 1)) AS label,
  CAST(goods AS DOUBLE) AS goods, CAST(bads AS DOUBLE) AS bads, CAST(total AS DOUBLE) AS total,
  pd, ks, auc, gini FROM bands LEFT JOIN bm USING (band)),
allrows AS (SELECT * FROM card UNION ALL SELECT 'MEAN', 'MEAN', avg(goods), avg(bads), avg(total),
  avg(pd), avg(ks), avg(auc), avg(gini) FROM card)
SELECT band, label, goods, bads, total, round(pd, 6) AS pd, round(ks, 6) AS ks,
  round(auc, 6) AS auc, round(gini, 6) AS gini FROM allrows"""


@query("b5_scorecard", with_sql(SIGNAL_SQL) + BANDS_SQL + SCORECARD_SQL)
def scorecard_query(spark, d):
    return r6(scorecard.scorecard(banded(spark, d), "score", "target"), "pd", "ks", "auc", "gini")


CUM_SQL = """, cum AS (SELECT band, sum(goods) OVER (ORDER BY band) / sum(goods) OVER () AS cg,
  sum(bads) OVER (ORDER BY band) / sum(bads) OVER () AS cb FROM bands),
prev AS (SELECT *, coalesce(lag(cg) OVER (ORDER BY band), 0) AS pg,
  coalesce(lag(cb) OVER (ORDER BY band), 0) AS pb FROM cum)"""


@query("b6_partial_gini", with_sql(SIGNAL_SQL) + BANDS_SQL + CUM_SQL + """
SELECT band, round(cg, 6) AS cum_goods, round(cb, 6) AS cum_bads,
  round((cb+pb)*(cg-pg)/2, 6) AS partial_auc,
  round((cb+pb)*(cg-pg) - (cb-pb), 6) AS partial_gini FROM prev""")
def _(spark, d):
    out = scorecard.partial_gini(scorecard.band_table(banded(spark, d), "score", "target"))
    return r6(out, "cum_goods", "cum_bads", "partial_auc", "partial_gini")


@query("b7_band_ks", with_sql(SIGNAL_SQL) + BANDS_SQL + CUM_SQL + """
SELECT band, round(cg, 6) AS cum_goods, round(cb, 6) AS cum_bads, round(abs(cg-cb), 6) AS ks
FROM prev""")
def _(spark, d):
    out = scorecard.band_cumulative(scorecard.band_table(banded(spark, d), "score", "target"))
    return r6(out, "cum_goods", "cum_bads", "ks").select("band", "cum_goods", "cum_bads", "ks")
