"""Queries on scans, projections, joins, aggregates, sorts, samples, sets and scalars."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from scoreflow.catalog.frames import (CREDIT_SQL, IMBALANCED_SQL, MISSING_SQL, NUMERIC,
                                      SCORED_SQL, TEXT, TEXT_NUMBERS_SQL, credit, imbalanced,
                                      missing, scored, table, text_numbers, with_sql)
from scoreflow.catalog.registry import query
from scoreflow.functions import core
from scoreflow.functions.core import hashed, month_of
from scoreflow.operators import frame, metrics, profile, sampling, sets
from scoreflow.operators.scorecard import with_mean_row
from scoreflow.sources import tables

CREDIT = with_sql(CREDIT_SQL)
MISSING = with_sql(MISSING_SQL)


def r6(df, *cols):
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def scratch(spark, name):
    """A fresh folder below the shared checkpoint folder of the session."""
    root = core.shared_folder(spark)
    return posixpath.join(root, f"{name}-{uuid.uuid4().hex}")


# Scans and sinks -----------------------------------------------------------------------------
@query("s1_parquet_scan", """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY 1""")
def _(spark, d):
    return tables.read_parquet(spark, f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("s2_table_scan", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("scoreflow_customer")
    return tables.read_table(spark, "scoreflow_customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"))


@query("s3_s6_csv_round_trip", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    path = scratch(spark, "csv")
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    tables.write_csv(df, path)
    return tables.read_csv(spark, path, "c_custkey long, c_acctbal double, c_mktsegment string")


@query("s3_csv_inferred", "SELECT CAST(sum(c_nationkey) AS BIGINT) AS k, count(*) AS n FROM customer")
def _(spark, d):
    path = scratch(spark, "csv")
    tables.write_csv(table(spark, d, "customer"), path)
    return tables.read_csv(spark, path).agg(F.sum("c_nationkey").alias("k"),
                                            F.count(F.lit(1)).alias("n"))


@query("s5_parquet_round_trip", with_sql(SCORED_SQL) + """
SELECT l_linestatus, count(*) AS n, CAST(sum(target) AS BIGINT) AS bads FROM scored GROUP BY 1""")
def _(spark, d):
    path = scratch(spark, "parquet")
    tables.write_parquet(scored(spark, d), path, partition_by=["l_linestatus"])
    return tables.read_parquet(spark, path).groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").alias("bads"))


@query("s10_prediction_sample", with_sql(SCORED_SQL) + """
SELECT id, target, score FROM scored ORDER BY id LIMIT 1000""")
def _(spark, d):
    return tables.prediction_sample(scored(spark, d).select("id", "target", "score"), "id")


STATS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, "
    f"round(stddev({c}), 4) AS stddev, CAST(min({c}) AS DOUBLE) AS min, "
    f"CAST(max({c}) AS DOUBLE) AS max FROM credit" for c in NUMERIC)


@query("s11_summary_artifact", CREDIT + STATS_SQL)
def _(spark, d):
    out = tables.summary_artifact(credit(spark, d).select(*NUMERIC), scratch(spark, "summary"))
    return out.withColumns({c: F.round(F.col(c), 4) for c in ("mean", "stddev")})


# Projections and filters ---------------------------------------------------------------------
@query("p1_subset", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(spark, d):
    return frame.subset(table(spark, d, "lineitem"), ["l_orderkey", "l_quantity"])


@query("p2_derive", """SELECT l_orderkey, l_linenumber AS line,
 round(l_extendedprice*(1-l_discount), 6) AS net FROM lineitem""")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                            "l_discount")
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6)
    return frame.derive(df, {"net": net}, {"l_linenumber": "line"},
                        ["l_extendedprice", "l_discount"])


@query("p3_is_missing", MISSING + """SELECT count(*) FILTER (l_tax IS NULL) AS tax,
 count(*) FILTER (o_orderpriority IS NULL) AS priority FROM missing""")
def _(spark, d):
    df = missing(spark, d)
    # Half of the missing taxes as NaN: both kinds count.
    nan = F.when(F.col("l_tax").isNull() & (F.col("target") == 1), F.lit(float("nan")))
    df = df.withColumn("l_tax", F.coalesce("l_tax", nan))
    return df.agg(F.count_if(core.is_missing(df, "l_tax")).alias("tax"),
                  F.count_if(core.is_missing(df, "o_orderpriority")).alias("priority"))


@query("p4_class_filter", with_sql(SCORED_SQL) + "SELECT id, score FROM scored WHERE target = 1")
def _(spark, d):
    return frame.of_class(scored(spark, d), "target", 1).select("id", "score")


@query("p5_month_groups", """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n
FROM orders GROUP BY 1""")
def _(spark, d):
    return table(spark, d, "orders").groupBy(month_of("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p6_membership", """SELECT o_orderkey FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN
 (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(spark, d):
    building = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    urgent = frame.among(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return frame.among(urgent, "o_custkey", building.select("c_custkey")).select("o_orderkey")


@query("p7_column_types", MISSING + """SELECT n.name AS feature, n.kind, m.total AS n_rows
FROM (VALUES ('id','string'),('target','numeric'),('date','other'),('l_quantity','numeric'),
('l_extendedprice','numeric'),('l_discount','numeric'),('l_tax','numeric'),
('o_totalprice','numeric'),('c_acctbal','numeric'),('l_linestatus','string'),
('o_orderpriority','string'),('c_mktsegment','string'),('rare','numeric'),('flat','numeric'))
n(name, kind), (SELECT count(*) AS total FROM missing) m""")
def _(spark, d):
    df = missing(spark, d)
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return profile.column_types(df).withColumn("n_rows", total)


@query("p8_drop_missing", MISSING + """SELECT id, l_tax, o_orderpriority FROM missing
WHERE l_tax IS NOT NULL AND o_orderpriority IS NOT NULL""")
def _(spark, d):
    return frame.drop_missing(missing(spark, d), ["l_tax", "o_orderpriority"]).select(
        "id", "l_tax", "o_orderpriority")


@query("p9_fill_missing", MISSING + """SELECT id, coalesce(l_tax, -1.0) AS l_tax,
 coalesce(o_orderpriority, 'none') AS o_orderpriority FROM missing""")
def _(spark, d):
    out = frame.fill_missing(missing(spark, d), {"l_tax": -1.0, "o_orderpriority": "none"})
    return out.select("id", "l_tax", "o_orderpriority")


@query("p10_top_per_group", CREDIT + """SELECT c_mktsegment, id, rn FROM (
 SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY l_extendedprice DESC, id) AS rn
 FROM credit) WHERE rn <= 3""")
def _(spark, d):
    out = frame.top_per_group(credit(spark, d), ["c_mktsegment"],
                              [F.col("l_extendedprice").desc(), F.col("id")], 3)
    return out.select("c_mktsegment", "id", F.col("rn").cast("bigint").alias("rn"))


@query("p11_require_frame", """SELECT 'lineitem' AS name, true AS accepted, count(*) AS n FROM lineitem
UNION ALL SELECT 'orders', true, count(*) FROM orders UNION ALL SELECT 'rows of nation', false, count(*) FROM nation""")
def _(spark, d):
    """Frames pass the check and are counted; a list of rows in place of a frame is refused."""
    counted = []
    for name in ("lineitem", "orders", "nation"):
        found = table(spark, d, name)
        try:
            core.require_frame(found.collect() if name == "nation" else found, name)  # nations are a fixed table
        except TypeError:
            name, accepted = f"rows of {name}", False
        else:
            accepted = True
        counted.append(found.select(F.lit(name).alias("name"), F.lit(accepted).alias("accepted")).groupBy(
            "name", "accepted").agg(F.count(F.lit(1)).alias("n")))
    return sets.stack_by_name(*counted)


@query("p12_skip_invalid", MISSING + """SELECT count(*) AS n FROM missing
WHERE l_tax IS NOT NULL AND l_quantity IS NOT NULL""")
def _(spark, d):
    from scoreflow.operators.encode import assemble

    out = assemble(missing(spark, d), ["l_tax", "l_quantity", "l_discount"], invalid="skip")
    return out.agg(F.count(F.lit(1)).alias("n"))


# Joins ---------------------------------------------------------------------------------------
@query("j1_counts_with_totals", CREDIT + """,
c AS (SELECT c_mktsegment, o_orderpriority, target, count(*) AS n FROM credit GROUP BY 1, 2, 3),
t AS (SELECT c_mktsegment, o_orderpriority, sum(n) AS total FROM c GROUP BY 1, 2)
SELECT c_mktsegment, o_orderpriority, target, n, round(n/total, 6) AS share
FROM c JOIN t USING (c_mktsegment, o_orderpriority)""")
def _(spark, d):
    from pyspark.sql import Window

    keys = ["c_mktsegment", "o_orderpriority"]
    counts = credit(spark, d).groupBy(*keys, "target").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("share", F.round(share, 6))


@query("j3_left_join", CREDIT + """,
a AS (SELECT c_mktsegment, count(*) AS n FROM credit GROUP BY 1),
b AS (SELECT c_mktsegment, count(*) AS urgent FROM credit
      WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_mktsegment, n, urgent FROM a LEFT JOIN b USING (c_mktsegment)""")
def _(spark, d):
    df = credit(spark, d)
    a = df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    b = df.filter(F.col("o_orderpriority") == "1-URGENT").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("urgent"))
    return frame.left_with(a, b, ["c_mktsegment"])


@query("j5_changed_rows", MISSING + """SELECT id, coalesce(l_tax, 0.5) AS l_tax FROM missing
WHERE l_tax IS NULL""")
def _(spark, d):
    before = missing(spark, d).select("id", "l_tax")
    after = frame.fill_missing(before, {"l_tax": 0.5})
    return frame.changed_rows(before, after, "id", ["l_tax"])


@query("j6_predictions_back", MISSING + """SELECT id,
 CASE WHEN l_tax IS NULL THEN round(l_discount/2, 4) ELSE l_tax END AS l_tax FROM missing""")
def _(spark, d):
    df = missing(spark, d).select("id", "l_tax", "l_discount")
    guess = df.filter(F.col("l_tax").isNull()).select(
        "id", F.round(F.col("l_discount") / 2, 4).alias("guess"))
    return frame.left_with(df, guess, ["id"]).select(
        "id", F.coalesce("l_tax", "guess").alias("l_tax"))


@query("j_salted_join", CREDIT + """SELECT l_linestatus, count(*) AS n,
 round(sum(l_quantity * w), 2) AS weighted FROM credit
 JOIN (SELECT l_linestatus, avg(l_tax) AS w FROM credit GROUP BY 1) USING (l_linestatus)
 GROUP BY 1""")
def _(spark, d):
    df = credit(spark, d)
    means = df.groupBy("l_linestatus").agg(F.avg("l_tax").alias("w"))
    return frame.salted_join(df, means, ["l_linestatus"], F.col("id")).groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("w")), 2)
        .alias("weighted"))


# Aggregates ----------------------------------------------------------------------------------
@query("a1_class_counts", CREDIT + """SELECT c_mktsegment, count(*) FILTER (target = 0) AS goods,
 count(*) FILTER (target = 1) AS bads, count(*) AS n FROM credit GROUP BY 1""")
def _(spark, d):
    return metrics.class_counts(credit(spark, d), "target", ["c_mktsegment"])


@query("a2_class_balance", with_sql(IMBALANCED_SQL) + """SELECT target, count(*) AS n,
 round(max(count(*)) OVER () / sum(count(*)) OVER (), 6) AS majority_share,
 max(count(*)) OVER () / sum(count(*)) OVER () > 0.8 AS imbalanced FROM imbalanced GROUP BY 1""")
def _(spark, d):
    return r6(metrics.class_balance(imbalanced(spark, d), "target"), "majority_share")


@query("a3_class_profile", CREDIT + """SELECT target, count(l_quantity) AS n,
 round(avg(l_quantity), 6) AS mean, round(stddev(l_quantity), 6) AS stddev,
 min(l_quantity) AS min, max(l_quantity) AS max FROM credit GROUP BY 1""")
def _(spark, d):
    return r6(metrics.class_profile(credit(spark, d), "l_quantity", "target"), "mean", "stddev")


@query("a4_describe", CREDIT + STATS_SQL)
def _(spark, d):
    out = profile.describe(credit(spark, d), NUMERIC)
    return out.withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4),
                            "n": F.col("n").cast("bigint")})


@query("a5_confusion", with_sql(SCORED_SQL) + """SELECT target AS actual,
 CAST(score > 0.8 AS INTEGER) AS predicted, count(*) AS n FROM scored GROUP BY 1, 2""")
def _(spark, d):
    df = scored(spark, d).withColumn("prediction", metrics.label_at("score", 0.8))
    return metrics.confusion(df, "target", "prediction")


@query("a6_distinct_months", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(month_of("o_orderdate").alias("month")).distinct()


MISS_COLS = ["id", "target", "date", *NUMERIC, *TEXT, "rare", "flat"]


@query("a9_missing_profile", MISSING + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, "
    f"round((count(*) - count({c}))/count(*), 6) AS missing_ratio FROM missing"
    for c in MISS_COLS))
def _(spark, d):
    return r6(profile.missing_profile(missing(spark, d), MISS_COLS), "missing_ratio")


MODE_COLS = ["target", *NUMERIC, *TEXT, "rare", "flat"]


def _mode_sql(c):
    return (f"SELECT * FROM (SELECT '{c}' AS feature, n AS mode_count, "
            f"round(n / (SELECT count(*) FROM missing), 6) AS mode_share, "
            f"count(*) OVER () AS n_distinct FROM (SELECT {c}, count(*) AS n FROM missing "
            f"WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, {c} LIMIT 1)")


@query("a10_mode_profile", MISSING + " UNION ALL ".join(_mode_sql(c) for c in MODE_COLS))
def _(spark, d):
    out = profile.mode_profile(missing(spark, d), MODE_COLS)
    return r6(out, "mode_share").select("feature", "mode_count", "mode_share", "n_distinct")


@query("a10_mode_value", CREDIT + """SELECT 'c_mktsegment' AS feature, c_mktsegment AS mode
FROM (SELECT c_mktsegment, count(*) AS n FROM credit GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)""")
def _(spark, d):
    return profile.mode_profile(credit(spark, d), ["c_mktsegment"]).select("feature", "mode")


@query("a11_distinct_counts", MISSING + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM missing"
    for c in [*NUMERIC, *TEXT]))
def _(spark, d):
    return profile.distinct_counts(missing(spark, d), [*NUMERIC, *TEXT])


@query("a12_medians", MISSING + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(median({c}), 6) AS median FROM missing" for c in NUMERIC))
def _(spark, d):
    return r6(profile.medians(missing(spark, d), NUMERIC), "median")


@query("a13_quantiles", CREDIT + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({p} AS DOUBLE) AS prob, round(quantile_cont({c}, {p}), 6) AS value "
    f"FROM credit" for c in NUMERIC for p in (0.05, 0.25, 0.5, 0.9)))
def _(spark, d):
    return r6(profile.column_quantiles(credit(spark, d), NUMERIC, [0.05, 0.25, 0.5, 0.9]),
              "value")


@query("a13_quantiles_approximate")
def _(spark, d):
    return profile.column_quantiles(credit(spark, d), NUMERIC, [0.25, 0.5, 0.75], 0.01)


@query("a15_mean_row", CREDIT + """, t AS (SELECT c_mktsegment, CAST(count(*) AS DOUBLE) AS n,
 avg(l_quantity) AS qty FROM credit GROUP BY 1)
SELECT c_mktsegment, n, round(qty, 6) AS qty FROM t
UNION ALL SELECT 'MEAN', avg(n), round(avg(qty), 6) FROM t""")
def _(spark, d):
    t = credit(spark, d).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("l_quantity").alias("qty"))
    return r6(with_mean_row(t, "c_mktsegment"), "qty")


@query("w5_one_random_per_group", """SELECT o_custkey, max_by(o_orderkey, md5(
 CAST(o_orderkey AS VARCHAR) || '|3')) AS o_orderkey FROM orders GROUP BY 1""")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", hashed("o_orderkey", 3)).alias("o_orderkey"))


# Sorts, samples, splits ----------------------------------------------------------------------
@query("l1_order_by", """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
GROUP BY 1, 2 ORDER BY 1, 2""")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n")).orderBy("l_returnflag", "l_linestatus")


@query("l2_argmax", """SELECT c_mktsegment, min_by(c_custkey, (-c_acctbal, c_custkey)) AS c_custkey,
 max(c_acctbal) AS c_acctbal FROM customer GROUP BY 1""")
def _(spark, d):
    return frame.argmax(table(spark, d, "customer"), "c_custkey", "c_acctbal", ["c_mktsegment"])


@query("l5_digit_rate", with_sql(TEXT_NUMBERS_SQL) + """SELECT round(avg(CASE WHEN
 regexp_full_match(replace(replace(replace(mixed,'.',''),',',''),'-',''), '[0-9]+')
 AND (contains(mixed, '.') OR contains(mixed, ',')) THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM text_numbers""")
def _(spark, d):
    from scoreflow.operators.clean import marked_number

    df = text_numbers(spark, d)
    return df.agg(F.round(F.avg(marked_number(F.col("mixed")).cast("double")), 6).alias("rate"))


@query("l6_sample_rows", with_sql(SCORED_SQL) + """SELECT id, target FROM scored
ORDER BY md5(id || '|42'), id LIMIT 5000""")
def _(spark, d):
    return sampling.sample_rows(scored(spark, d).select("id", "target"), "id", 5000)


@query("l7_sample_size", """SELECT CAST(ceil(n0/(1+(n0-1)/n)) AS BIGINT) AS size
FROM (SELECT pow(1.959963984540054, 2)*0.25/0.0025 AS n0), (SELECT count(*) AS n FROM lineitem)""")
def _(spark, d):
    size = sampling.sample_size(table(spark, d, "lineitem").count())
    return tables.from_rows(spark, [(size,)], "size long")


def _quota_sql(frame_, key, n):
    return f""", m AS (SELECT *, strftime(date, '%Y-%m') AS month FROM {frame_}),
sk AS (SELECT max(n)/sum(n) > 0.8 AS skewed FROM (SELECT count(*) AS n FROM m GROUP BY target)),
rk AS (SELECT id, month, target, row_number() OVER (PARTITION BY month, target
   ORDER BY md5(id || '|42'), id) AS rc, count(*) OVER (PARTITION BY month, target) AS nc,
   row_number() OVER (PARTITION BY month ORDER BY md5(id || '|42'), id) AS rm,
   count(*) OVER () AS total FROM m),
mm AS (SELECT count(DISTINCT month) AS months FROM m)
SELECT id, target FROM rk, sk, mm WHERE CASE WHEN skewed THEN rc <=
  CASE WHEN target = 1 THEN greatest(1, nc*{n}//total) ELSE nc*{n}//total END
  ELSE rm <= {n}//months END"""


@query("l8_stratified_balanced", CREDIT + _quota_sql("credit", "id", 2000))
def _(spark, d):
    df = core.stored(credit(spark, d).select("id", "date", "target"))
    return sampling.stratified_sample(df, "id", "date", "target", 2000).select("id", "target")


RARE_SQL = f"""{CREDIT_SQL}, rare AS (SELECT id, date,
 CAST(l_discount = 0.1 AS INTEGER) AS target FROM credit)"""


@query("l8_stratified_imbalanced", with_sql(RARE_SQL) + _quota_sql("rare", "id", 2000))
def _(spark, d):
    df = core.stored(credit(spark, d).select("id", "date", (F.col("l_discount") == 0.1).cast("int")
                                             .alias("target")))
    return sampling.stratified_sample(df, "id", "date", "target", 2000).select("id", "target")


@query("l9_split", with_sql(SCORED_SQL) + """SELECT id,
 CASE WHEN substr(md5(id || '|42'), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS part
FROM scored""")
def _(spark, d):
    train, test = sampling.split(scored(spark, d), "id", 0.2)
    return sets.stack_by_name(train.select("id", F.lit("train").alias("part")),
                              test.select("id", F.lit("test").alias("part")))


@query("l9_split_stratified", with_sql(SCORED_SQL) + """SELECT id, CASE WHEN
 row_number() OVER (PARTITION BY target ORDER BY md5(id || '|42'), id)
 <= round(count(*) OVER (PARTITION BY target) * 0.2) THEN 'test' ELSE 'train' END AS part
FROM scored""")
def _(spark, d):
    train, test = sampling.split(scored(spark, d), "id", 0.2, stratify="target")
    return sets.stack_by_name(train.select("id", F.lit("train").alias("part")),
                              test.select("id", F.lit("test").alias("part")))


@query("l10_bernoulli", with_sql(CREDIT_SQL) + """SELECT id FROM credit WHERE CAST('0x' ||
 substr(md5(id || '|42'), 1, 8) AS BIGINT) / 4294967296.0 < least(0.01, 100000.0 / (SELECT count(*) FROM credit))""")
def _(spark, d):
    return sampling.bernoulli(credit(spark, d), "id").select("id")


@query("t12_fold", with_sql(SCORED_SQL) + """SELECT id, CAST(CAST('0x' ||
 substr(md5(id || '|42'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM scored""")
def _(spark, d):
    return scored(spark, d).select("id", sampling.fold_of("id", 5).alias("fold"))


# Sets ----------------------------------------------------------------------------------------
@query("u1_union_by_name", """SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier
UNION ALL SELECT c_custkey, c_acctbal FROM customer""")
def _(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"),
                                           F.col("s_acctbal").alias("bal"))
    b = table(spark, d, "customer").select(F.col("c_acctbal").alias("bal"),
                                           F.col("c_custkey").alias("k"))
    return sets.stack_by_name(a, b)


@query("u2_union_by_position", """SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier
UNION ALL SELECT c_custkey, c_acctbal FROM customer""")
def _(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"),
                                           F.col("s_acctbal").alias("bal"))
    return sets.stack_by_position(a, table(spark, d, "customer").select("c_custkey", "c_acctbal"))


@query("u3_compare_features", """WITH a AS (SELECT DISTINCT source FROM documents
 WHERE lang = 'en'), b AS (SELECT DISTINCT source FROM documents WHERE lang = 'de')
SELECT source, CASE WHEN b.source IS NULL THEN 'only_a' WHEN a.source IS NULL THEN 'only_b'
 ELSE 'both' END AS "where" FROM a FULL JOIN b USING (source)""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return sets.compare_features(docs.filter(F.col("lang") == "en"),
                                 docs.filter(F.col("lang") == "de"), "source")


@query("u4_presence", """SELECT source, bool_or(lang = 'en') AS en, bool_or(lang = 'de') AS de,
 bool_or(lang = 'fr') AS fr, bool_or(lang = 'es') AS es FROM documents GROUP BY 1""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return sets.presence(docs, ["en", "de", "fr", "es"], "lang", "source")


# Scalars -------------------------------------------------------------------------------------
@query("f1_text_functions", with_sql(TEXT_NUMBERS_SQL) + """SELECT id,
 regexp_replace(cur, '^R\\$ ?', '') AS bare, starts_with(neg, '-') AS negative,
 regexp_matches(pct, '%$') AS percent, trim(' ' || br || ' ') AS trimmed FROM text_numbers""")
def _(spark, d):
    return text_numbers(spark, d).select(
        "id", F.regexp_replace("cur", r"^R\$ ?", "").alias("bare"),
        F.col("neg").startswith("-").alias("negative"), F.col("pct").rlike("%$").alias("percent"),
        F.trim(F.concat(F.lit(" "), "br", F.lit(" "))).alias("trimmed"))


@query("f2_digit_tests", with_sql(TEXT_NUMBERS_SQL) + """SELECT id,
 regexp_full_match(replace(us, ',', ''), '[0-9]+\\.[0-9]+') AS plain,
 contains(br, ',') AS has_comma FROM text_numbers""")
def _(spark, d):
    return text_numbers(spark, d).select(
        "id", F.replace("us", F.lit(","), F.lit("")).rlike(r"^[0-9]+\.[0-9]+$").alias("plain"),
        F.contains("br", F.lit(",")).alias("has_comma"))


@query("f3_band_label", """SELECT c_mktsegment, printf('%.1f - %.1f',
 round(min(c_acctbal), 1), round(max(c_acctbal), 1)) AS label FROM customer GROUP BY 1""")
def _(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        core.band_label(F.min("c_acctbal"), F.max("c_acctbal")).alias("label"))


@query("f14_vector_step", """SELECT vec_id, round(list_sum(list_transform(range(1, 65),
 lambda i: CAST(embedding[i] AS DOUBLE) + 0.25*(CAST(embedding[65 - i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)))), 6)
 AS total, round(CAST(embedding[1] AS DOUBLE) + 0.25*(CAST(embedding[64] AS DOUBLE) - CAST(embedding[1] AS DOUBLE)), 6)
 AS first FROM embeddings""")
def _(spark, d):
    """A quarter of the way from each vector to its mirror image."""
    v = F.col("embedding").cast("array<double>")
    moved = core.add_vectors(v, core.scaled_difference(v, F.reverse(v), F.lit(0.25)))
    total = F.aggregate("m", F.lit(0.0), lambda t, x: t + x)
    return table(spark, d, "embeddings").withColumn("m", moved).select(
        "vec_id", F.round(total, 6).alias("total"), F.round(F.col("m")[0], 6).alias("first"))


@query("f4_join_list", """SELECT string_agg(month, ',' ORDER BY month) AS baseline FROM
 (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)""")
def _(spark, d):
    months = table(spark, d, "orders").select(month_of("o_orderdate").alias("m")).distinct()
    return months.agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("baseline"))


@query("f5_month", "SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", month_of("ts").alias("month"))


@query("f6_math", """SELECT event_id, round(ln(value), 6) AS ln, round(sqrt(value), 6) AS root,
 abs(value - 100) AS gap, CAST(ceil(value) AS BIGINT) AS up,
 round(100 / nullif(value - 0.01, 0), 6) AS per FROM events""")
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", F.round(F.log(v), 6).alias("ln"), F.round(F.sqrt(v), 6).alias("root"),
        F.abs(v - 100).alias("gap"), F.ceil(v).alias("up"),
        F.round(core.ratio(F.lit(100), v - 0.01), 6).alias("per"))


@query("f8_conditional", """SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 100
 THEN 'mid' ELSE 'high' END AS size FROM events""")
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", F.when(v < 10, "low").when(v < 100, "mid").otherwise("high").alias("size"))


@query("f9_edge_bin", MISSING + """SELECT id, CAST(CASE WHEN l_tax IS NULL THEN -1
 ELSE (l_tax > 0.02)::INT + (l_tax > 0.05)::INT + (l_tax > 0.07)::INT END AS INTEGER) AS bin
FROM missing""")
def _(spark, d):
    edges = F.array(F.lit(0.02), F.lit(0.05), F.lit(0.07))
    return missing(spark, d).select("id", core.edge_bin(F.col("l_tax"), edges).alias("bin"))


@query("f10_equal_width_bin", """SELECT event_id, CAST(least(floor((value - lo)/((hi - lo)/10.0)), 9)
 AS INTEGER) AS bin FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)""")
def _(spark, d):
    df = table(spark, d, "events")
    ends = df.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("e"))
    return df.withColumn("e", ends.scalar()).select(
        "event_id", core.equal_width_bin(F.col("value"), F.col("e.lo"), F.col("e.hi"), 10)
        .alias("bin"))


@query("f11_safe_cast", with_sql(TEXT_NUMBERS_SQL) + """SELECT id,
 TRY_CAST(replace(replace(mixed, '.', ''), ',', '.') AS DOUBLE) AS value FROM text_numbers""")
def _(spark, d):
    plain = F.translate("mixed", ",.", ".")
    return text_numbers(spark, d).select("id", plain.try_cast("double").alias("value"))


@query("f12_uniform", with_sql(SCORED_SQL) + """SELECT id, round(CAST('0x' ||
 substr(md5(id || '|5'), 1, 8) AS BIGINT) / 4294967296.0, 6) AS u FROM scored""")
def _(spark, d):
    return scored(spark, d).select("id", F.round(core.uniform("id", 5), 6).alias("u"))
