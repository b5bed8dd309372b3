"""Queries on column repair, encoding, association and stability."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreflow.catalog.frames import (CREDIT_SQL, IMBALANCED_SQL, MISSING_SQL, NUMERIC, TEXT,
                                      TEXT_NUMBERS_SQL, credit, imbalanced, missing, table,
                                      text_numbers, with_sql)
from scoreflow.catalog.registry import query
from scoreflow.functions.core import edge_bin, month_of
from scoreflow.operators import association, clean, encode, profile, sampling, stability

CREDIT, MISSING, NUMBERS = with_sql(CREDIT_SQL), with_sql(MISSING_SQL), with_sql(TEXT_NUMBERS_SQL)
SAME_PRICE = ["us", "br", "neg", "cur"]


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# Column repair -------------------------------------------------------------------------------
@query("v1_convert_numeric_strings", NUMBERS + """SELECT id, price AS br, -price AS neg,
 cur, mixed FROM text_numbers""")
def _(spark, d):
    df = text_numbers(spark, d).select("id", "br", "neg", "cur", "mixed")
    return clean.convert_numeric_strings(df)


@query("v2_convert_numeric_columns", NUMBERS + """SELECT id, price AS us, price AS br, -price AS neg,
 price AS cur, round(l_discount, 6) AS pct, mixed FROM text_numbers""")
def _(spark, d):
    df = text_numbers(spark, d).select("id", "us", "br", "neg", "cur", "pct", "mixed")
    return rounded(clean.convert_numeric_columns(df), 6, "pct")


def _examples_sql(x, number):
    picks = [f"min({x})", f"max({x})", f"arg_min({x}, md5({x}))", f"arg_max({x}, md5({x}))",
             f"arg_min({x}, md5(reverse({x})))"][:number]
    return f"coalesce(array_to_string(list_sort(list_distinct([{', '.join(picks)}])), '|'), '')"


@query("v3_conversion_report", NUMBERS + f""", v AS (SELECT 'br' AS c, br AS v FROM text_numbers
 UNION ALL SELECT 'mixed', mixed FROM text_numbers UNION ALL SELECT 'cur', cur FROM text_numbers),
 h AS (SELECT *, CASE WHEN regexp_full_match(translate(v, '.,-', ''), '[0-9]+')
   AND (contains(v, '.') OR contains(v, ',')) THEN v END AS x FROM v)
SELECT c AS feature, count(*) AS total, count(x) AS numeric, round(count(x) / count(*), 6) AS rate,
 count(x) / count(*) > 0.8 AS converted, {_examples_sql('x', 3)} AS examples FROM h GROUP BY 1""")
def _(spark, d):
    df = text_numbers(spark, d).select("br", "mixed", "cur")
    return rounded(clean.numeric_string_report(df), 6, "rate").withColumn(
        "examples", F.array_join("examples", "|"))


def _format_sql(c, mark):
    kind = "CASE " + " ".join(f"WHEN regexp_matches(trim({c}), '{p}') THEN '{k}'" for k, p in clean.FORMATS.items())
    counts = ", ".join(f"count(*) FILTER (k = '{k}') AS {k}" for k in clean.FORMATS)
    x = f"(CASE WHEN k IS NOT NULL THEN {c} END)"
    return f"""SELECT '{c}' AS feature, count(*) AS total, count(k) AS numeric, count(*) - count(k) AS not_numeric,
 {counts}, round(count(k) / count(*), 6) AS rate, '{mark}' AS decimal_mark, {_examples_sql(x, 5)} AS examples,
 CASE WHEN count(k) / count(*) <= 0.7 THEN 'ignored' ELSE 'converted' END AS outcome
FROM (SELECT {c}, {kind} END AS k FROM text_numbers)"""


@query("v3_format_report", NUMBERS + " UNION ALL ".join(
    _format_sql(c, m) for c, m in (("pct", "."), ("cur", ","), ("mixed", ","))))
def _(spark, d):
    out = clean.numeric_column_report(text_numbers(spark, d).select("pct", "cur", "mixed"))
    return rounded(out.drop("new_null_rate"), 6, "rate").withColumn(
        "examples", F.array_join("examples", "|"))


@query("v4_has_missing", MISSING + """SELECT bool_or(l_tax IS NULL) AS tax,
 bool_or(l_discount IS NULL) AS discount FROM missing""")
def _(spark, d):
    df = missing(spark, d)
    return spark.createDataFrame(
        [(profile.has_missing(df, ["l_tax"]), profile.has_missing(df, ["l_discount"]))],
        "tax boolean, discount boolean")


V5_COLS = ["l_quantity", "l_tax", "o_orderpriority", "rare"]


@query("v5_missing_filter", MISSING + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'missing' AS test, CASE WHEN 1 - count({c})/count(*) > 0.3 "
    f"THEN 'removed' ELSE 'kept' END AS status, round(1 - count({c})/count(*), 6) AS value "
    f"FROM missing" for c in V5_COLS))
def _(spark, d):
    return rounded(clean.missing_filter(missing(spark, d), V5_COLS, 0.3), 6, "value")


@query("v5_drop_missing_columns", MISSING + "SELECT id, l_tax, l_discount FROM missing")
def _(spark, d):
    df = missing(spark, d).select("id", "l_tax", "l_discount", "rare")
    return clean.drop_missing_columns(df, 0.3)


V6_COLS = ["flat", "l_discount", "l_linestatus"]


@query("v6_mode_filter", MISSING + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'mode' AS test, CASE WHEN max(n)/(SELECT count(*) FROM missing) "
    f"> 0.9 AND count(*) > 1 THEN 'removed' ELSE 'kept' END AS status, "
    f"round(max(n)/(SELECT count(*) FROM missing), 6) AS value FROM (SELECT {c}, count(*) AS n "
    f"FROM missing WHERE {c} IS NOT NULL GROUP BY 1)" for c in V6_COLS))
def _(spark, d):
    return rounded(clean.mode_filter(missing(spark, d), V6_COLS), 6, "value")


@query("v6_drop_constant_columns", MISSING + "SELECT id, l_discount FROM missing")
def _(spark, d):
    df = missing(spark, d).select("id", "flat", "l_discount")
    return clean.drop_constant_columns(df, cols=["flat", "l_discount"])


@query("v7_impute_mean", MISSING + """SELECT id, round(coalesce(l_tax, (SELECT avg(l_tax)
 FROM missing)), 6) AS l_tax, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM missing)), 6)
 AS l_quantity FROM missing""")
def _(spark, d):
    df = missing(spark, d).select("id", "l_tax", "l_quantity")
    return rounded(clean.impute(df, ["l_tax", "l_quantity"]), 6, "l_tax", "l_quantity")


@query("v7_impute_median", MISSING + """SELECT id, coalesce(l_tax, (SELECT median(l_tax)
 FROM missing)) AS l_tax, coalesce(rare, (SELECT median(rare) FROM missing)) AS rare
FROM missing""")
def _(spark, d):
    df = missing(spark, d).select("id", "l_tax", "rare")
    return clean.impute(df, ["l_tax", "rare"], "median")


# Encoding ------------------------------------------------------------------------------------
@query("e1_index", CREDIT + """, k AS (SELECT o_orderpriority, row_number() OVER
 (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i FROM credit GROUP BY 1)
SELECT id, CAST(i AS DOUBLE) AS o_orderpriority_index FROM credit JOIN k USING (o_orderpriority)""")
def _(spark, d):
    df = credit(spark, d).select("id", "o_orderpriority")
    return encode.with_index(df, {"o_orderpriority": encode.label_ranks(df, "o_orderpriority")}).drop("o_orderpriority")


@query("e2_one_hot", CREDIT + """, k AS (SELECT c_mktsegment, count(*) AS n, row_number() OVER
 (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i FROM credit GROUP BY 1)
SELECT CAST(i AS INTEGER) AS slot, n AS ones FROM k""")
def _(spark, d):
    df = credit(spark, d).select("c_mktsegment")
    wide = encode.one_hot(df, {"c_mktsegment": encode.label_ranks(df, "c_mktsegment")})
    slots = wide.select(F.posexplode(vector_to_array("c_mktsegment_onehot")).alias("slot", "v"))
    return slots.groupBy("slot").agg(F.sum("v").cast("long").alias("ones"))


@query("e1_index_many_labels", """WITH k AS (SELECT p_name, row_number() OVER (ORDER BY count(*) DESC, p_name) - 1 AS i
 FROM part GROUP BY 1) SELECT p_partkey, CAST(i AS DOUBLE) AS p_name_index FROM part JOIN k USING (p_name)""")
def _(spark, d):
    """A column with about as many labels as rows; they are ranked on Spark."""
    df = table(spark, d, "part").select("p_partkey", "p_name")
    return encode.with_index(df, {"p_name": encode.label_ranks(df, "p_name")}).drop("p_name")


@query("e3_assemble", CREDIT + "SELECT id, l_quantity AS first, l_tax AS last FROM credit")
def _(spark, d):
    out = encode.assemble(credit(spark, d), NUMERIC[:4])
    v = vector_to_array("features")
    return out.select("id", v[0].alias("first"), v[3].alias("last"))


@query("e4_e5_scaled_and_raw", CREDIT + """SELECT id, l_quantity AS raw,
 round(l_quantity / (SELECT stddev_samp(l_quantity) FROM credit), 6) AS scaled FROM credit""")
def _(spark, d):
    df = credit(spark, d)
    fitted = encode.scaling(["l_quantity", "l_tax"]).fit(df)
    scaled, raw = encode.scaled_and_raw(fitted, df, ["id"])
    a = scaled.select("id", F.round(vector_to_array("features")[0], 6).alias("scaled"))
    return a.join(raw.select("id", vector_to_array("features")[0].alias("raw")), "id")


@query("e6_input_by_family", CREDIT + ", s AS (SELECT " + ", ".join(
    f"stddev_samp({c}) AS {c}" for c in ("l_quantity", "l_tax", "o_totalprice")) + " FROM credit) " + " UNION ALL ".join(
    f"SELECT '{m}' AS family, '{c}' AS feature, round({c if m in encode.RAW_FAMILIES else 1.0}, 6) AS deviation FROM s"
    for m in encode.RAW_FAMILIES + encode.SCALED_FAMILIES for c in ("l_quantity", "l_tax", "o_totalprice")))
def _(spark, d):
    """Deviation of each input as each family gets it: 1 where the family takes scaled inputs."""
    df, cols = credit(spark, d), ["l_quantity", "l_tax", "o_totalprice"]
    frames = dict(zip(("scaled", "raw"), encode.scaled_and_raw(encode.scaling(cols).fit(df), df, ["id"])))
    found = None
    for kind, frame in frames.items():
        families = [m for m in encode.families_for(False) if encode.input_for(m) == kind]
        values = frame.select(vector_to_array("features").alias("v"))
        one = values.agg(*[F.round(F.stddev(F.col("v")[i]), 6).alias(c) for i, c in enumerate(cols)])
        long = one.unpivot([], cols, "feature", "deviation").withColumn(
            "family", F.explode(F.array(*[F.lit(m) for m in families])))
        found = long if found is None else found.unionByName(long)
    return found.select("family", "feature", "deviation")


@query("e7_missing_indicators", MISSING + """SELECT CAST(sum(CASE WHEN l_tax IS NULL THEN 1 ELSE 0
 END) AS BIGINT) AS tax, CAST(sum(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS qty
FROM missing""")
def _(spark, d):
    df = encode.missing_indicators(missing(spark, d), ["l_tax", "l_quantity"])
    return df.agg(F.sum("l_tax_missing").cast("long").alias("tax"),
                  F.sum("l_quantity_missing").cast("long").alias("qty"))


@query("e7_missing_route", MISSING + """SELECT id, round(coalesce(l_tax, (SELECT median(l_tax) FROM missing)), 6) AS l_tax,
 CAST(l_tax IS NULL AS INTEGER) AS l_tax_missing, l_discount, 'tree' AS families FROM missing""")
def _(spark, d):
    """Inputs with holes: filled, with indicators, and only the tree families."""
    df = missing(spark, d).select("id", "l_tax", "l_discount")
    frame, features, families = encode.missing_route(df, ["l_tax", "l_discount"])
    kind = "tree" if set(families) == set(encode.RAW_FAMILIES) else "all"
    return rounded(frame.select("id", *features), 6, "l_tax").withColumn(
        "l_tax_missing", F.col("l_tax_missing").cast("int")).withColumn("families", F.lit(kind))


@query("e8_class_weight", with_sql(IMBALANCED_SQL) + """, w AS (SELECT
 count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM imbalanced)
SELECT doc_id, round(CASE WHEN target = 1 AND greatest(n0, n1)/(n0+n1) > 0.8 THEN n0/n1 ELSE 1.0
 END, 6) AS weight FROM imbalanced, w""")
def _(spark, d):
    out = sampling.weights(imbalanced(spark, d), "target")
    return rounded(out.select("doc_id", "weight"), 6, "weight")


# Association ---------------------------------------------------------------------------------
@query("c1_target_correlation", MISSING + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, target), 6) AS correlation FROM missing"
    for c in NUMERIC))
def _(spark, d):
    return rounded(association.target_correlation(missing(spark, d), NUMERIC, "target"),
                   6, "correlation")


def _pb_sql(c, s):
    return f"""SELECT '{c}' AS feature, n0, n1, round(m0, 6) AS mean0, round(m1, 6) AS mean1,
 round((m1-m0)*sqrt(n0*n1/pow(n0+n1, 2))/{s}, 6) AS r_pb FROM (SELECT
 count({c}) FILTER (target=0) AS n0, count({c}) FILTER (target=1) AS n1,
 avg({c}) FILTER (target=0) AS m0, avg({c}) FILTER (target=1) AS m1,
 var_samp({c}) FILTER (target=0) AS v0, var_samp({c}) FILTER (target=1) AS v1,
 stddev_pop({c}) AS sp FROM missing)"""


@query("c2_class_stats_pooled", MISSING + " UNION ALL ".join(
    _pb_sql(c, "sqrt(((n0-1)*v0 + (n1-1)*v1)/(n0+n1-2))") for c in NUMERIC))
def _(spark, d):
    out = association.class_stats(missing(spark, d), NUMERIC, "target").drop("std0", "std1")
    return rounded(out, 6, "mean0", "mean1", "r_pb")


@query("c2_class_stats_total", MISSING + " UNION ALL ".join(_pb_sql(c, "sp") for c in NUMERIC))
def _(spark, d):
    out = association.class_stats(missing(spark, d), NUMERIC, "target", "total")
    return rounded(out.drop("std0", "std1"), 6, "mean0", "mean1", "r_pb")


CHI_SQL = """WITH e AS (SELECT event_type AS x, CAST(value > 100 AS INTEGER) AS y FROM events),
c AS (SELECT x, y, count(*) AS n FROM e GROUP BY 1, 2),
g AS (SELECT a.x, b.y, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT x FROM e) a
  CROSS JOIN (SELECT DISTINCT y FROM e) b LEFT JOIN c ON c.x = a.x AND c.y = b.y),
t AS (SELECT *, sum(n) OVER (PARTITION BY x) * sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS ex
  FROM g)
SELECT 'event_type' AS feature, round(sum(pow(n - ex, 2)/ex), 6) AS statistic,
 CAST((count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS BIGINT) AS dof,
 round(exp(-sum(pow(n - ex, 2)/ex)/2) * (1 + sum(pow(n - ex, 2)/ex)/2), 6) AS p_value FROM t"""


@query("c3_chi_square", CHI_SQL)
def _(spark, d):
    df = table(spark, d, "events").withColumn("target", (F.col("value") > 100).cast("int"))
    out = association.chi_square(df, ["event_type"], "target")
    return rounded(out, 6, "statistic", "p_value")


@query("c4_correlation_matrix", CREDIT + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM credit"
    for a in NUMERIC for b in NUMERIC))
def _(spark, d):
    return rounded(association.correlation_matrix(credit(spark, d), NUMERIC), 6, "correlation")


HOLES = ["l_quantity", "l_tax", "rare", "l_extendedprice"]


@query("c4_pairwise_missing", MISSING + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN NOT isnan(r) THEN r END AS correlation FROM (SELECT "
    f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM missing)" for a in HOLES for b in HOLES))
def _(spark, d):
    df = missing(spark, d).withColumn("rare", F.col("rare").cast("double"))
    return rounded(association.correlation_matrix(df, HOLES), 6, "correlation")


@query("c9_missing", MISSING + """, k AS (SELECT *, l_quantity*100 + l_extendedprice/1000 AS mix,
 CASE WHEN l_quantity IS NULL THEN l_tax END AS other FROM missing),
v AS (SELECT 'l_quantity' AS feature, CAST(0 AS DOUBLE) AS value
 UNION ALL SELECT 'other', CAST(0 AS DOUBLE)
 UNION ALL SELECT 'mix', abs(corr(mix, l_quantity)) FROM k)
SELECT feature, 'correlation' AS test, CASE WHEN value > 0.9 THEN 'removed' ELSE 'kept' END
 AS status, round(value, 6) AS value FROM v""")
def _(spark, d):
    df = missing(spark, d).withColumn(
        "mix", F.col("l_quantity") * 100 + F.col("l_extendedprice") / 1000).withColumn(
        "other", F.when(F.col("l_quantity").isNull(), F.col("l_tax")))
    return rounded(association.correlation_filter(df, ["l_quantity", "other", "mix"]), 6, "value")


def _chi_missing_sql(c):
    return f"""SELECT '{c}' AS feature, round(x, 5) AS statistic, dof, round(CASE dof WHEN 2 THEN exp(-x/2)
 WHEN 4 THEN exp(-x/2)*(1 + x/2) END, 5) AS p_value FROM (SELECT sum(n) OVER () * (sum(n*n/r/k) OVER () - 1) AS x,
 CAST((count(DISTINCT level) OVER () - 1) * (count(DISTINCT target) OVER () - 1) AS BIGINT) AS dof
 FROM (SELECT level, target, n, sum(n) OVER (PARTITION BY level) AS r, sum(n) OVER (PARTITION BY target) AS k
 FROM (SELECT {c} AS level, target, CAST(count(*) AS DOUBLE) AS n FROM missing WHERE {c} IS NOT NULL
  GROUP BY 1, 2)) LIMIT 1)"""


@query("c3_two_columns_missing", MISSING + " UNION ALL ".join(
    f"SELECT * FROM ({_chi_missing_sql(c)})" for c in ("o_orderpriority", "c_mktsegment")))
def _(spark, d):
    out = association.chi_square(missing(spark, d), ["o_orderpriority", "c_mktsegment"], "target")
    closed = F.when(F.col("dof").isin(2, 4), F.col("p_value"))  # what SQL can check
    return rounded(out.withColumn("p_value", closed), 5, "statistic", "p_value")


def _vif_sql(i, j, k):
    r = lambda a, b: f"corr({a}, {b})"
    return (f"SELECT '{i}' AS feature, 1/(1 - (pow({r(i, j)}, 2) + pow({r(i, k)}, 2) - "
            f"2*{r(i, j)}*{r(i, k)}*{r(j, k)})/(1 - pow({r(j, k)}, 2))) AS vif FROM k")


@query("c5_c7_vif", CREDIT + """, k AS (SELECT l_quantity AS a, l_extendedprice AS b,
 l_quantity*1000 + l_extendedprice + o_totalprice/100 AS c FROM credit), v AS (""" + " UNION ALL ".join(
    [_vif_sql("a", "b", "c"), _vif_sql("b", "a", "c"), _vif_sql("c", "a", "b")]) + """)
SELECT feature, round(vif, 4) AS vif, CASE WHEN vif < 5 THEN 'low' WHEN vif < 10 THEN 'moderate'
 ELSE 'high' END AS verdict FROM v""")
def _(spark, d):
    df = credit(spark, d).select(
        F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"),
        (F.col("l_quantity") * 1000 + F.col("l_extendedprice") + F.col("o_totalprice") / 100)
        .alias("c"))
    return rounded(association.vif(df, ["a", "b", "c"]), 4, "vif")


@query("j4_vif_with_correlation", CREDIT + """, k AS (SELECT l_quantity AS a, l_extendedprice AS b,
 l_quantity*1000 + l_extendedprice AS c, target FROM credit),
v AS (SELECT 'a' AS feature, round(1/(1 - pow(corr(a, c), 2)), 4) AS vif FROM k
 UNION ALL SELECT 'c', round(1/(1 - pow(corr(a, c), 2)), 4) FROM k),
t AS (SELECT 'a' AS feature, round(corr(a, target), 6) AS correlation FROM k
 UNION ALL SELECT 'c', round(corr(c, target), 6) FROM k)
SELECT feature, vif, correlation FROM v JOIN t USING (feature)""")
def _(spark, d):
    df = credit(spark, d).select("target", F.col("l_quantity").alias("a"), (
        F.col("l_quantity") * 1000 + F.col("l_extendedprice")).alias("c"))
    vifs = rounded(association.vif(df, ["a", "c"]).select("feature", "vif"), 4, "vif")
    strength = association.target_correlation(df, ["a", "c"], "target")
    return vifs.join(rounded(strength, 6, "correlation"), "feature")


@query("a7_a8_bin_shares", MISSING + """, m AS (SELECT strftime(date, '%Y-%m') AS month,
 CASE WHEN l_tax IS NULL THEN -1 ELSE (l_tax > 0.03)::INT + (l_tax > 0.06)::INT END AS bin
 FROM missing), c AS (SELECT month, bin, count(*) AS n FROM m GROUP BY 1, 2),
s AS (SELECT bin, n / sum(n) OVER (PARTITION BY month) AS share FROM c)
SELECT CAST(bin AS INTEGER) AS bin, round(avg(share), 6) AS mean_share FROM s GROUP BY 1""")
def _(spark, d):
    edges = F.array(F.lit(0.03), F.lit(0.06))
    counts = missing(spark, d).groupBy(
        month_of("date").alias("month"), edge_bin(F.col("l_tax"), edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("month"))
    return counts.withColumn("share", share).groupBy("bin").agg(
        F.round(F.avg("share"), 6).alias("mean_share"))


@query("c6_vif_categorical")
def _(spark, d):
    return association.vif_categorical(credit(spark, d), TEXT)


@query("c6_vif_two_columns", CREDIT + """, k AS (SELECT o_orderpriority AS a,
 CAST(l_linestatus <> (SELECT l_linestatus FROM credit GROUP BY 1 ORDER BY count(*), 1 DESC LIMIT 1)
  AS DOUBLE) AS y FROM credit),
g AS (SELECT a, count(*) AS m, avg(y) AS mean, sum(y*y) - sum(y)*sum(y)/count(*) AS within FROM k GROUP BY 1),
w AS (SELECT sum(within) AS within, (SELECT sum(y*y) - sum(y)*sum(y)/count(*) FROM k) AS whole, sum(m) AS n FROM g),
ref AS (SELECT * FROM g ORDER BY m, a DESC LIMIT 1),
v AS (SELECT 'l_linestatus=' || (SELECT l_linestatus FROM credit GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  AS feature, whole / within AS vif FROM w
 UNION ALL SELECT 'o_orderpriority=' || g.a, g.m*(1 - g.m/n) / (h - pow(h*(g.mean - ref.mean), 2)
  / (w.within + h*pow(g.mean - ref.mean, 2))) FROM g, w, ref, LATERAL (SELECT g.m*ref.m/(g.m + ref.m) AS h) x
 WHERE g.a <> ref.a)
SELECT feature, round(vif, 6) AS vif, CASE WHEN vif < 5 THEN 'low' WHEN vif < 10 THEN 'moderate'
 ELSE 'high' END AS verdict FROM v""")
def _(spark, d):
    """By hand: inflation is total over residual sum of squares. For the two-valued column the residual
    is the sum within the priorities; for a priority it is what remains beside the reference level."""
    return rounded(association.vif_categorical(credit(spark, d), ["l_linestatus", "o_orderpriority"]), 6, "vif")


@query("c6_vif_pair_missing", MISSING + """, k AS (SELECT l_linestatus = 'O' AS x, l_tax > 0.04 AS y FROM missing),
r AS (SELECT 1/(1 - pow(corr(CAST(x AS INTEGER), CAST(y AS INTEGER)), 2)) AS vif FROM k WHERE y IS NOT NULL),
n AS (SELECT 'l_linestatus=' || (SELECT l_linestatus FROM missing GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS feature
 UNION ALL SELECT 'high=' || (SELECT y FROM k WHERE y IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
SELECT feature, round(vif, 6) AS vif, 'low' AS verdict FROM n, r""")
def _(spark, d):
    df = missing(spark, d).withColumn("high", (F.col("l_tax") > 0.04).cast("string"))
    return rounded(association.vif_categorical(df, ["l_linestatus", "high"]), 6, "vif")


@query("c8_select_three", CREDIT + """, k AS (SELECT target, l_quantity AS a, l_extendedprice AS b,
 l_quantity*1000 + l_extendedprice AS c FROM credit),
s AS (SELECT feature, row_number() OVER (ORDER BY abs(r) DESC, feature) AS place FROM (
 SELECT 'a' AS feature, corr(a, target) AS r FROM k UNION ALL SELECT 'b', corr(b, target) FROM k
 UNION ALL SELECT 'c', corr(c, target) FROM k)),
p AS (SELECT CASE (SELECT feature FROM s WHERE place = 1) WHEN 'a' THEN corr(b, c) WHEN 'b' THEN corr(a, c)
 ELSE corr(a, b) END AS r FROM k)
SELECT CAST(place - 1 AS INTEGER) AS place, feature FROM s, p WHERE place = 1 OR 1/(1 - r*r) <= 5""")
def _(spark, d):
    """The strongest goes first; the other two stay if they inflate each other by five at most."""
    df = credit(spark, d).select("target", F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"),
                                 (F.col("l_quantity") * 1000 + F.col("l_extendedprice")).alias("c"))
    names = association.select_non_collinear(df, ["a", "b", "c"], "target")
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, feature string")


@query("c8_select_non_collinear")
def _(spark, d):
    df = credit(spark, d).withColumn("mix", F.col("l_quantity") * 2 + F.col("l_tax"))
    names = association.select_non_collinear(df, [*NUMERIC, "mix"], "target")
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, feature string")


@query("c9_correlation_filter", CREDIT + """, k AS (SELECT *, l_quantity*100 + l_tax AS mix
 FROM credit), v AS (SELECT 'l_quantity' AS feature, CAST(0 AS DOUBLE) AS value
 UNION ALL SELECT 'l_tax', abs(corr(l_quantity, l_tax)) FROM k
 UNION ALL SELECT 'mix', greatest(abs(corr(mix, l_quantity)), abs(corr(mix, l_tax))) FROM k)
SELECT feature, 'correlation' AS test, CASE WHEN value > 0.9 THEN 'removed' ELSE 'kept' END
 AS status, round(value, 6) AS value FROM v""")
def _(spark, d):
    df = credit(spark, d).withColumn("mix", F.col("l_quantity") * 100 + F.col("l_tax"))
    return rounded(association.correlation_filter(df, ["l_quantity", "l_tax", "mix"]), 6, "value")


def _auc_sql(c):
    return f"""SELECT '{c}' AS feature, round(sum(g*(cb - b/2.0))/(max(tg)*max(tb)), 6) AS auc,
 round(sum(b/tb * (cb/(cb+cg) + CASE WHEN cb+cg = b+g THEN 1.0
   ELSE (cb-b)/nullif(cb+cg-b-g, 0) END)/2.0), 6) AS pr_auc FROM (
 SELECT g, b, sum(g) OVER (ORDER BY s DESC) AS cg, sum(b) OVER (ORDER BY s DESC) AS cb,
  sum(g) OVER () AS tg, sum(b) OVER () AS tb FROM (SELECT coalesce({c}, (SELECT median({c})
  FROM missing)) AS s, count(*) FILTER (target=0) AS g, count(*) FILTER (target=1) AS b
  FROM missing GROUP BY 1))"""


@query("c10_c11_univariate_ranks", MISSING + " UNION ALL ".join(_auc_sql(c) for c in NUMERIC))
def _(spark, d):
    out = association.univariate_ranks(missing(spark, d), NUMERIC, "target")
    return rounded(out.select("feature", "auc", "pr_auc"), 6, "auc", "pr_auc")


def _mi_sql(c):
    edges = ", ".join(f"quantile_cont({c}, {p / 10})" for p in range(1, 10))
    return f"""SELECT '{c}' AS feature, round(sum(n/t * ln(n*t/(nb*ny))), 6) AS mutual_information
FROM (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY bin) AS nb,
  sum(n) OVER (PARTITION BY target) AS ny FROM (
  SELECT target, CASE WHEN {c} IS NULL THEN -1 ELSE len(list_filter(es, lambda e: e < {c})) END AS bin,
   count(*) AS n FROM missing, (SELECT list_distinct([{edges}]) AS es FROM missing) GROUP BY 1, 2))"""


@query("c12_mutual_information", MISSING + " UNION ALL ".join(_mi_sql(c) for c in NUMERIC))
def _(spark, d):
    out = association.mutual_information(missing(spark, d), NUMERIC, "target")
    return rounded(out, 6, "mutual_information")


@query("c10_c12_univariate_filter")
def _(spark, d):
    return association.univariate_filter(missing(spark, d), NUMERIC, "target", False)


# Stability -----------------------------------------------------------------------------------
PSI_COLS = NUMERIC


def _psi_sql(c):
    edges = ", ".join(f"quantile_cont({c}, {p / 10})" for p in range(1, 10))
    return f"""SELECT '{c}' AS feature, month, baseline, round(sum((c-b)*ln((c+1e-6)/(b+1e-6))), 6)
 AS psi FROM (SELECT g.month, g.bin, coalesce(n.n, 0)/t.n AS c, g.month IN (SELECT month FROM base)
  AS inb, avg(coalesce(n.n, 0)/t.n) FILTER (g.month IN (SELECT month FROM base))
   OVER (PARTITION BY g.bin) AS b FROM
 (SELECT month, bin FROM (SELECT DISTINCT month FROM m), (SELECT unnest(range(-1, 10)) AS bin)) g
 JOIN (SELECT month, count(*) AS n FROM m GROUP BY 1) t ON t.month = g.month
 LEFT JOIN (SELECT month, CASE WHEN {c} IS NULL THEN -1
    ELSE len(list_filter(es, lambda e: e < {c})) END AS bin, count(*) AS n FROM m,
   (SELECT list_distinct([{edges}]) AS es FROM m WHERE month IN (SELECT month FROM base))
   GROUP BY 1, 2) n ON n.month = g.month AND n.bin = g.bin),
 (SELECT string_agg(month, ',' ORDER BY month) AS baseline FROM base)
WHERE NOT inb GROUP BY 1, 2, 3"""


MONTHS_SQL = MISSING + """, m AS (SELECT *, strftime(date, '%Y-%m') AS month FROM missing),
base AS (SELECT DISTINCT month FROM m ORDER BY month LIMIT 3) """


@query("d1_psi_monthly", MONTHS_SQL + " UNION ALL ".join(_psi_sql(c) for c in PSI_COLS))
def psi_query(spark, d):
    df = missing(spark, d).select("date", *PSI_COLS)
    return rounded(stability.psi_monthly(df, "date", PSI_COLS), 6, "psi")


def _two_sql(c, group="0"):
    return f"""SELECT '{c}' AS feature, round(sum((c-b)*ln(c/b)), 6) AS psi FROM (
 SELECT (coalesce(nb, 0) + 1e-6)/(sum(coalesce(nb, 0)) OVER () + 1e-5) AS b,
  (coalesce(nc, 0) + 1e-6)/(sum(coalesce(nc, 0)) OVER () + 1e-5) AS c
 FROM (SELECT unnest(range(0, 10)) AS bin) LEFT JOIN (
  SELECT CAST(least(floor((v - lo)/((hi - lo)/10.0)), 9) AS BIGINT) AS bin,
   count(*) FILTER (inb) AS nb, count(*) FILTER (NOT inb) AS nc FROM (
   SELECT *, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (
    SELECT inb, coalesce({c}, median({c}) OVER (PARTITION BY inb)) AS v FROM (
     SELECT {c}, month IN (SELECT month FROM base) AS inb FROM m))) GROUP BY 1) USING (bin))"""


@query("d2_psi_two_sample", MONTHS_SQL + " UNION ALL ".join(_two_sql(c) for c in PSI_COLS))
def _(spark, d):
    df = missing(spark, d).select("date", *PSI_COLS)
    base = stability.in_baseline(df, "date")
    return rounded(stability.psi_of_parts(df, base, PSI_COLS), 6, "psi")


def _mean_sql(c):
    return f"""SELECT '{c}' AS feature, round(avg(psi), 6) AS psi, avg(psi) < 0.1 AS stable FROM (
 SELECT month, sum((c-b)*ln(c/b)) AS psi FROM (
 SELECT month, (coalesce(nb, 0) + 1e-6)/(sum(coalesce(nb, 0)) OVER (PARTITION BY month) + 1e-5)
  AS b, (coalesce(nc, 0) + 1e-6)/(sum(coalesce(nc, 0)) OVER (PARTITION BY month) + 1e-5) AS c
 FROM (SELECT month, unnest(range(0, 10)) AS bin FROM later) g LEFT JOIN (
  SELECT month, CAST(least(floor((v - lo)/((hi - lo)/10.0)), 9) AS BIGINT) AS bin,
   count(*) FILTER (inb) AS nb, count(*) FILTER (NOT inb) AS nc FROM (
   SELECT *, min(v) OVER (PARTITION BY month) AS lo, max(v) OVER (PARTITION BY month) AS hi FROM (
    SELECT month, false AS inb, coalesce({c}, (SELECT median({c}) FROM m)) AS v FROM m
     WHERE month NOT IN (SELECT month FROM base)
    UNION ALL SELECT later.month, true, coalesce({c}, (SELECT median({c}) FROM m WHERE month IN
     (SELECT month FROM base))) FROM m, later WHERE m.month IN (SELECT month FROM base)))
  GROUP BY 1, 2) USING (month, bin)) GROUP BY 1)"""


@query("d3_psi_mean_by_month", MONTHS_SQL + """, later AS (SELECT DISTINCT month FROM m
 WHERE month NOT IN (SELECT month FROM base)) """ + " UNION ALL ".join(
    _mean_sql(c) for c in PSI_COLS))
def _(spark, d):
    return rounded(stability.psi_mean_by_month(missing(spark, d), "date", PSI_COLS), 6, "psi")


@query("d4_split_baseline", MONTHS_SQL + """SELECT id, month IN (SELECT month FROM base)
 AS baseline FROM m""")
def _(spark, d):
    base, current = stability.split_baseline(missing(spark, d), "date")
    return base.select("id", F.lit(True).alias("baseline")).unionByName(
        current.select("id", F.lit(False).alias("baseline")))


@query("d5_stability_filter", MONTHS_SQL + """, p AS (""" + " UNION ALL ".join(
    _two_sql(c) for c in PSI_COLS) + """) SELECT feature, 'psi' AS test,
 CASE WHEN psi < 0.002 THEN 'kept' ELSE 'removed' END AS status, psi AS value FROM p""")
def _(spark, d):
    df = missing(spark, d).select("date", *PSI_COLS)
    psi = stability.psi_of_parts(df, stability.in_baseline(df, "date"), PSI_COLS)
    return rounded(stability.stability_filter(psi, 0.002), 6, "value")
