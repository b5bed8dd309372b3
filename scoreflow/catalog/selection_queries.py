"""Queries on feature selection, with SQL that takes every step up to the model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from scoreflow.catalog.feature_queries import _auc_sql, _mean_sql, _mi_sql, _two_sql, rounded
from scoreflow.catalog.frames import MISSING_SQL, NUMERIC, missing, with_sql
from scoreflow.catalog.registry import query
from scoreflow.plans.select import select_features

WIDE = [*NUMERIC, "rare", "flat"]


def report_sql(cols: Sequence[str], target: str | None = None, limit: float = 0.95, by_month: bool = False) -> str:
    """The whole report: missing, mode, (areas and information,) correlation, stability.

    Every step names its features in a ``left`` table, from which the next step starts.
    """
    union = " UNION ALL ".join
    status = lambda gone: f"CASE WHEN {gone} THEN 'removed' ELSE 'kept' END AS status"
    steps, reports, left = [], [], "all_features"
    on = lambda sql: sql.replace("FROM missing", "FROM sel")

    def step(name: str, sql: str) -> None:
        nonlocal left
        steps.append(f"{name} AS ({sql} WHERE feature IN (SELECT feature FROM {left}))")
        steps.append(f"left_{name} AS (SELECT feature FROM {left} WHERE feature NOT IN "
                     f"(SELECT feature FROM {name} WHERE status = 'removed'))")
        left = f"left_{name}"
        reports.append(f"SELECT feature, test, status, round(value, 6) AS value FROM {name}")

    replaced = f"* REPLACE ({target} AS target)" if target else "*"
    head = with_sql(MISSING_SQL) + f""", sel AS (SELECT {replaced} FROM missing),
 m AS (SELECT *, strftime(date, '%Y-%m') AS month FROM sel),
 base AS (SELECT DISTINCT month FROM m ORDER BY month LIMIT 3),
 later AS (SELECT DISTINCT month FROM m WHERE month NOT IN (SELECT month FROM base)),
 all_features AS (SELECT unnest([{", ".join(f"'{c}'" for c in cols)}]) AS feature), """
    step("miss", f"SELECT feature, 'missing' AS test, {status(f'value > {limit}')}, value FROM (" + union(
        f"SELECT '{c}' AS feature, 1 - count({c})/count(*) AS value FROM sel" for c in cols) + ")")
    step("modes", f"SELECT feature, 'mode' AS test, {status('value > 0.9 AND kinds > 1')}, value FROM (" + union(
        f"SELECT '{c}' AS feature, max(n)/(SELECT count(*) FROM sel) AS value, count(*) AS kinds FROM "
        f"(SELECT count(*) AS n FROM sel WHERE {c} IS NOT NULL GROUP BY {c})" for c in cols) + ")")
    if target:
        steps.append("imb AS (SELECT greatest(avg(target), 1 - avg(target)) > 0.8 AS yes FROM sel)")
        steps.append("areas AS (SELECT feature, CASE WHEN yes THEN pr_auc ELSE auc END AS area, yes, mutual_information "
                     "FROM (" + union(on(_auc_sql(c)) for c in cols) + ") JOIN (" + union(on(_mi_sql(c)) for c in cols)
                     + ") USING (feature), imb)")
        gone = "NOT (area > CASE WHEN yes THEN 0.2 ELSE 0.55 END AND mutual_information > 0.01)"
        step("univ", f"SELECT * FROM (SELECT feature, CASE WHEN yes THEN 'pr_auc' ELSE 'auc' END AS test, {status(gone)}, "
             f"area AS value FROM areas UNION ALL SELECT feature, 'mutual_information', {status(gone)}, "
             "mutual_information FROM areas)")
    pairs = union(f"SELECT '{a}' AS a, '{b}' AS feature, abs(corr({a}, {b})) AS r FROM sel"
                  for i, a in enumerate(cols) for b in cols[i + 1:])
    steps.append(f"pairs AS (SELECT feature, max(r) AS r FROM ({pairs}) WHERE a IN (SELECT feature FROM {left}) GROUP BY 1)")
    step("corr", f"SELECT feature, 'correlation' AS test, {status('value > 0.9')}, value FROM (SELECT f.feature, "
         f"coalesce(r, 0) AS value FROM all_features f LEFT JOIN pairs p ON p.feature = f.feature "
         f"WHERE (SELECT count(*) FROM {left}) > 1)")
    psi = _mean_sql if by_month else _two_sql
    step("psi", f"SELECT feature, 'psi' AS test, {status('NOT coalesce(psi < 0.1, false)')}, psi AS value FROM ("
         + union(psi(c) for c in cols) + ")")
    return head + ", ".join(steps) + " " + union(reports)


@query("g1_g2_select_features", report_sql(WIDE, limit=0.9))
def _(spark, d):
    df = missing(spark, d).select("date", *WIDE)
    return rounded(select_features(df, "date", missing=0.9)[1], 6, "value")


@query("g1_select_by_month", report_sql(["l_quantity", "l_tax", "flat"], by_month=True))
def _(spark, d):
    df = missing(spark, d).select("date", "l_quantity", "l_tax", "flat")
    return rounded(select_features(df, "date", by_month=True)[1], 6, "value")


@query("g1_select_by_month_all", report_sql(WIDE, by_month=True))
def _(spark, d):
    """All numeric columns of the frame."""
    df = missing(spark, d).select("date", *WIDE)
    return rounded(select_features(df, "date", by_month=True)[1], 6, "value")


@query("g1_select_with_target", report_sql(
    WIDE, "CAST(l_discount * 10 + coalesce(l_quantity, 0) / 50 > 1 AS INTEGER)", 0.9))
def _(spark, d):
    """All steps but the last, on a frame whose discount and quantity tell the classes apart."""
    df = missing(spark, d).select("date", *WIDE, (
        F.col("l_discount") * 10 + F.coalesce("l_quantity", F.lit(0)) / 50 > 1).cast("int").alias("target"))
    return rounded(select_features(df, "date", "target", missing=0.9, use_model=False)[1], 6, "value")
