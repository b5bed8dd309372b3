"""Frames the queries run on, as DataFrames and as the same SQL text.

All of them read whole tables. Missing values are made by reading a sentinel value
(zero tax, the unspecified priority) as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreflow.sources.tables import read_parquet

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "c_acctbal"]
TEXT = ["l_linestatus", "o_orderpriority", "c_mktsegment"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _cents(name: str):
    return F.round(F.col(name) * 100).cast("bigint").cast("string")


def line_id():
    keys = [F.col(c).cast("string") for c in
            ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat_ws("-", *keys, _cents("l_quantity"), _cents("l_extendedprice"))


LINE_ID_SQL = (
    "concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
    "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
    "CAST(CAST(round(l_quantity*100) AS BIGINT) AS VARCHAR), "
    "CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS VARCHAR))"
)


def credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        line_id().alias("id"), "l_orderkey",
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").alias("date"), "o_totalprice",
        "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("id", "target", "date", *NUMERIC, *TEXT)
    )


CREDIT_SQL = f"""credit AS (
  SELECT {LINE_ID_SQL} AS id, CAST(l_returnflag = 'R' AS INTEGER) AS target,
         o_orderdate AS date, l_quantity, l_extendedprice, l_discount, l_tax, o_totalprice,
         c_acctbal, l_linestatus, o_orderpriority, c_mktsegment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN customer ON o_custkey = c_custkey)"""


def with_score(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "score", F.round(F.col("l_discount") * 10 + F.col("l_tax") + F.col("l_quantity") / 100, 6))


SCORE_SQL = "round(l_discount*10 + l_tax + l_quantity/100, 6)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items only (no join needed): id, target, score with many ties."""
    return with_score(table(spark, sf_dir, "lineitem")).select(
        line_id().alias("id"), (F.col("l_returnflag") == "R").cast("int").alias("target"),
        "score", "l_linestatus")


SCORED_SQL = f"""scored AS (
  SELECT {LINE_ID_SQL} AS id, CAST(l_returnflag = 'R' AS INTEGER) AS target,
         {SCORE_SQL} AS score, l_linestatus FROM lineitem)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score separates the classes; prob = score / 1.6 lies in [0, 1]."""
    df = with_score(table(spark, sf_dir, "lineitem"))
    noise = F.dayofmonth("l_shipdate") / 31.0
    return df.select(
        line_id().alias("id"), (F.col("score") + noise > 1.2).cast("int").alias("target"),
        "score", F.round(F.col("score") / 1.6, 6).alias("prob"), "l_linestatus")


SIGNAL_SQL = f"""signal AS (
  SELECT id, CAST(score + noise > 1.2 AS INTEGER) AS target, score,
         round(score / 1.6, 6) AS prob, l_linestatus
  FROM (SELECT {LINE_ID_SQL} AS id, {SCORE_SQL} AS score, l_linestatus,
               CAST(day(l_shipdate) AS DOUBLE) / 31.0 AS noise FROM lineitem))"""


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """credit with sentinels read as missing, plus a rare and a nearly flat column."""
    df = credit(spark, sf_dir)
    return df.withColumns({
        "l_tax": F.nullif(F.col("l_tax"), F.lit(0.0)),
        "l_quantity": F.nullif(F.col("l_quantity"), F.lit(50.0)),
        "o_orderpriority": F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")),
        "rare": F.when((F.col("l_quantity") == 1) & (F.col("l_discount") == 0),
                       F.col("l_extendedprice")),
        "flat": (F.col("l_quantity") == 1).cast("double"),
    })


MISSING_SQL = f"""{CREDIT_SQL}, missing AS (
  SELECT id, target, date, nullif(l_quantity, 50.0) AS l_quantity, l_extendedprice, l_discount,
         nullif(l_tax, 0.0) AS l_tax, o_totalprice, c_acctbal, l_linestatus,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, c_mktsegment,
         CASE WHEN l_quantity = 1 AND l_discount = 0 THEN l_extendedprice END AS rare,
         CAST(l_quantity = 1 AS DOUBLE) AS flat
  FROM credit)"""


def imbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("toxic").alias("target"), F.col("n_chars").cast("double").alias("n_chars"),
        F.col("quality").cast("double").alias("quality"), "lang", "source")


IMBALANCED_SQL = """imbalanced AS (
  SELECT doc_id, toxic AS target, CAST(n_chars AS DOUBLE) AS n_chars,
         CAST(quality AS DOUBLE) AS quality, lang, source
  FROM labels JOIN documents USING (doc_id))"""


def vectors(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """embeddings spread to columns v0..v63, with binary target label = 0."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "label",
        (F.col("label") == 0).cast("int").alias("target"),
        *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(dims)])


def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as text in several national formats."""
    us = F.format_number("l_extendedprice", 2)
    br = F.translate(us, ",.", ".,")
    return table(spark, sf_dir, "lineitem").select(
        line_id().alias("id"), F.col("l_extendedprice").alias("price"), "l_discount",
        us.alias("us"), br.alias("br"), F.concat(F.lit("-"), br).alias("neg"),
        F.concat(F.lit("R$ "), br).alias("cur"),
        F.concat(F.format_number(F.col("l_discount") * 100, 2), F.lit("%")).alias("pct"),
        F.when(F.col("l_linestatus") == "F", br).otherwise("ABC").alias("mixed"))


TEXT_NUMBERS_SQL = f"""text_numbers AS (
  SELECT id, price, l_discount, us, br, '-' || br AS neg, 'R$ ' || br AS cur,
         format('{{:,.2f}}', l_discount*100) || '%' AS pct,
         CASE WHEN l_linestatus = 'F' THEN br ELSE 'ABC' END AS mixed
  FROM (SELECT *, translate(us, ',.', '.,') AS br
        FROM (SELECT {LINE_ID_SQL} AS id, l_extendedprice AS price, l_discount, l_linestatus,
                     format('{{:,.2f}}', l_extendedprice) AS us FROM lineitem)))"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
