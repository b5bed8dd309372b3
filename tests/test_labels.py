"""Ranks of labels and what is built of them."""

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from scoreflow.operators import encode, prefix

ROWS = [("b",), ("a",), ("b",), (None,), ("c",), ("a",), ("é",)]


def test_ranks_and_vectors(spark):
    df = spark.createDataFrame(ROWS, "s string").withColumn("t", F.lit("x"))
    ranks = {c: encode.label_ranks(df, c) for c in ("s", "t")}
    assert {r["label"]: r["index"] for r in ranks["s"].collect()} == {"a": 0.0, "b": 1.0, "c": 2.0, "é": 3.0}
    assert sorted((r["s"] or "", r["s_index"], r["t_index"]) for r in encode.with_index(df, ranks).collect()) == sorted(
        (s or "", {"a": 0.0, "b": 1.0, "c": 2.0, "é": 3.0}.get(s, 4.0), 0.0) for s, in ROWS)
    wide = encode.one_hot(df, ranks)
    got = {r["s"]: r["s_onehot"] for r in wide.collect()}
    assert got["c"].toArray().tolist() == [0, 0, 1, 0] and got[None].toArray().sum() == 0 and got["a"].size == 4
    kept = encode.one_hot(df, ranks, drop_last=False)
    assert {r["s"]: r["s_onehot"].indices.tolist() for r in kept.collect()}[None] == [4]
    joined = VectorAssembler(inputCols=["s_onehot", "t_onehot"], outputCol="x").transform(wide)
    assert {r["x"].size for r in joined.collect()} == {5}
    unseen = encode.with_index(spark.createDataFrame([("z",)], "s string"), {"s": ranks["s"]}).first()
    assert unseen["s_index"] == 4.0
    none = encode.label_ranks(df.limit(0), "s")
    assert none.count() == 0 and encode.one_hot(df.limit(0), {"s": none}).count() == 0


def test_a_million_labels(spark):
    df = spark.range(1_000_000).select(F.format_string("l%07d", "id").alias("s"))
    wide = encode.one_hot(df, {"s": encode.label_ranks(df, "s")})
    row = wide.where("s = 'l0765432'").first()
    assert row["s_index"] == 765432.0 and row["s_onehot"].size == 1_000_000 and row["s_onehot"].indices.tolist() == [765432]


def test_rank_by_any_order(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)], "g int, i int")
    got = [r["i"] for r in prefix.rank_by(df, [F.desc("g"), "i"]).orderBy("rank").collect()]
    assert got == sorted(range(200), key=lambda i: (-(i % 7), i))
    assert sorted(r["rank"] for r in prefix.rank_by(df, ["g", F.desc("i")]).collect()) == list(range(200))
