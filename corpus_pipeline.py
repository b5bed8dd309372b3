"""The corpus pipeline: five stages, each one operator of ``scoreflow.llm``, from documents to pieces.

Each stage works on all rows its predecessor kept. The first four return the columns of documents;
the last returns piece ids. Results of a stage are written as Parquet in the shared folder of the
session (``spark.checkpoint.dir``) and read again.

Null texts count as empty: they have a score, a fingerprint and no personal data, and get null ids.
Rows with null ``doc_id`` can't be named by the near-duplicate stage and stay. Empty tables give
empty results. Further columns of documents travel along.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed, shared_folder
from scoreflow.llm import mixing, nearsets, pieces, pii, quality
from scoreflow.llm.common import held_out, read
from scoreflow.llm.queries import MODEL, TARGETS

# Near duplicates: Jaccard similarity of 0.8 or more between the sets of five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("__y"))
    # The texts to learn from are few; the others are described once, when they are judged.
    learned = docs.select("doc_id", "text").join(labels.where(~held_out("doc_id", 3, 1)), "doc_id")
    learned = learned.select(F.struct("doc_id", "__y").alias("doc_id"), "text")
    labelled = checkpointed(quality.statistics(learned).select("x", F.col("key.__y").alias("y")))
    return quality.kept(docs, quality.fit(labelled))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id.

    Rows are judged one by one, also where several share a doc_id; of those, the smallest md5 of the
    text comes first, and of rows that also share the text one stays.
    """
    found = checkpointed(nearsets.classes(docs, SHINGLE_WORDS, SIMILARITY))
    stays = found.groupBy("component").agg(F.min(F.struct("key", "digest")).alias("stays"))
    odd = checkpointed(found.join(stays, "component").select(
        "key", "digest", "rows", (F.struct("key", "digest") != F.col("stays")).alias("copy")).where("copy or rows > 1"))
    # Only rows that go, or that share doc_id and text with others, need a look; the others pass by.
    marks = F.broadcast(odd.select(nearsets.mark("key").alias("mark")).distinct())
    named = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("key"), nearsets.mark("doc_id").alias("mark"))
    looked = named.join(marks, "mark", "left_semi").withColumn("digest", nearsets.digest("__row.text"))
    looked = looked.join(odd, ["key", "digest"], "left").where("copy is null or not copy")
    several = looked.where("rows > 1").groupBy("key", "digest").agg(F.first("__row").alias("__row"))
    return named.join(marks, "mark", "left_anti").select("__row.*").unionAll(
        looked.where("rows is null or rows = 1").select("__row.*")).unionAll(several.select("__row.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in the text replaced by its kind, n_chars counted anew."""
    return pii.redacted(docs, "text", "n_chars" if "n_chars" in docs.columns else None)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mixture of the sources with the target weights ``TARGETS``.

    The order is that of the written files and the rows in them; the last stage carries it.
    """
    return mixing.mixed(docs, weights=TARGETS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with its place in the mixture: file and row of the last stage."""
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("f"),
                             F.col("_metadata.row_index").alias("r"))
    except AnalysisException:  # not read from files: no order to carry
        placed = docs.select("doc_id", "text", F.lit("").alias("f"), F.lit(None).cast("long").alias("r"))
    rows = placed.select(F.struct("doc_id", "f", "r").alias("key"), "text")
    made = pieces.encode(rows, pieces.read_model(MODEL), key="key")
    return made.select("key.doc_id", F.col("key.f").alias("mixture_file"), F.col("key.r").alias("mixture_row"),
                       F.size("ids").alias("n_ids"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]
# The classifier, the fingerprints and the pieces can't be said in SQL; the tests hold each stage
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
