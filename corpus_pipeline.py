"""Corpus preparation: quality filter, exact and near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of ``documents``, less the rows that the stage decides
against.  ``run`` writes each result as Parquet in the shared folder and reads
it as the next stage's documents.

Rows of all kinds pass through every stage: a null text is an empty one; a row
with a null id is judged by its text, equals other rows of that text, and links
with nothing; rows that share an id are judged each by its own text, but near
duplicates are decided by id, so there they go or stay together.
Very long texts count whole.  Columns other than doc_id, text and source are
carried along unread, whatever their names.  Empty tables give empty results;
without labels the classifier gives every text one score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.classifier import THRESHOLD, fit_quality, quality_score
from assayflow.llm.common import BROADCAST_IDS, at_most, saved, without_ids
from assayflow.llm.decontaminate import drop_leaking
from assayflow.llm.exact_dedup import exact_dedup
from assayflow.llm.jaccard import jaccard_components
from assayflow.llm.packing import pack


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality_score(model)(docs["text"]) >= THRESHOLD)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    gone = exact_dedup(docs, keep="max").filter("not kept").select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_digest"))
    gone = saved(gone.distinct(), "copies")
    side = F.broadcast(gone) if at_most(gone, BROADCAST_IDS // 4) else gone  # an id and 32 bytes a row
    digest = F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256))
    return docs.join(side, docs["doc_id"].eqNullSafe(side["gone_id"]) & (digest == side["gone_digest"]), "left_anti")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates."""
    return without_ids(docs, jaccard_components(docs).filter("doc_id <> component_id").select("doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences."""
    return pack(docs).drop("cluster")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact),
    ("n-gram Jaccard join", drop_near),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_bins),
]

#: The trees of the classifier and the greedy packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    sf_dir = sf_dir.rstrip("/")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
