"""Exact duplicates by a tree merge of sorted digest runs (DataFrame operations only).

Every input partition yields a run: its digests, each with the best id and
the number of copies.  Runs then meet in binomial rounds: in round ``r`` the
runs whose numbers agree after division by ``fan_in ** r`` are merged.  A
round is an aggregation over (run group, digest, check); the best id is kept
as a struct, which Spark aggregates by sorting, so each map task writes a
sorted run and each reduce task merges runs in digest order.  A digest has at
most one row a run, so a group of copies of any size stays small before it is
shuffled, and no round holds one task responsible for a whole group.

Verification: beside the 256-bit digest a run entry carries the text's byte
length and an independent 64-bit hash; entries merge only if all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.llm.common import saved


def _best(doc_id: Column, keep: str) -> tuple[Column, Column]:
    """The aggregate that keeps the smallest or largest id; a null id only wins over null ids."""
    if keep == "min":
        return F.struct(doc_id.isNull().alias("flag"), doc_id.alias("id")), F.min("best").alias("best")
    if keep == "max":
        return F.struct(doc_id.isNotNull().alias("flag"), doc_id.alias("id")), F.max("best").alias("best")
    raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    * A null text counts as the empty text; empty texts are equal to each other.
    * Of equal texts the row with the smallest (``keep="min"``) or largest (``"max"``) id stays.  A row with a null
      id stays only if all its copies have null ids.
    * Repeated rows (same id and text) share one decision: all stay or all go; each counts in ``group_size``.
    * Other columns, whatever their names, are not looked at.  An empty table gives an empty result.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    marked = docs.select(
        docs[id_col].alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).alias("bytes"),
        F.spark_partition_id().alias("run"),
    )
    marked = saved(marked, "digests")
    key = ["digest", "check", "bytes"]
    struct, best = _best(F.col("doc_id"), keep)
    runs = (marked.agg(F.max("run")).first()[0] or 0) + 1
    merged = marked.select("run", *key, struct.alias("best"), F.lit(1).cast("long").alias("copies"))
    while True:
        merged = merged.withColumn("run", F.expr(f"run div {fan_in}").cast("int"))
        merged = merged.groupBy("run", *key).agg(best, F.sum("copies").alias("copies"))
        runs = -(-runs // fan_in)
        if runs == 1:
            break
    groups = merged.filter("copies > 1").select(
        *[F.col(c).alias(f"g_{c}") for c in key], F.col("best.id").alias("best_id"), "copies"
    )
    # rows of a large group are split over tasks by the skew handling of the join
    joined = marked.join(groups, [F.col(c) == F.col(f"g_{c}") for c in key], "left")
    grouped = F.col("copies").isNotNull()
    keep_id = F.when(grouped, F.col("best_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
