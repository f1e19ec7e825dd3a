"""Conflict-constrained best-fit packing of documents into fixed-length training sequences.

Documents are cut into pieces of at most ``capacity`` tokens (whole pieces
fill a bin alone).  The remaining pieces are dealt into shards of bounded size
by a hash of the id, so a frequent source or a large duplicate cluster is
spread evenly, and each shard is packed on its own: longest piece first, bins
ordered by residual space, each bin carrying a bitmap of its sources and one
of its duplicate clusters.  The search begins at the smallest residual that
holds the piece and goes to the successor until a compatible bin is found.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from assayflow.llm.common import encoded, saved

CAPACITY = 2048
#: Pieces packed together on average; the number of shards follows the number of pieces.
SHARD_ROWS = 2048
PACKED = "doc_id long, piece int, bin_id string, start_token long, n_tokens long, bin_offset long, source string, cluster long"


@pandas_udf(LongType())
def count_words(text: pd.Series) -> pd.Series:
    """Words between ASCII blanks in the whole text; null texts have none."""
    return pd.Series([len(encoded(t).split()) for t in text])


class Bins:
    """Bins ordered by (residual, number), with bitmaps of the sources and clusters inside."""

    def __init__(self, capacity: int):
        self.capacity, self.order, self.used, self.sources, self.clusters = capacity, [], [], [], []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of the tightest bin that has room and neither bit set; a new bin if there is none."""
        at = bisect_left(self.order, (length, -1))
        for k in range(at, len(self.order)):
            residual, b = self.order[k]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del self.order[k]
                offset = self.used[b]
                self.used[b] += length
                self.sources[b] |= source
                self.clusters[b] |= cluster
                insort(self.order, (residual - length, b))
                return b, offset
        b = len(self.used)
        self.used.append(length)
        self.sources.append(source)
        self.clusters.append(cluster)
        insort(self.order, (self.capacity - length, b))
        return b, 0


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack the pieces of one shard; ties are broken by id and piece, so the result does not depend on row order."""
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable", na_position="last")
    sources = {v: 1 << i for i, v in enumerate(pdf["source"].dropna().unique())}
    repeated = pdf["cluster"].dropna().value_counts()
    clusters = {v: 1 << i for i, v in enumerate(sorted(repeated[repeated > 1].index))}  # a single member has no conflict
    bins, at = Bins(capacity), []
    for n, s, c in zip(pdf["n_tokens"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist()):
        at.append(bins.place(n, sources.get(s, 0), clusters.get(c, 0)))
    shard = str(pdf["shard"].iloc[0])
    return pdf.assign(bin_id=[f"{shard}-{b}" for b, _ in at], bin_offset=[o for _, o in at])[[x.split()[0] for x in PACKED.split(", ")]]


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", cluster_col: str | None = None,
    capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per piece of each document: doc_id, piece, bin_id, start_token, n_tokens, bin_offset, source, cluster.

    * No bin holds more than ``capacity`` tokens, two pieces of one source, or two documents of one duplicate cluster.
      A null source or cluster conflicts with nothing.  Without ``cluster_col`` documents with equal texts (64-bit
      hash, null as empty) are a cluster.
    * A document of more than ``capacity`` tokens gives full pieces, each a bin of its own, and a remainder.
    * A document without tokens (null, empty or blank text) is one piece of length 0 and is placed like any other.
    * Repeated rows are packed each; a null id is kept.  Other columns are not looked at.  Empty in, empty out.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    sized = saved(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            (docs[source_col].cast("string") if source_col else F.lit(None).cast("string")).alias("source"),
            (docs[cluster_col].cast("long") if cluster_col else F.xxhash64(text)).alias("cluster"),
            count_words(docs[text_col]).alias("words"),
        ),
        "sized",
    )
    rows = sized.count()
    # rows alike in all that counts are numbered among themselves, so that they are spread like others
    alike = ["doc_id", "source", "cluster", "words"]
    sized = sized.groupBy(*alike).agg(F.count(F.lit(1)).alias("times")).withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    # floor(words / capacity) full pieces and the rest; an exact multiple has no rest
    full = F.expr(f"words div {capacity}")
    pieces = sized.withColumn("full", full)
    whole = pieces.filter("full > 0").select(
        "doc_id", F.explode(F.expr("sequence(0, cast(full - 1 as int))")).alias("piece"), "source", "cluster", "copy", F.xxhash64("doc_id", "cluster", "source").alias("own")
    )
    whole = whole.select(
        "doc_id",
        "piece",
        F.concat(F.lit("f"), F.hex("own"), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.col("piece").cast("string"), F.lit("-"), F.col("copy").cast("string")).alias("bin_id"),
        (F.col("piece") * F.lit(capacity)).cast("long").alias("start_token"),
        F.lit(capacity).cast("long").alias("n_tokens"),
        F.lit(0).cast("long").alias("bin_offset"),
        "source",
        "cluster",
    )
    rest = pieces.filter(f"full = 0 or words % {capacity} > 0").select(
        "doc_id",
        F.col("full").cast("int").alias("piece"),
        (F.col("full") * capacity).cast("long").alias("start_token"),
        F.expr(f"words % {capacity}").cast("long").alias("n_tokens"),
        "source",
        "cluster",
        "copy",
    )
    shards = max(1, -(-rows // shard_rows))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "source", "copy"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(lambda pdf: pack_shard(pdf, capacity), PACKED)
    return packed.unionByName(whole)
