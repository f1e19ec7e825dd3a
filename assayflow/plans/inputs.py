"""Driver tables and the modelling tables derived from them.

Stand-ins (SURVEY §7): documents/part text for molecules, labels for 0/1
assays, lineitem price vs quantity*retail price for regression label and
prediction, events for measurements, n_name/l_returnflag/lang for groups.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.operators.ordered import attach

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


class Tables:
    """Lazy parquet readers for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)

    # ------------------------------------------------------------ derived
    def scored_documents(self) -> DataFrame:
        """labels ⋈ documents: label = quality, probability = n_chars min-max scaled per lang."""
        j = self.labels.join(self.documents.select("doc_id", "lang", "n_chars"), "doc_id")
        rng = j.groupBy("lang").agg(F.min("n_chars").alias("__mn"), F.max("n_chars").alias("__mx"))
        return attach(j, rng, ["lang"]).select(
            "doc_id",
            "lang",
            F.col("quality").cast("double").alias("label"),
            F.col("toxic").cast("double").alias("toxic"),
            F.when(F.col("__mx") == F.col("__mn"), F.lit(0.0))
            .otherwise((F.col("n_chars") - F.col("__mn")) / (F.col("__mx") - F.col("__mn")))
            .alias("probability"),
        )

    def regression_pairs(self) -> DataFrame:
        """lineitem ⋈ part: label = l_extendedprice, prediction = l_quantity * p_retailprice."""
        li = self.lineitem.select(*LINEITEM_KEY, "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
        return li.join(self.part.select("p_partkey", "p_retailprice"), li.l_partkey == F.col("p_partkey")).select(
            *LINEITEM_KEY,
            "l_returnflag",
            "l_linestatus",
            F.col("l_extendedprice").alias("label"),
            (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"),
            "l_discount",
        )

    def measurement_rows(self) -> DataFrame:
        """events as assay measurement rows: molecule = user_id, protocol = event_type, one row per event with
        an 'activity' reading (censored at 1 and 300), and 'target' / 'units' text readouts from props.k."""
        e = self.events.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
        k, v = F.col("k"), F.col("value")
        return e.select(
            F.col("event_id").alias("row"),
            F.col("user_id").alias("molecule"),
            F.col("event_type").alias("protocol"),
            v.alias("activity"),
            F.when(v >= 300, ">").when(v < 1, "<").otherwise("=").alias("modifier"),
            F.when(k < 50, "kinase").otherwise("protease").alias("target"),
            F.when(k < 25, "uM").when(k < 50, "nM").when(k < 75, "pM").otherwise("mM").alias("units"),
        )

    def measurements_long(self) -> DataFrame:
        """Long form (row, molecule, protocol, readout, value_str, value_num, modifier)."""
        r = self.measurement_rows()
        arr = F.array(
            F.struct(F.lit("activity").alias("readout"), F.col("activity").cast("string").alias("value_str"),
                     F.col("activity").alias("value_num"), F.col("modifier").alias("modifier")),
            F.struct(F.lit("target").alias("readout"), F.col("target").alias("value_str"), F.lit(None).cast("double").alias("value_num"), F.lit("=").alias("modifier")),
            F.struct(F.lit("units").alias("readout"), F.col("units").alias("value_str"), F.lit(None).cast("double").alias("value_num"), F.lit("=").alias("modifier")),
        )
        return r.select("row", "molecule", "protocol", F.explode(arr).alias("r")).select("row", "molecule", "protocol", "r.*")
