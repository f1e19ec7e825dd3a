"""§2.1 source and §2.2 sink queries: each writes a table derived from the driver data into the
shared scratch folder (``spark.checkpoint.dir``) and reads it back through the operator under test."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from assayflow.plans.inputs import Tables
from assayflow.plans.q_metrics import r6
from assayflow.plans.registry import query
from assayflow.session import scratch_dir
from assayflow.sources import tables as IO


@query("src_typed_csv", """SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_size, p_retailprice, p_name || chr(10) || '"' || p_brand || '", ' || p_type AS note FROM part""")
def q_typed_csv(spark, sf):
    """Texts with line breaks, quotes and separators come back as they were."""
    note = F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", '), "p_type").alias("note")
    p = Tables(spark, sf).part.select(F.col("p_partkey").cast("int"), "p_name", "p_brand", "p_size", "p_retailprice", note)
    path = scratch_dir(spark, "typed-csv")
    IO.write_typed_csv(p, path, gzip=True)
    return IO.read_typed_csv(spark, path)


@query("sink_typed_csv", "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 3) AS total FROM embeddings")
def q_sink_typed_csv(spark, sf):
    e = Tables(spark, sf).embeddings.select(F.col("vec_id").cast("int"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    path = scratch_dir(spark, "typed-vec")
    IO.write_typed_csv(e, path)
    back = IO.read_typed_csv(spark, path)
    return back.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.size("embedding").alias("n"),
                       F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


INT_RE = "regexp_full_match(CAST({c} AS VARCHAR), '[+-]?[0-9]+') AND TRY_CAST(CAST({c} AS VARCHAR) AS BIGINT) BETWEEN -2147483648 AND 2147483647"


def _infer_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", CASE WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND NOT ({INT_RE.format(c=c)})) = 0 THEN 'Int'
  WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) = 0 THEN 'Double' ELSE 'String' END AS type FROM customer""")
    return " UNION ALL ".join(parts)


CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("src_infer_types", _infer_sql(CUSTOMER_COLS))
def q_infer_types(spark, sf):
    c = Tables(spark, sf).customer
    path = scratch_dir(spark, "untyped-csv")
    IO.write_typed_csv(c, path, write_types=False)
    raw = spark.read.option("header", True).csv(path)
    return IO.inferred_types(raw)


@query("src_parquet", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def q_parquet(spark, sf):
    li = spark.read.parquet(f"{sf.rstrip('/')}/lineitem.parquet")
    return li.select("l_orderkey", "l_quantity", "l_returnflag")


@query("src_csv_dir", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def q_csv_dir(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = scratch_dir(spark, "csv-dir")
    o.repartition(4).write.mode("overwrite").option("header", True).csv(path)
    return IO.read_csv_dir(spark, path, o.schema)


def _records(spark, sf):
    p = Tables(spark, sf).part
    path = scratch_dir(spark, "records")
    IO.write_records(p, path, "p_name", ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"])
    return IO.read_records(spark, path)


@query("src_record_text", "SELECT p_name AS title, p_partkey, p_brand, p_type, p_size FROM part")
def q_record_text(spark, sf):
    r = _records(spark, sf)
    f = F.col("fields")
    return r.select("title", f["p_partkey"].cast("bigint").alias("p_partkey"), f["p_brand"].alias("p_brand"), IO.field_column(r, "p_type").alias("p_type"),
                    IO.field_column(r, "p_size", numeric=True).cast("int").alias("p_size"))


@query("src_record_fields", """SELECT 'p_partkey' AS field, count(*) AS present, count(*) AS n_numeric, true AS numeric FROM part
UNION ALL SELECT 'p_brand', count(*), 0, false FROM part UNION ALL SELECT 'p_type', count(*), 0, false FROM part
UNION ALL SELECT 'p_size', count(*), count(*), true FROM part UNION ALL SELECT 'p_retailprice', count(*), count(*), true FROM part""")
def q_record_fields(spark, sf):
    return IO.record_fields(_records(spark, sf))


@query("src_smiles_lines", "SELECT replace(p_name, ' ', '.') AS smiles, CAST(p_partkey AS VARCHAR) AS id FROM part")
def q_smiles_lines(spark, sf):
    p = Tables(spark, sf).part
    path = scratch_dir(spark, "smiles")
    p.select(F.concat_ws(" ", F.regexp_replace("p_name", " ", "."), F.col("p_partkey").cast("string")).alias("value")).write.mode("overwrite").text(path)
    return IO.read_smiles_lines(spark, path)


# Fixed values for the query below: the recipe of fields to load from the part record file
RECIPE = [
    {"file": "part", "response": "p_size", "category": "continuous", "transform": "log10"},
    {"file": "part", "response": "p_retailprice", "category": "continuous", "transform": "none"},
    {"file": "part", "response": "p_type", "category": "categorical", "transform": None},
    {"file": "supplier", "response": "p_brand", "category": "categorical", "transform": None},
]


@query("src_recipe_json", r"""SELECT p_partkey AS key, 'p_size' AS response, 'continuous' AS category, CAST(p_size AS VARCHAR) AS raw, round(log10(p_size), 6) AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', 'continuous', CAST(p_retailprice AS VARCHAR), round(p_retailprice, 6) FROM part
UNION ALL SELECT p_partkey, 'p_type', 'categorical', p_type, NULL FROM part""")
def q_recipe(spark, sf):
    r = _records(spark, sf).select(F.col("fields")["p_partkey"].cast("bigint").alias("key"), "fields")
    path = scratch_dir(spark, "recipe")
    spark.createDataFrame([(json.dumps(RECIPE),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    recipe = IO.read_recipe(spark, path)
    out = IO.apply_recipe(r, "key", recipe, "part")
    return out.select("key", "response", "category", "raw", r6(F.col("value")).alias("value"))


@query("src_system_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def q_system_scan(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_quantity", "l_returnflag")
    root = scratch_dir(spark, "systems")
    IO.write_systems(li, root, "l_returnflag")
    s = IO.scan_systems(spark, root, "l_returnflag", include=["A", "N", "R"], exclude=["N"])
    return s.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("src_label_columns", "SELECT d.lang AS activity_string, CAST(l.quality AS DOUBLE) AS activity_value, CAST(l.toxic AS DOUBLE) AS activity_value_2 FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def q_label_columns(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.join(t.labels, "doc_id").select("doc_id", F.col("lang").alias("activity_string"), F.col("quality").cast("double").alias("activity_value"),
                                                    F.col("toxic").cast("double").alias("activity_value_2"), "n_chars")
    return IO.label_columns(j)


@query("src_vector_width", "SELECT label, CAST(max(len(embedding)) AS INTEGER) AS width FROM embeddings GROUP BY 1")
def q_vector_width(spark, sf):
    return IO.vector_width(Tables(spark, sf).embeddings, ["label"], "embedding")


@query("sink_parquet", "SELECT o_orderkey, o_orderstatus FROM orders")
def q_sink_parquet(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus")
    path = scratch_dir(spark, "pq")
    IO.write_parquet(o.filter(F.col("o_orderstatus") == "F"), path, "overwrite")
    IO.write_parquet(o.filter(F.col("o_orderstatus") != "F"), path, "append")
    return spark.read.parquet(path)


@query("sink_single_csv", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_total FROM orders GROUP BY 1")
def q_single_csv(spark, sf):
    o = Tables(spark, sf).orders
    res = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_total"))
    path = scratch_dir(spark, "single-csv")
    IO.write_single_csv(res, path)
    return spark.read.option("header", True).schema(res.schema).csv(path)


def _flag_summary(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("NAME")).agg(F.count(F.lit(1)).alias("n"))


@query("sink_append_once", "SELECT l_returnflag AS NAME, count(*) AS n FROM lineitem GROUP BY 1")
def q_append_once(spark, sf):
    s = _flag_summary(Tables(spark, sf))
    path = scratch_dir(spark, "append-once")
    IO.append_once(spark, s.filter(F.col("NAME").isin("A", "N")), path)
    IO.append_once(spark, s, path)
    IO.append_once(spark, s, path)
    return spark.read.parquet(path)


@query("sink_skip_done", "SELECT DISTINCT l_returnflag AS NAME FROM lineitem WHERE l_returnflag <> 'A'")
def q_skip_done(spark, sf):
    t = Tables(spark, sf)
    path = scratch_dir(spark, "skip-done")
    _flag_summary(t).filter(F.col("NAME") == "A").write.mode("overwrite").parquet(path)
    todo = t.lineitem.select(F.col("l_returnflag").alias("NAME")).distinct()
    return IO.skip_done(spark, todo, path)


@query("sink_materialize_once", "SELECT l_returnflag AS NAME, count(*) AS n FROM lineitem GROUP BY 1")
def q_materialize_once(spark, sf):
    t = Tables(spark, sf)
    path = scratch_dir(spark, "materialize")
    first = IO.materialize_once(spark, path, lambda: _flag_summary(t))
    return IO.materialize_once(spark, path, lambda: first.limit(0))


@query("fn_strip_type", "SELECT p_partkey, p_name, p_size FROM part")
def q_strip_type(spark, sf):
    p = Tables(spark, sf).part.select("p_partkey", "p_name", "p_size")
    path = scratch_dir(spark, "strip-type")
    IO.write_typed_csv(p, path)
    raw = spark.read.option("header", True).csv(path)
    s = IO.strip_types(raw)
    return s.select(F.col("p_partkey").cast("bigint"), "p_name", F.col("p_size").cast("int"))
