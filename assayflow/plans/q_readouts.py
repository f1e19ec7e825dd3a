"""§2.15 readout-table builder queries and the censored-collapse aggregates of §2.8."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.functions import scalar as S
from assayflow.operators import readouts as RD
from assayflow.plans.inputs import Tables
from assayflow.plans.q_metrics import r6
from assayflow.plans.registry import query
from assayflow.plans.sql_inputs import MEAS
from assayflow.session import scratch_dir

# Fixed values for the stand-in: definition id of each readout
DEFINITIONS = {"1": "activity", "2": "target", "3": "units"}


def _json_rows(spark, sf):
    """Write the measurement rows as JSON lines (readouts object keyed by definition id) and read them back."""
    m = Tables(spark, sf).measurement_rows()
    readouts = F.struct(
        F.struct(F.col("activity").alias("value"), F.col("modifier").alias("modifier")).alias("1"),
        F.col("target").alias("2"),
        F.col("units").alias("3"),
    )
    path = scratch_dir(spark, "readouts-json")
    m.select("row", "molecule", "protocol", readouts.alias("readouts")).write.mode("overwrite").json(path)
    return spark.read.schema("row long, molecule long, protocol string, readouts string").json(path)


DECODED_SQL = f"""WITH {MEAS}
SELECT row, '1' AS definition, activity AS value_num, CAST(NULL AS VARCHAR) AS text, modifier FROM meas
UNION ALL SELECT row, '2', NULL, target, '=' FROM meas UNION ALL SELECT row, '3', NULL, units, '=' FROM meas"""


@query("src_readout_json", DECODED_SQL)
def q_readout_json(spark, sf):
    d = RD.decode_readouts(_json_rows(spark, sf))
    return d.select("row", "definition", "value_num", F.when(F.col("value_num").isNull(), F.col("value_str")).alias("text"), "modifier")


@query("rd_wide_readouts", f"WITH {MEAS} SELECT row, activity, target, units FROM meas")
def q_wide(spark, sf):
    long = Tables(spark, sf).measurements_long()
    w = RD.wide_readouts(long.withColumn("v", F.coalesce(F.col("value_num").cast("string"), F.col("value_str"))), ["row"], "readout", "v",
                         ["activity", "target", "units"])
    return w.select("row", F.col("activity").cast("double").alias("activity"), "target", "units")


@query("rd_meta_pairs", f"WITH {MEAS} SELECT row, activity AS value, modifier, 'target:' || target || '|units:' || units AS terms FROM meas")
def q_meta_pairs(spark, sf):
    mp = RD.meta_pairs(Tables(spark, sf).measurements_long(), ["row"], "readout", "activity")
    return mp.select("row", "value", "modifier", S.name_string(F.col("terms")).alias("terms"))


@query("rd_distinct_values", f"WITH {MEAS} SELECT DISTINCT target AS value_str FROM meas")
def q_distinct_values(spark, sf):
    return RD.distinct_readout_values(Tables(spark, sf).measurements_long(), "readout", "target")


COLLAPSE_SQL = """SELECT {keys}, CASE WHEN count(*) FILTER (WHERE modifier = '=') > 0 THEN '=' WHEN count(*) FILTER (WHERE modifier IN ('>', '>=')) > 0 THEN '>' ELSE '<' END AS modifier,
  round(CASE WHEN count(*) FILTER (WHERE modifier = '=') > 0 THEN avg(activity) FILTER (WHERE modifier = '=')
       WHEN count(*) FILTER (WHERE modifier IN ('>', '>=')) > 0 THEN max(activity) FILTER (WHERE modifier IN ('>', '>='))
       ELSE min(activity) FILTER (WHERE modifier IN ('<', '<=')) END, 6) AS value,
  round(CASE WHEN count(*) FILTER (WHERE modifier = '=') > 0 THEN CASE WHEN count(*) FILTER (WHERE modifier = '=' AND activity <= 0) = 0 THEN avg(log10(activity)) FILTER (WHERE modifier = '=') END
       WHEN count(*) FILTER (WHERE modifier IN ('>', '>=')) > 0 THEN log10(max(activity) FILTER (WHERE modifier IN ('>', '>=')))
       ELSE log10(min(activity) FILTER (WHERE modifier IN ('<', '<='))) END, 6) AS log_value, count(*) AS n_readings"""


@query("agg_censored_value", f"WITH {MEAS} " + COLLAPSE_SQL.format(keys="protocol, molecule") + " FROM meas GROUP BY protocol, molecule")
def q_censored_value(spark, sf):
    r = Tables(spark, sf).measurement_rows().withColumnRenamed("activity", "value")
    c = RD.collapse_censored(r, ["protocol", "molecule"], mixed="greater")
    return c.select("protocol", "molecule", "modifier", r6(F.col("value")).alias("value"), r6(F.col("log_value")).alias("log_value"), "n_readings")


TERMS_SQL = """tl AS (SELECT protocol, molecule, row, 'target' AS key, target AS value FROM meas UNION ALL SELECT protocol, molecule, row, 'units', units FROM meas),
gs AS (SELECT protocol, molecule, count(DISTINCT row) AS gs FROM meas GROUP BY ALL),
kv AS (SELECT protocol, molecule, key, value, count(DISTINCT row) AS c FROM tl GROUP BY ALL),
ct AS (SELECT kv.protocol, kv.molecule, key, value FROM kv JOIN gs ON kv.protocol = gs.protocol AND kv.molecule = gs.molecule WHERE c = gs)"""


@query("agg_common_terms", f"WITH {MEAS}, {TERMS_SQL} SELECT * FROM ct")
def q_common_terms(spark, sf):
    r = Tables(spark, sf).measurement_rows()
    tl = r.select("protocol", "molecule", "row", F.explode(F.create_map(F.lit("target"), F.col("target"), F.lit("units"), F.col("units"))).alias("key", "value"))
    return RD.common_terms(tl, ["protocol", "molecule"], ["row"], "key", "value")


GROUP_SQL = f"""{MEAS}, gt AS (SELECT *, md5(concat_ws(':', protocol, 'activity', target, units)) AS table_key FROM meas)"""


def _grouped(spark, sf):
    r = Tables(spark, sf).measurement_rows()
    return RD.group_tables(r, "protocol", ["target", "units"], "activity", "row")


SPLITS_SQL = f"""{MEAS}, sp AS (SELECT row, protocol, s.target AS target, s.units AS units, md5(concat_ws(':', protocol, 'activity', s.target, s.units)) AS table_key
  FROM (SELECT row, protocol, unnest([{{'target': target, 'units': units}}, {{'target': 'NA', 'units': units}}, {{'target': target, 'units': 'NA'}}]) AS s FROM meas)),
members AS (SELECT protocol, table_key, list(row ORDER BY row) AS m FROM sp GROUP BY ALL),
kept AS (SELECT min(table_key) AS table_key FROM members GROUP BY protocol, m)"""


@query("rd_group_tables", f"WITH {SPLITS_SQL} SELECT table_key, protocol, target, units, count(*) AS n_rows FROM sp WHERE table_key IN (SELECT table_key FROM kept) GROUP BY ALL")
def q_group_tables(spark, sf):
    """Splits by target and units, by units alone and by target alone; units tell the target, so half of the splits are equal to others."""
    r = Tables(spark, sf).measurement_rows()
    none = F.lit(None).cast("string")
    variants = [F.struct(F.col("target").alias("target"), F.col("units").alias("units")), F.struct(none.alias("target"), F.col("units").alias("units")),
                F.struct(F.col("target").alias("target"), none.alias("units"))]
    split = r.select("row", "protocol", F.explode(F.array(*variants)).alias("s")).select("row", "protocol", "s.*")
    g = RD.group_tables(split, "protocol", ["target", "units"], "activity", "row")
    named = [F.coalesce(c, F.lit("NA")).alias(c) for c in ("target", "units")]
    return g.groupBy("table_key", "protocol", *named).agg(F.count(F.lit(1)).alias("n_rows"))


def _features(t):
    return t.customer.select(F.col("c_custkey").alias("molecule"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"))


DATA_SQL = f"""{GROUP_SQL}, col AS ({COLLAPSE_SQL.format(keys='table_key, molecule').replace('round(', '(').replace(', 6) AS', ') AS')} FROM gt GROUP BY table_key, molecule),
ft AS (SELECT col.*, c.c_acctbal AS acctbal FROM col JOIN customer c ON col.molecule = c.c_custkey),
big AS (SELECT table_key FROM ft GROUP BY 1 HAVING count(*) > 100)"""


@query("rd_data_table", f"WITH {DATA_SQL} SELECT table_key, molecule, modifier, round(value, 6) AS label, round(log_value, 6) AS log_label, acctbal FROM ft WHERE table_key IN (SELECT table_key FROM big)")
def q_data_table(spark, sf):
    t = Tables(spark, sf)
    g = _grouped(spark, sf).withColumnRenamed("activity", "value")
    d = RD.data_tables(g, "table_key", "molecule", _features(t).select("molecule", "acctbal"), mixed="greater")
    return d.select("table_key", "molecule", "modifier", r6(F.col("label")).alias("label"), r6(F.col("log_label")).alias("log_label"), "acctbal")


@query("rd_all_tables", f"WITH {DATA_SQL} SELECT table_key, count(*) AS n_rows FROM ft WHERE table_key IN (SELECT table_key FROM big) GROUP BY 1")
def q_all_tables(spark, sf):
    t = Tables(spark, sf)
    g = _grouped(spark, sf).withColumnRenamed("activity", "value")
    d = RD.data_tables(g, "table_key", "molecule", _features(t).select("molecule", "acctbal"), mixed="greater")
    return d.groupBy("table_key").agg(F.count(F.lit(1)).alias("n_rows"))


@query("rd_complete_features", """WITH m AS (SELECT DISTINCT user_id AS molecule FROM events)
SELECT m.molecule, c.c_acctbal IS NOT NULL AND s.s_acctbal IS NOT NULL AND o.n IS NOT NULL AS complete FROM m
LEFT JOIN customer c ON m.molecule = c.c_custkey LEFT JOIN supplier s ON m.molecule = s.s_suppkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON m.molecule = o.o_custkey""")
def q_complete_features(spark, sf):
    t = Tables(spark, sf)
    mols = t.events.select(F.col("user_id").alias("molecule")).distinct()
    f1 = t.customer.select(F.col("c_custkey").alias("molecule"), F.col("c_acctbal").alias("acctbal"))
    f2 = t.supplier.select(F.col("s_suppkey").alias("molecule"), F.col("s_acctbal").alias("supplier_acctbal"))
    f3 = t.orders.groupBy(F.col("o_custkey").alias("molecule")).agg(F.count(F.lit(1)).alias("n_orders"))
    c = RD.complete_features(mols, "molecule", [f1, f2, f3], ["acctbal", "supplier_acctbal", "n_orders"])
    return c.select("molecule", F.col("features").isNotNull().alias("complete"))


# Fixed values for the stand-in: unit label of each protocol's activity definition
DEF_UNITS = {"view": "%", "error": "ug/mL", "click": "uM"}
DEF_UNIT_SQL = "CASE protocol WHEN 'view' THEN '%' WHEN 'error' THEN 'ug/mL' WHEN 'click' THEN 'uM' END"


def _def_unit(col):
    out = F.lit(None).cast("string")
    for k, v in DEF_UNITS.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


UNIT_NAME_SQL = r"""CASE WHEN regexp_matches({x}, '(?:pM)|(?:(?i)pico *molar)') THEN 'Picomolar' WHEN regexp_matches({x}, '(?:nM)|(?:(?i)nano *molar)') THEN 'Nanomolar'
  WHEN regexp_matches({x}, '(?:uM)|(?:(?i)micro *molar)|(?:um)') THEN 'Micromolar' WHEN regexp_matches({x}, '(?:mM)|(?:(?i)milli *molar)') THEN 'Millimolar' END"""


@query("lab_ic50_unit", f"""WITH {GROUP_SQL}, tk AS (SELECT DISTINCT table_key, protocol, units FROM gt)
SELECT table_key, CASE WHEN {DEF_UNIT_SQL} IS NULL THEN {UNIT_NAME_SQL.format(x='units')}
  WHEN {UNIT_NAME_SQL.format(x=DEF_UNIT_SQL)} IS NOT NULL THEN {UNIT_NAME_SQL.format(x=DEF_UNIT_SQL)} END AS unit FROM tk""")
def q_ic50_unit(spark, sf):
    g = _grouped(spark, sf).select("table_key", "protocol", "units").distinct()
    return g.select("table_key", RD.ic50_unit(_def_unit(F.col("protocol")), F.array(F.col("units"))).alias("unit"))


@query("rd_regression_table", f"""WITH {DATA_SQL}, tk AS (SELECT DISTINCT table_key, protocol, units FROM gt),
u AS (SELECT table_key, CASE WHEN {DEF_UNIT_SQL} IS NULL THEN {UNIT_NAME_SQL.format(x='units')}
  WHEN {UNIT_NAME_SQL.format(x=DEF_UNIT_SQL)} IS NOT NULL THEN {UNIT_NAME_SQL.format(x=DEF_UNIT_SQL)} END AS unit FROM tk)
SELECT ft.table_key, molecule, round(CASE WHEN unit IS NOT NULL AND value > 0 THEN -(log10(value) + CASE unit WHEN 'Picomolar' THEN -12.0 WHEN 'Nanomolar' THEN -9.0 WHEN 'Micromolar' THEN -6.0 ELSE -3.0 END) ELSE value END, 6) AS label
FROM ft JOIN u ON ft.table_key = u.table_key WHERE ft.table_key IN (SELECT table_key FROM big)""")
def q_regression_table(spark, sf):
    t = Tables(spark, sf)
    g = _grouped(spark, sf)
    units = g.select("table_key", "protocol", "units").distinct().select("table_key", RD.ic50_unit(_def_unit(F.col("protocol")), F.array(F.col("units"))).alias("unit"))
    d = RD.data_tables(g.withColumnRenamed("activity", "value"), "table_key", "molecule", _features(t).select("molecule", "acctbal"), mixed="greater")
    d = d.join(units, "table_key")
    unit_units = F.when(F.col("unit") == "Picomolar", "pM").when(F.col("unit") == "Nanomolar", "nM").when(F.col("unit") == "Micromolar", "uM").when(F.col("unit") == "Millimolar", "mM")
    return d.select("table_key", "molecule", r6(RD.regression_label(F.col("label"), unit_units)).alias("label"))


@query("rd_iterate_tables", f"""WITH {DATA_SQL} SELECT table_key, count(*) AS n, count(DISTINCT round(value, 9)) AS n_distinct FROM ft WHERE table_key IN (SELECT table_key FROM big)
GROUP BY 1 HAVING count(*) >= 100 AND count(DISTINCT round(value, 9)) > 90""")
def q_iterate_tables(spark, sf):
    t = Tables(spark, sf)
    g = _grouped(spark, sf).withColumnRenamed("activity", "value")
    d = RD.data_tables(g, "table_key", "molecule", _features(t).select("molecule", "acctbal"), mixed="greater")
    it = RD.iterate_tables(d, "table_key", "label")
    return it.groupBy("table_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.round("label", 9)).alias("n_distinct"))


@query("agg_readout_count", f"""WITH {MEAS}, l AS (SELECT protocol, 'activity' AS readout, activity AS v FROM meas UNION ALL SELECT protocol, 'target', NULL FROM meas UNION ALL SELECT protocol, 'units', NULL FROM meas)
SELECT protocol, readout, count(*) AS count, count(v) AS n_numeric, count(v) > 0 AND (""" + " OR ".join(f"contains(lower(readout), '{k}')" for k in S.LEARNING_KEYWORDS) + """) AS use_readout FROM l GROUP BY protocol, readout""")
def q_readout_count(spark, sf):
    return RD.readout_counts(Tables(spark, sf).measurements_long(), ["protocol"], "readout")


@query("rd_validation_log", """WITH l AS (SELECT o_orderkey, o_orderstatus FROM orders)
SELECT 'T' || o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'Regression' WHEN 'O' THEN 'Classification' ELSE 'Both' END AS category,
  '/results/' || o_orderkey || '.csv' AS result_file FROM l""")
def q_validation_log(spark, sf):
    """A run log written as text (one name line per order, then its category line), read back and paired."""
    o = Tables(spark, sf).orders
    cat = F.when(F.col("o_orderstatus") == "F", "Regression").when(F.col("o_orderstatus") == "O", "Classification").otherwise("Both")
    lines = o.select("o_orderkey", F.array(
        F.concat(F.lit("Processing table T"), F.col("o_orderkey").cast("string")),
        F.concat(F.lit("Category "), cat, F.lit(" file /results/"), F.col("o_orderkey").cast("string"), F.lit(".csv"))).alias("ls"))
    path = scratch_dir(spark, "runlog")
    lines.orderBy("o_orderkey").select(F.array_join("ls", "\n").alias("value")).write.mode("overwrite").text(path)
    text = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    v = RD.validation_log(text, "line_no", "value", r"^Processing table (\S+)$", r"^Category (\S+) file (\S+)$")
    return v.select("name", "category", "result_file")
