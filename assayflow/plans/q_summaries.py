"""§2.8 summaries, grouping and best-of-group queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.operators import metrics as M
from assayflow.operators import summaries as S
from assayflow.plans.inputs import Tables
from assayflow.plans.q_metrics import SCORED_PRED, _scored, r6
from assayflow.plans.registry import query
from assayflow.plans.sql_inputs import REGRESSION, f1

STATS = ("mean", "min", "max", "variance", "sd")


@query("agg_summary_stats", """SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean,
  round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max,
  round(var_pop(l_extendedprice), 2) AS variance, round(stddev_pop(l_extendedprice), 4) AS sd
FROM lineitem GROUP BY l_returnflag""")
def q_summary_stats(spark, sf):
    s = S.summary_stats(Tables(spark, sf).lineitem, ["l_returnflag"], "l_extendedprice")
    return s.select("l_returnflag", "count", *[F.round(c, 2 if c == "variance" else 4).alias(c) for c in STATS])


VEC_LONG = """vl AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings)"""


@query("agg_vec_stats", f"""WITH {VEC_LONG}
SELECT CAST(pos AS INTEGER) AS pos, count(v) AS count, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max,
  round(var_pop(v), 6) AS variance, round(stddev_pop(v), 6) AS sd FROM vl GROUP BY pos""")
def q_vec_stats(spark, sf):
    from assayflow.operators.features import vector_stats

    s = vector_stats(Tables(spark, sf).embeddings, "embedding")
    return s.select("pos", "count", *[r6(F.col(c)).alias(c) for c in STATS])


@query("agg_descriptive", """WITH m AS (SELECT l_returnflag, l_discount AS x, avg(l_discount) OVER (PARTITION BY l_returnflag) AS mu,
  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
mo AS (SELECT l_returnflag, any_value(n) AS n, any_value(mu) AS mean, avg(power(x - mu, 2)) AS m2, avg(power(x - mu, 3)) AS m3,
  avg(power(x - mu, 4)) AS m4, stddev_samp(x) AS sd, var_samp(x) AS variance, exp(avg(ln(x))) AS gm FROM m GROUP BY l_returnflag),
o AS (SELECT l_returnflag, x, row_number() OVER (PARTITION BY l_returnflag ORDER BY x) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM m),
med AS (SELECT l_returnflag, CASE WHEN 0.5 * (n + 1) < 1 THEN min(x) WHEN 0.5 * (n + 1) >= n THEN max(x)
  ELSE max(x) FILTER (WHERE rn = floor(0.5 * (n + 1))) + (0.5 * (n + 1) - floor(0.5 * (n + 1))) *
      (coalesce(max(x) FILTER (WHERE rn = floor(0.5 * (n + 1)) + 1), 0) - max(x) FILTER (WHERE rn = floor(0.5 * (n + 1)))) END AS median
  FROM o GROUP BY l_returnflag, n)
SELECT mo.l_returnflag, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(variance, 6) AS variance, round(gm, 6) AS geometric_mean,
  round(m3 / power(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 6) AS skewness,
  round(((n + 1) * (m4 / (m2 * m2) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)), 6) AS kurtosis, round(median, 6) AS median
FROM mo JOIN med ON mo.l_returnflag = med.l_returnflag""")
def q_descriptive(spark, sf):
    d = S.descriptive(Tables(spark, sf).lineitem, ["l_returnflag"], "l_discount")
    return d.select("l_returnflag", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "variance", "geometric_mean", "skewness", "kurtosis", "median")])


def _pct_sql(table, by, x, ps, method):
    pos = [f"{p / 100.0!r} * (n + 1)" if method == "n+1" else f"1 + {p / 100.0!r} * (n - 1)" for p in ps]
    cols = []
    for i, t in enumerate(pos):
        lo = f"floor({t})"
        cols.append(
            f"""round(CASE WHEN {t} < 1 THEN min(x) WHEN {t} >= n THEN max(x) ELSE
  max(x) FILTER (WHERE rn = {lo}) + ({t} - {lo}) * (max(x) FILTER (WHERE rn = {lo} + 1) - max(x) FILTER (WHERE rn = {lo})) END, 6) AS p{i}"""
        )
    return f"""WITH o AS (SELECT {by}, CAST({x} AS DOUBLE) AS x, row_number() OVER (PARTITION BY {by} ORDER BY {x}) AS rn,
  count(*) OVER (PARTITION BY {by}) AS n FROM {table} WHERE {x} IS NOT NULL)
SELECT {by}, {', '.join(cols)} FROM o GROUP BY {by}, n"""


@query("agg_percentile_n1", _pct_sql("orders", "o_orderpriority", "o_totalprice", [5.0, 25.0, 50.0, 90.0, 99.5], "n+1"))
def q_percentile_n1(spark, sf):
    p = S.percentiles(Tables(spark, sf).orders, ["o_orderpriority"], "o_totalprice", [5.0, 25.0, 50.0, 90.0, 99.5], "n+1",
                      [f"p{i}" for i in range(5)])
    return p.select("o_orderpriority", *[r6(F.col(f"p{i}")).alias(f"p{i}") for i in range(5)])


@query("agg_label_scale", f"WITH {REGRESSION} SELECT l_returnflag, round(avg(abs(label)), 6) AS label_scale FROM reg GROUP BY ALL")
def q_label_scale(spark, sf):
    m = M.label_scale(Tables(spark, sf).regression_pairs(), ["l_returnflag"], "label")
    return m.select("l_returnflag", r6(F.col("label_scale")).alias("label_scale"))


ASSAYS_SQL = """assays AS (SELECT doc_id, 'quality' AS assay, CAST(quality AS DOUBLE) AS active FROM labels
  UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels)"""


def _assays(t):
    return t.labels.select("doc_id", F.expr("stack(2, 'quality', CAST(quality AS DOUBLE), 'toxic', CAST(toxic AS DOUBLE)) AS (assay, active)"))


@query("agg_hitrate", f"""WITH {ASSAYS_SQL} SELECT assay, count(active) AS n_compounds, CAST(sum(active) AS BIGINT) AS n_active,
  round(avg(active), 6) AS hitrate FROM assays GROUP BY assay""")
def q_hitrate(spark, sf):
    h = S.hitrate(_assays(Tables(spark, sf)), ["assay"], "active")
    return h.select("assay", "n_compounds", "n_active", r6(F.col("hitrate")).alias("hitrate"))


@query("agg_hitrate_tested", f"""WITH {ASSAYS_SQL},
tested AS (SELECT d.doc_id, a.assay, a.active FROM documents d LEFT JOIN assays a ON d.doc_id = a.doc_id WHERE a.active IS NOT NULL),
st AS (SELECT assay, count(*) AS tested, count(*) FILTER (WHERE active = 1) AS hits FROM tested GROUP BY assay)
SELECT t.assay, t.doc_id, st.tested, st.hits, round(st.hits / st.tested, 6) AS hitrate
FROM tested t JOIN st ON t.assay = st.assay WHERE t.active = 1""")
def q_hitrate_tested(spark, sf):
    from assayflow.operators.screening import hitrate_tested

    t = Tables(spark, sf)
    return hitrate_tested(t.documents.select("doc_id"), _assays(t), "doc_id", "assay", "active").select(
        "assay", "doc_id", "tested", "hits", r6(F.col("hitrate")).alias("hitrate")
    )


@query("agg_hitrate_compare", f"""WITH {SCORED_PRED.replace('WITH', '')},
r AS (SELECT lang, avg(label) AS real_rate, avg(prediction) AS predicted_rate FROM sp GROUP BY lang)
SELECT lang, 'real' AS kind, round(real_rate, 6) AS rate FROM r UNION ALL SELECT lang, 'predicted', round(predicted_rate, 6) FROM r""")
def q_hitrate_compare(spark, sf):
    r = _scored(spark, sf).groupBy("lang").agg(F.avg("label").alias("real"), F.avg("prediction").alias("predicted"))
    return r.unpivot("lang", ["real", "predicted"], "kind", "rate").select("lang", "kind", r6(F.col("rate")).alias("rate"))


@query("agg_group_mean", _pct_sql("lineitem", "l_returnflag", "l_discount", [50.0], "n+1").replace(
    "SELECT l_returnflag, round(", "SELECT l_returnflag, round(avg(x), 6) AS mean, round(").replace(" AS p0", " AS median"))
def q_group_mean(spark, sf):
    li = Tables(spark, sf).lineitem
    mean = li.groupBy("l_returnflag").agg(F.avg("l_discount").alias("mean"))
    med = S.percentiles(li, ["l_returnflag"], "l_discount", [50.0], "n+1", ["median"])
    return mean.join(med, "l_returnflag").select("l_returnflag", r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"))


@query("agg_group_sum_filtered", """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total
FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL""")
def q_group_sum_filtered(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.filter(F.col("l_discount") > 0.05).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("agg_describe", _pct_sql("customer", "c_mktsegment", "c_acctbal", [25.0, 50.0, 75.0], "n-1").replace(
    "SELECT c_mktsegment, round(", "SELECT c_mktsegment, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round("))
def q_describe(spark, sf):
    c = Tables(spark, sf).customer
    base = c.groupBy("c_mktsegment").agg(F.count("c_acctbal").alias("count"), F.avg("c_acctbal").alias("mean"),
                                         F.stddev_samp("c_acctbal").alias("std"), F.min("c_acctbal").alias("min"), F.max("c_acctbal").alias("max"))
    q = S.percentiles(c, ["c_mktsegment"], "c_acctbal", [25.0, 50.0, 75.0], "n-1", ["p0", "p1", "p2"])
    j = base.join(q, "c_mktsegment")
    return j.select("c_mktsegment", "count", *[r6(F.col(x)).alias(x) for x in ("mean", "std", "min", "max", "p0", "p1", "p2")])


@query("agg_value_counts", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def q_value_counts(spark, sf):
    return S.value_counts(Tables(spark, sf).orders, [], "o_orderpriority")


@query("agg_arg_best", """SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ASC) AS rn FROM orders) WHERE rn = 1""")
def q_arg_best(spark, sf):
    o = Tables(spark, sf).orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return S.arg_best(o, ["o_custkey"], "o_totalprice", True, tie=["o_orderkey"])


@query("agg_arg_best_multi", """SELECT c.o_custkey, c.o_orderkey AS best_by_price, t.o_orderkey AS first_order FROM
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders) WHERE rn = 1) c
 JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC, o_orderkey) rn FROM orders) WHERE rn = 1) t
 ON c.o_custkey = t.o_custkey""")
def q_arg_best_multi(spark, sf):
    o = Tables(spark, sf).orders
    a = S.arg_best(o.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", True, ["o_orderkey"])
    b = o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
    return a.select("o_custkey", F.col("o_orderkey").alias("best_by_price")).join(b, "o_custkey")


@query("agg_quality_filter", f"""WITH {SCORED_PRED.replace('WITH', '')},
c AS (SELECT d.lang, d.source, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1) AS positives, count(*) AS n
  FROM sp JOIN documents d ON sp.doc_id = d.doc_id GROUP BY d.lang, d.source),
m AS (SELECT lang, source, positives, n, round(100.0 * positives / n, 6) AS percent, round({f1()}, 6) AS f1 FROM c)
SELECT * FROM m WHERE percent >= 5 AND positives >= 10 AND f1 > 0.5""")
def q_quality_filter(spark, sf):
    from assayflow.operators.tuning import quality_filter

    t = Tables(spark, sf)
    s = _scored(spark, sf).join(t.documents.select("doc_id", "source"), "doc_id")
    c = s.groupBy("lang", "source").agg(
        F.count_if((F.col("label") == 1) & (F.col("prediction") == 1)).alias("tp"),
        F.count_if((F.col("label") == 0) & (F.col("prediction") == 1)).alias("fp"),
        F.count_if((F.col("label") == 1) & (F.col("prediction") == 0)).alias("fn"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count(F.lit(1)).alias("n"),
    )
    m = c.select("lang", "source", "positives", "n", r6(F.lit(100.0) * F.col("positives") / F.col("n")).alias("percent"), r6(M.f1()).alias("f1"))
    return quality_filter(m)


@query("agg_group_unique", "SELECT max(c) AS max_group_size FROM (SELECT doc_id, count(*) AS c FROM documents GROUP BY doc_id)")
def q_group_unique(spark, sf):
    return S.group_unique(Tables(spark, sf).documents, ["doc_id"])


@query("topk_values", """SELECT o_orderstatus, o_custkey AS value, count, rank FROM (
  SELECT 'all' AS o_orderstatus, o_custkey, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank FROM orders GROUP BY o_custkey)
WHERE rank <= 10""")
def q_topk_values(spark, sf):
    o = Tables(spark, sf).orders
    top = S.top_values(o, "o_custkey", 10)
    return top.select(F.lit("all").alias("o_orderstatus"), F.col("o_custkey").alias("value"), "count", "rank")
