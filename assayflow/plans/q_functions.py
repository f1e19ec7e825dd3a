"""§2.11 scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.functions import scalar as S
from assayflow.plans.inputs import Tables
from assayflow.plans.q_metrics import r6
from assayflow.plans.registry import query


@query("fn_first_number", r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\s'),
  lambda x: CASE WHEN length(translate(x, '<>=', '')) > 0 THEN TRY_CAST(translate(x, '<>=', '') AS DOUBLE) END), lambda x: x IS NOT NULL)[1] AS first_number FROM documents""")
def q_first_number(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", S.first_number(F.col("text")).alias("first_number"))


CAT_SQL = r"CASE WHEN regexp_full_match(lower(trim({x})), '\d+') THEN CAST(lower(trim({x})) AS DOUBLE) WHEN lower(trim({x})) = 'false' THEN 0.0 WHEN lower(trim({x})) = 'true' THEN 1.0 END"


@query("fn_category_number", "SELECT p_partkey, " + CAT_SQL.format(x="CAST(p_size AS VARCHAR)") + " AS size_num, "
       + CAT_SQL.format(x="p_brand") + " AS brand_num, " + CAT_SQL.format(x="CAST(p_size > 25 AS VARCHAR)") + " AS big FROM part")
def q_category_number(spark, sf):
    p = Tables(spark, sf).part
    return p.select("p_partkey", S.category_number(F.col("p_size").cast("string")).alias("size_num"),
                    S.category_number(F.col("p_brand")).alias("brand_num"), S.category_number((F.col("p_size") > 25).cast("string")).alias("big"))


@query("src_numeric_text", """SELECT event_id, json_extract_string(props, '$.k') AS k_text, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_num,
  TRY_CAST(event_type AS DOUBLE) AS type_num FROM events""")
def q_numeric_text(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.get_json_object("props", "$.k").alias("k_text"), "event_type")
    return e.select("event_id", "k_text", S.numeric_text(F.col("k_text")).alias("k_num"), S.numeric_text(F.col("event_type")).alias("type_num"))


@query("fn_field_value", r"""SELECT event_id, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0 THEN round(-log10(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1e-6), 6) END AS k_pic50,
  CASE WHEN regexp_full_match(lower(trim(json_extract_string(props, '$.k'))), '\d+') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k_cat FROM events""")
def q_field_value(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return e.select("event_id", r6(S.field_value(F.col("k"), "continuous", "uM_to_pIc50")).alias("k_pic50"),
                    S.field_value(F.col("k"), "categorical").alias("k_cat"))


MOD_CASE = "CASE WHEN value >= 300 THEN '>' WHEN value >= 250 THEN '>=' WHEN value < 1 THEN '<' WHEN value < 2 THEN '<=' ELSE '=' END"


@query("fn_modifier", f"""SELECT event_id, m AS modifier, m IN ('>', '>=') AS is_greater, m IN ('<', '<=') AS is_less FROM (SELECT event_id, {MOD_CASE} AS m FROM events)""")
def q_modifier(spark, sf):
    v = F.col("value")
    m = F.when(v >= 300, ">").when(v >= 250, ">=").when(v < 1, "<").when(v < 2, "<=").otherwise("=")
    e = Tables(spark, sf).events.select("event_id", S.modifier(m).alias("modifier"))
    return e.select("event_id", "modifier", S.is_greater(F.col("modifier")).alias("is_greater"), S.is_less(F.col("modifier")).alias("is_less"))


TOKENIZE_SQL = r"""WITH t AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '[^\w.]+'), lambda s: s <> '') AS toks FROM conversations),
a AS (SELECT conv_id, turn, text, list_transform(toks, lambda s: CASE WHEN s IN ('uM', 'mM', 'nM', 'pM', 'Kd', 'Ki') OR regexp_full_match(s, '[\p{Lu}\p{Nd}]+') THEN lower(s) ELSE s END) AS toks FROM t),
b AS (SELECT conv_id, turn, text, flatten(list_transform(toks, lambda s: list_filter(string_split(regexp_replace(s, '(\p{Lu}\p{Ll})', chr(1) || '\1', 'g'), chr(1)), lambda z: z <> ''))) AS toks FROM a),
c AS (SELECT conv_id, turn, text, flatten(list_transform(toks, lambda s: CASE WHEN regexp_full_match(lower(s), '(([0-9]+\.?[0-9]*|\.[0-9]+)(e[0-9]+)?[df]?|[0-9]+l|0x[0-9a-f]+l?)') THEN [lower(s)]
  WHEN regexp_replace(lower(s), '\.+$', '') = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(lower(s), '\.+$', ''), '.') END)) AS toks FROM b)
SELECT conv_id, turn, array_to_string(CASE WHEN contains(text, '/') THEN list_append(list_filter(toks, lambda s: s <> '.'), '/') ELSE list_filter(toks, lambda s: s <> '.') END, '|') AS tokens FROM c"""


@query("fn_tokenize", TOKENIZE_SQL)
def q_tokenize(spark, sf):
    c = Tables(spark, sf).conversations
    return c.select("conv_id", "turn", F.array_join(S.tokenize(F.col("text")), "|").alias("tokens"))


UNIT_SQL = r"""CASE WHEN regexp_matches(text, '(?:pM)|(?:(?i)pico *molar)') THEN 'Picomolar' WHEN regexp_matches(text, '(?:nM)|(?:(?i)nano *molar)') THEN 'Nanomolar'
  WHEN regexp_matches(text, '(?:uM)|(?:(?i)micro *molar)|(?:um)') THEN 'Micromolar' WHEN regexp_matches(text, '(?:mM)|(?:(?i)milli *molar)') THEN 'Millimolar' END"""


@query("fn_unit_match", f"SELECT conv_id, turn, {UNIT_SQL} AS unit FROM conversations")
def q_unit_match(spark, sf):
    c = Tables(spark, sf).conversations
    return c.select("conv_id", "turn", S.unit_name(F.col("text")).alias("unit"))


@query("fn_readout_kind", r"""SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(html, '(?i)assay description') THEN 'Assay' END,
  CASE WHEN regexp_matches(html, '(?i)activity type') THEN 'Measurement' END, CASE WHEN regexp_matches(html, '(?i)^target') THEN 'Target' END,
  CASE WHEN regexp_matches(html, '(?i)unit') THEN 'Units' END], lambda x: x IS NOT NULL), '|') AS kinds,
  regexp_matches(html, '(?i)inhibition') OR contains(url, '%') OR regexp_matches(url, '(?i)percent') AS is_primary FROM pages""")
def q_readout_kind(spark, sf):
    p = Tables(spark, sf).pages
    return p.select("page_id", F.array_join(S.readout_kind(F.col("html")), "|").alias("kinds"), S.is_primary_readout(F.col("html"), F.col("url")).alias("is_primary"))


@query("fn_keyword_flag", "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{k}')" for k in S.LEARNING_KEYWORDS) + " AS use_readout FROM conversations")
def q_keyword_flag(spark, sf):
    c = Tables(spark, sf).conversations
    return c.select("conv_id", "turn", S.keyword_flag(F.lower(F.col("text"))).alias("use_readout"))


@query("fn_table_md5", "SELECT n_nationkey, md5(concat_ws(':', r_name, n_name, CAST(n_nationkey AS VARCHAR))) AS table_key FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_table_md5(spark, sf):
    t = Tables(spark, sf)
    j = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_nationkey", S.table_md5("r_name", "n_name", F.col("n_nationkey").cast("string")).alias("table_key"))


@query("fn_name_strings", """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders)
SELECT o_orderkey, 'priority:' || o_orderpriority || '|status:' || o_orderstatus AS groups, 'NA' AS empty FROM o""")
def q_name_strings(spark, sf):
    o = Tables(spark, sf).orders
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return o.select("o_orderkey", S.name_string(m).alias("groups"), S.name_string(F.create_map().cast("map<string,string>")).alias("empty"))


@query("fn_fillna", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(CAST(l.toxic AS VARCHAR), 'NA') AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_fillna(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality", F.col("toxic").cast("string").alias("toxic")), "doc_id", "left")
    return j.na.fill({"quality": 0, "toxic": "NA"})


def _erf_sql(x):
    a1, a2, a3, a4, a5 = S.ERF_A
    t = f"(1.0 / (1.0 + {S.ERF_P} * abs({x})))"
    poly = f"(((((({a5} * {t} + {a4}) * {t} + {a3}) * {t} + {a2}) * {t} + {a1}) * {t}))"
    return f"(sign({x}) * (1.0 - {poly} * exp(-abs({x}) * abs({x}))))"


Z_SQL = "z AS (SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS z FROM orders)"


@query("fn_normal_cdf", f"WITH {Z_SQL} SELECT o_orderkey, round(0.5 * (1.0 + {_erf_sql('(z / sqrt(2.0))')}), 5) AS cdf FROM z")
def q_normal_cdf(spark, sf):
    return _z(spark, sf).select("o_orderkey", F.round(S.normal_cdf(F.col("z")), 5).alias("cdf"))


def _z(spark, sf):
    o = Tables(spark, sf).orders
    st = o.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"))
    return o.withColumn("__st", st.select(F.struct("m", "s")).scalar()).select("o_orderkey", ((F.col("o_totalprice") - F.col("__st.m")) / F.col("__st.s")).alias("z"))


@query("fn_gauss", f"""WITH {Z_SQL} SELECT o_orderkey, round(exp(-0.5 * z * z) / sqrt(2 * pi()), 6) AS density,
  round(-z * exp(-0.5 * z * z) / sqrt(2 * pi()), 6) AS d1, round((z * z - 1) * exp(-0.5 * z * z) / sqrt(2 * pi()), 6) AS d2 FROM z""")
def q_gauss(spark, sf):
    z = F.col("z")
    return _z(spark, sf).select("o_orderkey", r6(S.gauss(z)).alias("density"), r6(S.gauss_d1(z)).alias("d1"), r6(S.gauss_d2(z)).alias("d2"))


CENTROID_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
u AS (SELECT vec_id, label, unnest(a) AS v, unnest(generate_series(1, len(a))) AS i FROM e),
c AS (SELECT label, list(m ORDER BY i) AS b FROM (SELECT label, i, avg(v) AS m FROM u GROUP BY label, i) GROUP BY label),
p AS (SELECT e.vec_id, e.a, c.b FROM e JOIN c ON e.label = c.label)"""


def _centroids(spark, sf):
    e = Tables(spark, sf).embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    long = e.select("label", F.posexplode("a").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    c = long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select("label", F.transform("s", lambda x: x["m"]).alias("b"))
    return e.join(c, "label").select("vec_id", "a", "b")


@query("fn_tanimoto_dense", f"""WITH {CENTROID_SQL} SELECT vec_id, round(list_dot_product(a, b) / (list_dot_product(a, a) + list_dot_product(b, b) - list_dot_product(a, b)), 6) AS tanimoto FROM p""")
def q_tanimoto_dense(spark, sf):
    return _centroids(spark, sf).select("vec_id", r6(S.tanimoto_dense(F.col("a"), F.col("b"))).alias("tanimoto"))


@query("fn_kernels", f"""WITH {CENTROID_SQL} SELECT vec_id, round(list_dot_product(a, b), 6) AS linear, round(power(0.5 * list_dot_product(a, b) + 1.0, 3), 6) AS poly,
  round(exp(-0.5 * list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS rbf, round(tanh(0.5 * list_dot_product(a, b) + 1.0), 6) AS sigmoid,
  round(power(list_dot_product(a, b) / (list_dot_product(a, a) + list_dot_product(b, b) - list_dot_product(a, b)), 2), 6) AS tanimoto2 FROM p""")
def q_kernels(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _centroids(spark, sf).select(
        "vec_id", r6(S.kernel("linear", a, b)).alias("linear"), r6(S.kernel("polynomial", a, b, 0.5, 1.0, 3)).alias("poly"),
        r6(S.kernel("rbf", a, b, 0.5)).alias("rbf"), r6(S.kernel("sigmoid", a, b, 0.5, 1.0)).alias("sigmoid"),
        r6(S.kernel("tanimoto", a, b, degree=2)).alias("tanimoto2"))


@query("fn_vec_slice", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS f0, round(CAST(embedding[6] AS DOUBLE), 6) AS f5, round(CAST(embedding[11] AS DOUBLE), 6) AS f10 FROM embeddings")
def q_vec_slice(spark, sf):
    from assayflow.operators.features import vector_slice

    e = Tables(spark, sf).embeddings.select("vec_id", vector_slice("embedding", [0, 5, 10]).alias("s"))
    return e.select("vec_id", *[r6(F.col("s")[i]).alias(n) for i, n in enumerate(["f0", "f5", "f10"])])


@query("fn_vec_codec", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, true AS dense_ok, true AS sparse_ok FROM embeddings")
def q_vec_codec(spark, sf):
    e = Tables(spark, sf).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    back = S.text_to_dense(S.dense_to_text(F.col("a")))
    idx = F.filter(F.sequence(F.lit(0), F.size("a") - 1), lambda i: F.col("a")[i] > 0)
    vals = F.transform(idx, lambda i: F.col("a")[i])
    sp = S.text_to_sparse(S.sparse_to_text(F.size("a"), idx, vals))
    return e.select("vec_id", F.size("a").alias("n"), (back == F.col("a")).alias("dense_ok"),
                    ((sp["indices"] == idx) & (sp["values"] == vals) & (sp["length"] == F.size("a"))).alias("sparse_ok"))
