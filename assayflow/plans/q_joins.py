"""§2.6 join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.operators import joins as J
from assayflow.operators.features import word_split, words
from assayflow.plans.inputs import Tables
from assayflow.plans.q_metrics import r6
from assayflow.plans.registry import query
from assayflow.plans.sql_inputs import REGRESSION


@query("join_inner_key", "SELECT c.c_custkey AS no, c.c_acctbal, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def q_inner_key(spark, sf):
    """Two feature tables of the same customers joined on the key, failing if any row loses its partner."""
    t = Tables(spark, sf)
    a = t.customer.select(F.col("c_custkey").alias("no"), "c_acctbal")
    b = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("no"), "n_name")
    return J.inner_join_audited(a, b, "no")


@query("join_merge_check", """SELECT coalesce(a.no, b.no) AS no, a.t AS a_t, b.t AS b_t, a.no IS NULL OR b.no IS NULL AS missing,
  NOT (a.no IS NULL OR b.no IS NULL) AND NOT (a.t IS NOT DISTINCT FROM b.t) AS mismatch
FROM (SELECT c_custkey AS no, c_mktsegment AS t FROM customer) a FULL JOIN (SELECT c_custkey AS no, CASE WHEN c_acctbal < -990 THEN 'X' ELSE c_mktsegment END AS t FROM customer) b ON a.no = b.no""")
def q_merge_check(spark, sf):
    c = Tables(spark, sf).customer
    a = c.select(F.col("c_custkey").alias("no"), F.col("c_mktsegment").alias("t"))
    b = c.select(F.col("c_custkey").alias("no"), F.when(F.col("c_acctbal") < -990, "X").otherwise(F.col("c_mktsegment")).alias("t"))
    return J.merge_check(a, b, "no", ["t"])


@query("join_mismatch_audit", "SELECT round(avg(CASE WHEN o.o_totalprice > c.c_acctbal THEN 0.0 ELSE 1.0 END), 6) AS mismatch_rate FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def q_mismatch_audit(spark, sf):
    """Orders are worth more than what their customer has on account, but for a few; above 5 % the audit stops the job."""
    t = Tables(spark, sf)
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_totalprice")
    c = t.customer.select(F.col("c_custkey").alias("k"), "c_acctbal")
    m = J.mismatch_rate(o, c, "k", F.col("o_totalprice") > F.col("c_acctbal"))
    return m.select(r6(F.col("mismatch_rate")).alias("mismatch_rate"))


@query("join_lookup", "SELECT c.c_custkey, c.c_name, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def q_lookup(spark, sf):
    t = Tables(spark, sf)
    return J.lookup(t.customer.select("c_custkey", "c_name", "c_nationkey"), t.nation.select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey").select("c_custkey", "c_name", "n_name")


@query("join_definition", """WITH d AS (SELECT event_type AS readout, upper(event_type) AS definition_name, 'Number' AS data_type FROM (SELECT DISTINCT event_type FROM events))
SELECT e.event_id, d.definition_name, d.data_type, e.value FROM events e JOIN d ON e.event_type = d.readout""")
def q_definition(spark, sf):
    e = Tables(spark, sf).events
    d = e.select(F.col("event_type").alias("readout")).distinct().select("readout", F.upper("readout").alias("definition_name"), F.lit("Number").alias("data_type"))
    return e.join(d, e.event_type == d.readout).select("event_id", "definition_name", "data_type", "value")


SUMMARY_SQL = f"""{REGRESSION},
rs AS (SELECT l_returnflag AS name, l_linestatus AS label, round(sqrt(avg((label - prediction) * (label - prediction))), 6) AS rmse FROM reg GROUP BY ALL),
cs AS (SELECT l_returnflag AS name, l_linestatus AS label, count(*) FILTER (WHERE label >= 50000 AND prediction < 50000) AS fn,
  count(*) FILTER (WHERE label < 50000 AND prediction >= 50000) AS fp FROM reg GROUP BY ALL)"""


@query("join_summary_keys", f"WITH {SUMMARY_SQL} SELECT rs.name, rs.label, rs.rmse, cs.fp, cs.fn, fp + 10 * fn AS cost FROM rs JOIN cs ON rs.name = cs.name AND rs.label = cs.label")
def q_summary_keys(spark, sf):
    from assayflow.operators.metrics import plain_cost, regression_metrics

    r = Tables(spark, sf).regression_pairs()
    rs = regression_metrics(r, ["l_returnflag", "l_linestatus"], "label", "prediction").select(
        F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("label"), r6(F.col("rmse")).alias("rmse"))
    cs = r.groupBy(F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("label")).agg(
        F.count_if((F.col("label") >= 50000) & (F.col("prediction") < 50000)).alias("fn"),
        F.count_if((F.col("label") < 50000) & (F.col("prediction") >= 50000)).alias("fp"))
    j = rs.join(cs, ["name", "label"])
    return j.select("name", "label", "rmse", "fp", "fn", plain_cost().cast("bigint").alias("cost")).orderBy("name")


@query("join_inner_suffix", "SELECT s.s_suppkey, s.s_name, s.s_nationkey AS s_nationkey, s.s_acctbal AS acctbal_x, c.c_acctbal AS acctbal_y FROM (SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier) s JOIN customer c ON s.s_suppkey = c.c_custkey")
def q_inner_suffix(spark, sf):
    t = Tables(spark, sf)
    a = t.supplier.select(F.col("s_suppkey").alias("k"), "s_name", "s_nationkey", F.col("s_acctbal").alias("acctbal"))
    b = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("acctbal"))
    j = J.join_with_suffixes(a, b, ["k"])
    return j.select(F.col("k").alias("s_suppkey"), "s_name", "s_nationkey", "acctbal_x", "acctbal_y")


@query("join_left_one_to_one", "SELECT c.c_custkey, c.c_name, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def q_left_one_to_one(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.select("c_custkey", "c_name", F.col("c_nationkey").alias("nk"))
    n = t.nation.select(F.col("n_nationkey").alias("nk"), "n_name")
    return J.left_join_one_to_one(c, n, "nk").select("c_custkey", "c_name", "n_name")


@query("join_cross", "SELECT f.l_returnflag AS flag, s.l_linestatus AS status, p.o_orderpriority AS priority FROM (SELECT DISTINCT l_returnflag FROM lineitem) f, (SELECT DISTINCT l_linestatus FROM lineitem) s, (SELECT DISTINCT o_orderpriority FROM orders) p")
def q_cross(spark, sf):
    t = Tables(spark, sf)
    return J.value_product({"flag": t.lineitem.select("l_returnflag"), "status": t.lineitem.select("l_linestatus"), "priority": t.orders.select("o_orderpriority")})


WORDS_SQL = r"""dw AS (SELECT doc_id AS id, w AS feature, CAST(count(*) AS DOUBLE) AS cnt FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
bw AS (SELECT item_id AS id, w AS feature, CAST(count(*) AS DOUBLE) AS cnt FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL),
dn AS (SELECT id, sum(cnt * cnt) AS n FROM dw GROUP BY id), bn AS (SELECT id, sum(cnt * cnt) AS n FROM bw GROUP BY id),
pr AS (SELECT dw.id AS did, bw.id AS bid, sum(dw.cnt * bw.cnt) AS dot FROM dw JOIN bw ON dw.feature = bw.feature GROUP BY ALL),
tn AS (SELECT did, bid, dot / (dn.n + bn.n - dot) AS t FROM pr JOIN dn ON pr.did = dn.id JOIN bn ON pr.bid = bn.id)"""


def _doc_postings(t):
    return J.postings(t.documents.select("doc_id", "text"), "doc_id", word_split(F.col("text")), chars=F.length("text"))


def _bench_postings(t):
    return J.postings(t.benchmark.select("item_id", "text"), "item_id", word_split(F.col("text")), chars=F.length("text"))


@query("join_nearest_sim", f"""WITH {WORDS_SQL}
SELECT d.doc_id, round(coalesce(max(t), 0.0), 6) AS similarity FROM documents d LEFT JOIN tn ON d.doc_id = tn.did GROUP BY d.doc_id""")
def q_nearest_sim(spark, sf):
    t = Tables(spark, sf)
    s = J.nearest_similarity(_doc_postings(t), "doc_id", _bench_postings(t), "item_id", all_ids=t.documents.select("doc_id"))
    return s.select("doc_id", r6(F.col("similarity")).alias("similarity"))


@query("join_profile", f"""WITH {WORDS_SQL}, lt AS (SELECT bid, d.lang, max(t) AS t FROM tn JOIN documents d ON tn.did = d.doc_id GROUP BY ALL)
SELECT b.item_id, round(coalesce(max(t) FILTER (WHERE lang = 'de'), 0.0), 6) AS de, round(coalesce(max(t) FILTER (WHERE lang = 'en'), 0.0), 6) AS en,
  round(coalesce(max(t) FILTER (WHERE lang = 'es'), 0.0), 6) AS es, round(coalesce(max(t) FILTER (WHERE lang = 'fr'), 0.0), 6) AS fr
FROM benchmark b LEFT JOIN lt ON b.item_id = lt.bid GROUP BY b.item_id""")
def q_profile(spark, sf):
    t = Tables(spark, sf)
    docs = J.postings(t.documents.select("doc_id", "lang", "text"), "doc_id", word_split(F.col("text")), keep=["lang"], chars=F.length("text"))
    names = ["de", "en", "es", "fr"]
    p = J.similarity_profile(_bench_postings(t), "item_id", docs, "doc_id", "lang", names, all_ids=t.benchmark.select("item_id"))
    return p.select("item_id", *[r6(F.col(n)).alias(n) for n in names])


CONV_WORDS = r"""cw AS (SELECT conv_id, turn, w AS feature, CAST(count(*) AS DOUBLE) AS cnt FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM conversations) WHERE w <> '' GROUP BY ALL)"""


@query("fn_tanimoto_sparse", f"""WITH {CONV_WORDS}, pr AS (SELECT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
n AS (SELECT conv_id, turn, sum(cnt * cnt) AS n FROM cw GROUP BY ALL),
d AS (SELECT a.conv_id, a.turn, sum(a.cnt * b.cnt) AS dot FROM cw a JOIN cw b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.feature = b.feature GROUP BY ALL)
SELECT pr.conv_id, pr.turn, round(CASE WHEN d.dot IS NULL THEN 0.0 ELSE d.dot / (na.n + nb.n - d.dot) END, 6) AS tanimoto
FROM pr LEFT JOIN d ON pr.conv_id = d.conv_id AND pr.turn = d.turn LEFT JOIN n na ON pr.conv_id = na.conv_id AND pr.turn = na.turn
LEFT JOIN n nb ON pr.conv_id = nb.conv_id AND pr.turn + 1 = nb.turn""")
def q_tanimoto_sparse(spark, sf):
    """Tanimoto between the word-count vectors of consecutive turns of each conversation."""
    c = Tables(spark, sf).conversations
    post = c.select("conv_id", "turn", F.explode(words(F.col("text"))).alias("feature")).groupBy("conv_id", "turn", "feature").agg(
        F.count(F.lit(1)).cast("double").alias("count"))
    nxt = c.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t1"))
    pairs = c.select("conv_id", "turn").join(nxt, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t1"))).select(
        F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("conv_id").alias("b_conv"), (F.col("turn") + 1).alias("b_turn"))
    t = J.tanimoto_pairs(post, ["conv_id", "turn"], pairs, ["a_conv", "a_turn"], ["b_conv", "b_turn"])
    return t.select(F.col("a_conv").alias("conv_id"), F.col("a_turn").alias("turn"), r6(F.col("tanimoto")).alias("tanimoto"))
