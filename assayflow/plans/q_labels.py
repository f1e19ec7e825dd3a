"""§2.10 label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.functions import scalar as S
from assayflow.operators import labels as L
from assayflow.operators import metrics as M
from assayflow.plans.inputs import Tables
from assayflow.plans.q_metrics import MIDPOINT_SQL, r6
from assayflow.plans.registry import query
from assayflow.plans.sql_inputs import REGRESSION, SCORED, f1


@query("lab_threshold", "SELECT o_orderkey, CAST(CASE WHEN o_totalprice >= 150000 THEN 1 ELSE 0 END AS DOUBLE) AS active FROM orders")
def q_threshold(spark, sf):
    o = Tables(spark, sf).orders
    return L.threshold_table(o, ["o_orderpriority"], "o_totalprice", 150000.0, "active").select("o_orderkey", "active")


def _skew_sql(table, by, x):
    return f"""sk AS (SELECT {by}, sum(power(x - mu, 3)) / n / power(sum(power(x - mu, 2)) / n, 1.5) * sqrt(n * (n - 1)) / (n - 2) AS skewness
  FROM (SELECT {by}, CAST({x} AS DOUBLE) AS x, avg({x}) OVER (PARTITION BY {by}) AS mu, count(*) OVER (PARTITION BY {by}) AS n FROM {table})
  GROUP BY {by}, n)"""


def _pct_expr(p):
    t = f"({p / 100.0!r} * (n + 1))"
    return (f"CASE WHEN {t} < 1 THEN min(x) WHEN {t} >= n THEN max(x) ELSE max(x) FILTER (WHERE rn = floor({t})) + ({t} - floor({t})) * "
            f"(max(x) FILTER (WHERE rn = floor({t}) + 1) - max(x) FILTER (WHERE rn = floor({t}))) END")


def _pa_cte(percent):
    return f"""{_skew_sql('orders', 'o_orderpriority', 'o_totalprice')},
o AS (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
pc AS (SELECT o_orderpriority, {_pct_expr(100.0 - percent)} AS hi, {_pct_expr(percent)} AS lo FROM o GROUP BY o_orderpriority, n),
th AS (SELECT sk.o_orderpriority, skewness, CASE WHEN skewness > 0 THEN 'UP' ELSE 'DOWN' END AS direction,
  CASE WHEN skewness > 0 THEN hi ELSE lo END AS threshold FROM sk JOIN pc ON sk.o_orderpriority = pc.o_orderpriority)"""


PA_SQL = f"""WITH {_pa_cte(10.0)}
SELECT o_orderpriority, round(skewness, 6) AS skewness, direction, round(threshold, 6) AS threshold FROM th"""


@query("lab_percent_active", PA_SQL)
def q_percent_active(spark, sf):
    p = L.percent_active(Tables(spark, sf).orders, ["o_orderpriority"], "o_totalprice", 10.0)
    return p.select("o_orderpriority", r6(F.col("skewness")).alias("skewness"), "direction", r6(F.col("threshold")).alias("threshold"))


COLS_SQL = """cv AS (SELECT 'l_tax' AS col, l_tax AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'status', CASE WHEN l_linestatus = 'F' THEN 5.0 ELSE 1.0 END FROM lineitem
  UNION ALL SELECT 'tax_flag', CASE WHEN l_tax < 0.07 THEN 0.0 WHEN l_tax < 0.08 THEN 1.0 ELSE 2.0 END FROM lineitem)"""


def _cols(t):
    li = t.lineitem
    return li.select(F.expr("""stack(5, 'l_tax', l_tax, 'l_discount', l_discount, 'l_quantity', l_quantity,
        'status', CASE WHEN l_linestatus = 'F' THEN 5.0D ELSE 1.0D END,
        'tax_flag', CASE WHEN l_tax < 0.07 THEN 0.0D WHEN l_tax < 0.08 THEN 1.0D ELSE 2.0D END) AS (col, v)"""))


@query("lab_is_binary", f"""WITH {COLS_SQL},
vc AS (SELECT col, v, count(*) AS c FROM cv GROUP BY col, v),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY c DESC, v ASC) AS rk, count(*) OVER (PARTITION BY col) AS nd, sum(c) OVER (PARTITION BY col) AS n FROM vc)
SELECT col, CAST(any_value(n) AS BIGINT) AS n, any_value(nd) AS n_distinct,
  CASE WHEN any_value(nd) = 1 THEN false WHEN any_value(nd) = 2 THEN true WHEN any_value(nd) * 10 > any_value(n) THEN false
       ELSE (sum(c) FILTER (WHERE rk <= 2)) * 1.25 > any_value(n) END AS is_binary
FROM r GROUP BY col""")
def q_is_binary(spark, sf):
    b = L.is_binary(_cols(Tables(spark, sf)), ["col"], "v")
    return b.select("col", "n", "n_distinct", "is_binary")


@query("lab_binarize_common", """WITH b AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 6.0 ELSE 1.0 END AS v FROM orders),
vc AS (SELECT o_orderpriority, v, count(*) AS c FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY c DESC, v ASC) AS rk FROM vc),
t AS (SELECT o_orderpriority, max(v) FILTER (WHERE rk = 1) AS v1, max(v) FILTER (WHERE rk = 2) AS v2 FROM r GROUP BY ALL)
SELECT o_orderkey, CAST(CASE WHEN (b.v > (v1 + v2) / 2 AND NOT v1 > v2) OR (NOT b.v > (v1 + v2) / 2 AND v1 > v2) THEN 1 ELSE 0 END AS DOUBLE) AS cls
FROM b JOIN t ON b.o_orderpriority = t.o_orderpriority""")
def q_binarize_common(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "P", 6.0).otherwise(1.0).alias("v"))
    return L.binarize_common(o, ["o_orderpriority"], "v", "cls").select("o_orderkey", "cls")


@query("lab_inactive_value", """WITH e AS (SELECT event_type, least(value, 100.0) AS v FROM events),
m AS (SELECT event_type, max(v) AS mx, count(v) AS n FROM e GROUP BY ALL),
c AS (SELECT e.event_type, any_value(mx) AS mx, any_value(n) AS n, count(*) FILTER (WHERE v = mx) AS mc FROM e JOIN m ON e.event_type = m.event_type GROUP BY ALL)
SELECT event_type, CASE WHEN mc > 10 AND mc * 20 > n THEN mx END AS inactive_value FROM c""")
def q_inactive_value(spark, sf):
    e = Tables(spark, sf).events.select("event_type", F.least(F.col("value"), F.lit(100.0)).alias("v"))
    return L.inactive_value(e, ["event_type"], "v")


@query("lab_distribution_info", f"""WITH {COLS_SQL} SELECT col, count(v) AS n, count(DISTINCT v) AS n_distinct, count(v) > 50 AS has_enough_values,
  count(DISTINCT v) < 10 AS is_categorical, CASE WHEN count(DISTINCT v) < 10 THEN count(DISTINCT v) END AS n_categories FROM cv GROUP BY col""")
def q_distribution_info(spark, sf):
    return L.distribution_info(_cols(Tables(spark, sf)), ["col"], "v")


def _ks_sql(val, src):
    from assayflow.plans.q_functions import _erf_sql

    z = "(v - m) / sd"
    cdf = f"(0.5 * (1.0 + {_erf_sql(f'({z}) / sqrt(2.0)')}))"
    return f"""(SELECT event_type, n, ks, greatest(least(sum(2.0 * power(-1.0, k - 1) * exp(-2.0 * k * k * n * ks * ks)), 1.0), 0.0) AS p
  FROM (SELECT event_type, any_value(n) AS n, max(greatest((pos + 1) / n - {cdf}, {cdf} - pos / n)) AS ks FROM
          (SELECT event_type, {val} AS v, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {val}, event_id) - 1 AS pos,
                  count(*) OVER (PARTITION BY event_type) AS n, avg({val}) OVER (PARTITION BY event_type) AS m,
                  stddev_samp({val}) OVER (PARTITION BY event_type) AS sd FROM {src}) GROUP BY event_type), range(1, 101) t(k)
  GROUP BY event_type, n, ks)"""


KS_SQL = f"""WITH raw AS {_ks_sql('value', 'events')},
lg AS {_ks_sql('log10(value)', '(SELECT * FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING min(value) > 0))')}
SELECT raw.event_type, round(raw.ks, 6) AS ks_raw, round(raw.p, 6) AS p_raw, round(lg.ks, 6) AS ks_log, round(lg.p, 6) AS p_log
FROM raw LEFT JOIN lg ON raw.event_type = lg.event_type"""


@query("lab_normality", KS_SQL)
def q_normality(spark, sf):
    """Kolmogorov-Smirnov distance of standardized values (and of their log10) to N(0,1), with asymptotic p-values."""
    from assayflow.operators.stats import normality

    n = normality(Tables(spark, sf).events, "event_type", "value")
    return n.select("event_type", *[r6(F.col(c)).alias(c) for c in ("ks_raw", "p_raw", "ks_log", "p_log")])


@query("lab_log_table", "SELECT event_id, value AS arithmetic_value, round(ln(value), 6) AS log_value FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING min(value) > 0)")
def q_log_table(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "event_type", "value")
    return L.log_table(e, ["event_type"], "value").select("event_id", "arithmetic_value", r6(F.col("log_value")).alias("log_value"))


@query("lab_activity_transform", """SELECT event_id, CASE WHEN value > 0 THEN round(-log10(value * 1e-6), 6) END AS p_um,
  CASE WHEN value > 0 THEN round(-log10(value * 1e-9), 6) END AS p_nm, CASE WHEN value > 0 THEN round(log10(value), 6) END AS lg FROM events""")
def q_activity_transform(spark, sf):
    e = Tables(spark, sf).events
    return e.select("event_id", *[r6(S.activity_transform(F.col("value"), n)).alias(a) for n, a in (("uM_to_pIc50", "p_um"), ("nM_to_pIc50", "p_nm"), ("log10", "lg"))])


UNIT_CASE = "CASE WHEN k < 25 THEN 'uM' WHEN k < 50 THEN 'nano molar' WHEN k < 75 THEN 'pM' ELSE 'mM' END"


@query("lab_pic50", f"""WITH e AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
u AS (SELECT event_id, value, {UNIT_CASE} AS unit FROM e)
SELECT event_id, unit, CASE WHEN value > 0 THEN round(-(log10(value) + CASE WHEN unit = 'pM' THEN -12.0 WHEN unit = 'nano molar' THEN -9.0 WHEN unit = 'uM' THEN -6.0 ELSE -3.0 END), 6) END AS pic50 FROM u""")
def q_pic50(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k = F.col("k")
    unit = F.when(k < 25, "uM").when(k < 50, "nano molar").when(k < 75, "pM").otherwise("mM")
    e = e.withColumn("unit", unit)
    return e.select("event_id", "unit", r6(L.pic50(F.col("value"), S.unit_exponent(F.col("unit")))).alias("pic50"))


@query("lab_positive_shift", """SELECT o_orderkey, round(o_totalprice - 100000 + CASE WHEN m <= 0 THEN 1 - m ELSE 0 END, 6) AS shifted
FROM orders, (SELECT min(o_totalprice - 100000) AS m FROM orders)""")
def q_positive_shift(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", (F.col("o_totalprice") - 100000).alias("l"))
    return L.positive_shift(o, "l", "shifted").select("o_orderkey", r6(F.col("shifted")).alias("shifted"))


@query("lab_shift_inactive", "SELECT o_orderkey, round(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 1000 + 1.0 ELSE o_totalprice / 1000 END, 6) AS shifted FROM orders")
def q_shift_inactive(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("l"), (F.col("o_orderstatus") == "F").cast("int").alias("act"))
    return L.shift_inactive(o, "l", "act", "shifted", 1.0).select("o_orderkey", r6(F.col("shifted")).alias("shifted"))


@query("lab_regression_to_class", f"""WITH {REGRESSION}, c AS (SELECT l_returnflag, label AS rl, CASE WHEN label >= 50000 THEN 1.0 ELSE 0.0 END AS lc,
  CASE WHEN prediction >= 50000 THEN 1.0 ELSE 0.0 END AS pc FROM reg)
SELECT l_returnflag, count(*) AS n, CAST(sum(lc) AS DOUBLE) AS positives, CAST(sum(pc) AS DOUBLE) AS predicted, round(sum(rl), 2) AS regression_label_sum FROM c GROUP BY ALL""")
def q_regression_to_class(spark, sf):
    r = Tables(spark, sf).regression_pairs()
    c = L.regression_to_class(r, ["l_returnflag"], "label", "prediction", F.lit(50000.0), F.lit(True))
    return c.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.sum("prediction").alias("predicted"),
                                         F.round(F.sum("regressionLabel"), 2).alias("regression_label_sum"))


@query("lab_class_table", f"""WITH {_pa_cte(30.0)}
SELECT o.o_orderkey, CAST(CASE WHEN (th.direction = 'UP' AND o.o_totalprice >= th.threshold) OR (th.direction = 'DOWN' AND o.o_totalprice <= th.threshold)
  THEN 1 ELSE 0 END AS DOUBLE) AS active FROM orders o JOIN th ON o.o_orderpriority = th.o_orderpriority""")
def q_class_table(spark, sf):
    from assayflow.operators.readouts import classification_table

    o = Tables(spark, sf).orders
    return classification_table(o, ["o_orderpriority"], "o_totalprice", 30.0).select("o_orderkey", "active")


@query("lab_opt_midpoint", f"WITH {SCORED}, {MIDPOINT_SQL} SELECT lang, round(cutoff, 6) AS cutoff, round(score, 6) AS score FROM best")
def q_opt_midpoint(spark, sf):
    b = M.optimize_midpoint(Tables(spark, sf).scored_documents(), ["lang"], "label", "probability", "f1")
    return b.select("lang", r6(F.col("cutoff")).alias("cutoff"), r6(F.col("score")).alias("score"))


LINSPACE_SQL = f"""rng AS (SELECT lang, min(probability) AS mn, max(probability) AS mx FROM scored GROUP BY lang),
grid AS (SELECT lang, step, mn + step * (mx - mn) / 99.0 AS cutoff FROM rng, range(0, 100) t(step)),
cnt AS (SELECT g.lang, g.step, g.cutoff, count(s.label) FILTER (WHERE s.label = 1) AS tp, count(s.label) FILTER (WHERE s.label = 0) AS fp
        FROM grid g LEFT JOIN scored s ON s.lang = g.lang AND s.probability >= g.cutoff GROUP BY ALL),
tot AS (SELECT lang, count(*) FILTER (WHERE label = 1) AS P, count(*) FILTER (WHERE label = 0) AS N FROM scored GROUP BY lang),
sw AS (SELECT c.lang, c.step, c.cutoff, c.tp, c.fp, P - c.tp AS fn, N - c.fp AS tn FROM cnt c JOIN tot ON c.lang = tot.lang)"""


@query("lab_opt_linspace", f"""WITH {SCORED}, {LINSPACE_SQL}
SELECT lang, step, round(cutoff, 6) AS cutoff, tp, fp, fn, tn, round({f1()}, 6) AS score FROM sw""")
def q_opt_linspace(spark, sf):
    sw = M.optimize_linspace(Tables(spark, sf).scored_documents(), ["lang"], "label", "probability", "f1", 100)
    return sw.select("lang", F.col("step").cast("bigint").alias("step"), r6(F.col("cutoff")).alias("cutoff"), "tp", "fp", "fn", "tn", r6(F.col("score")).alias("score"))


SWEEP_SQL = f"""WITH {REGRESSION},
r AS (SELECT l_returnflag AS g, label, prediction FROM reg),
sk AS (SELECT g, sum(power(label - mu, 3)) / n / power(sum(power(label - mu, 2)) / n, 1.5) * sqrt(n * (n - 1)) / (n - 2) AS skew
  FROM (SELECT g, label, avg(label) OVER (PARTITION BY g) AS mu, count(*) OVER (PARTITION BY g) AS n FROM r) GROUP BY g, n),
o AS (SELECT g, label AS x, row_number() OVER (PARTITION BY g ORDER BY label) AS rn, count(*) OVER (PARTITION BY g) AS n FROM r),
pp AS (SELECT DISTINCT o.g, o.n, CAST(t.p AS DOUBLE) AS p FROM o, range(1, 50) t(p)),
tg AS (SELECT g, n, p, (100.0 - p) / 100.0 * (n + 1) AS th, p / 100.0 * (n + 1) AS tl FROM pp),
pv AS (SELECT tg.g, tg.p,
  CASE WHEN th < 1 THEN min(o.x) WHEN th >= tg.n THEN max(o.x) ELSE max(o.x) FILTER (WHERE o.rn = floor(th)) + (th - floor(th)) * (max(o.x) FILTER (WHERE o.rn = floor(th) + 1) - max(o.x) FILTER (WHERE o.rn = floor(th))) END AS hi,
  CASE WHEN tl < 1 THEN min(o.x) WHEN tl >= tg.n THEN max(o.x) ELSE max(o.x) FILTER (WHERE o.rn = floor(tl)) + (tl - floor(tl)) * (max(o.x) FILTER (WHERE o.rn = floor(tl) + 1) - max(o.x) FILTER (WHERE o.rn = floor(tl))) END AS lo
  FROM tg JOIN o ON tg.g = o.g GROUP BY tg.g, tg.p, tg.n, th, tl),
th AS (SELECT pv.g, p, CASE WHEN skew > 0 THEN 'UP' ELSE 'DOWN' END AS direction, CASE WHEN skew > 0 THEN hi ELSE lo END AS threshold FROM pv JOIN sk ON pv.g = sk.g),
c0 AS (SELECT th.g, th.p, th.direction, th.threshold, r.prediction AS prob,
  CAST(CASE WHEN (th.direction = 'UP' AND r.label >= th.threshold) OR (th.direction = 'DOWN' AND r.label <= th.threshold) THEN 1 ELSE 0 END AS DOUBLE) AS lab
  FROM th JOIN r ON th.g = r.g),
keep AS (SELECT g, p FROM c0 GROUP BY g, p HAVING sum(lab) >= 1),
c AS (SELECT c0.* FROM c0 JOIN keep ON c0.g = keep.g AND c0.p = keep.p),
rng AS (SELECT g, p, min(prob) AS mn, max(prob) AS mx FROM c GROUP BY g, p),
pc AS (SELECT g, p, prob, count(*) FILTER (WHERE lab = 1) AS pos, count(*) FILTER (WHERE lab = 0) AS neg FROM c GROUP BY ALL),
bk0 AS (SELECT pc.*, rng.mn, rng.mx, CASE WHEN rng.mx = rng.mn THEN 99 ELSE CAST(floor((prob - rng.mn) / (rng.mx - rng.mn) * 99) AS INTEGER) END AS b0
  FROM pc JOIN rng ON pc.g = rng.g AND pc.p = rng.p),
bk1 AS (SELECT *, CASE WHEN prob < mn + b0 * (mx - mn) / 99.0 THEN b0 - 1 ELSE b0 END AS b1 FROM bk0),
bk AS (SELECT *, CASE WHEN b1 < 99 AND prob >= mn + (b1 + 1) * (mx - mn) / 99.0 THEN b1 + 1 ELSE b1 END AS b FROM bk1),
ps AS (SELECT g, p, b, sum(pos) AS sp, sum(neg) AS sn FROM bk GROUP BY ALL),
grid AS (SELECT rng.g, rng.p, t.step, rng.mn + t.step * (rng.mx - rng.mn) / 99.0 AS cutoff FROM rng, range(0, 100) t(step)),
gs AS (SELECT grid.*, coalesce(ps.sp, 0) AS sp, coalesce(ps.sn, 0) AS sn FROM grid LEFT JOIN ps ON grid.g = ps.g AND grid.p = ps.p AND grid.step = ps.b),
sw AS (SELECT g, p, step, cutoff, sum(sp) OVER (PARTITION BY g, p ORDER BY step DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(sn) OVER (PARTITION BY g, p ORDER BY step DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(sp) OVER (PARTITION BY g, p) AS tot_pos, sum(sn) OVER (PARTITION BY g, p) AS tot_neg FROM gs),
sc AS (SELECT *, tot_pos - tp AS fn, tot_neg - fp AS tn FROM sw),
sc2 AS (SELECT *, {f1()} AS score FROM sc),
bc AS (SELECT g, p, arg_max(cutoff, (score, -step)) AS cut FROM sc2 GROUP BY g, p),
st AS (SELECT c.g, c.p, count(*) FILTER (WHERE lab = 1 AND prob >= cut) AS tp, count(*) FILTER (WHERE lab = 0 AND prob < cut) AS tn,
  count(*) FILTER (WHERE lab = 0 AND prob >= cut) AS fp, count(*) FILTER (WHERE lab = 1 AND prob < cut) AS fn FROM c JOIN bc ON c.g = bc.g AND c.p = bc.p GROUP BY c.g, c.p),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY g, p ORDER BY prob DESC ROWS UNBOUNDED PRECEDING) AS cum_tp, sum(pos) OVER (PARTITION BY g, p) AS tot_pos,
  sum(neg) OVER (PARTITION BY g, p) AS tot_neg FROM pc),
auc AS (SELECT g, p, sum((neg / tot_neg) * (2 * cum_tp - pos) / (2 * tot_pos)) AS roc_auc FROM cu GROUP BY g, p),
det AS (SELECT st.*, {f1()} AS f1, auc.roc_auc, th.direction, th.threshold FROM st JOIN auc ON st.g = auc.g AND st.p = auc.p JOIN th ON st.g = th.g AND st.p = th.p),
ok AS (SELECT * FROM det WHERE tp + fn >= 10 AND (tp + fn) * 100.0 / (tp + fn + fp + tn) >= 5.0 AND f1 >= 0.5),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY roc_auc DESC, p ASC) AS rk FROM ok) WHERE rk = 1)
SELECT g AS l_returnflag, p AS percent, direction, round(threshold, 6) AS threshold, round(roc_auc, 6) AS roc_auc, round(f1, 6) AS f1, tp, fp, tn, fn FROM best"""


@query("lab_cutoff_sweep", SWEEP_SQL)
def q_cutoff_sweep(spark, sf):
    """Percent sweep 1..49 of the regression pairs per return flag; best AUC per group (see labels.cutoff_sweep)."""
    r = Tables(spark, sf).regression_pairs()
    det, best = L.cutoff_sweep(r, ["l_returnflag"], "label", "prediction")
    return best.select("l_returnflag", "percent", "direction", r6(F.col("threshold")).alias("threshold"), r6(F.col("roc_auc")).alias("roc_auc"),
                       r6(F.col("f1")).alias("f1"), "tp", "fp", "tn", "fn")


@query("lab_binary_category", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 1 END AS DOUBLE) AS is_regression FROM orders")
def q_binary_category(spark, sf):
    o = Tables(spark, sf).orders
    cat = F.when(F.col("o_orderstatus") == "F", "Regression").when(F.col("o_orderstatus") == "O", "Classification").otherwise("Both")
    return o.select("o_orderkey", L.binary_category(cat, 1.0).alias("is_regression"))


# Fixed values for the query below: (name substring, threshold, greater is better)
ADME_RULES = (("economy", 1000.0, True), ("small", 1200.0, False), ("large", 1500.0, True))


@query("lab_direct_threshold_rules", """WITH r AS (SELECT p_partkey, p_retailprice,
  CASE WHEN contains(lower(p_type), 'economy') THEN 1000.0 WHEN contains(lower(p_type), 'small') THEN 1200.0 WHEN contains(lower(p_type), 'large') THEN 1500.0 END AS threshold,
  CASE WHEN contains(lower(p_type), 'economy') THEN true WHEN contains(lower(p_type), 'small') THEN false WHEN contains(lower(p_type), 'large') THEN true END AS up FROM part)
SELECT p_partkey, CAST(threshold AS DOUBLE) AS threshold, CAST(CASE WHEN threshold IS NULL THEN NULL WHEN (up AND p_retailprice >= threshold) OR (NOT up AND p_retailprice <= threshold) THEN 1 ELSE 0 END AS DOUBLE) AS active FROM r""")
def q_direct_threshold(spark, sf):
    p = Tables(spark, sf).part
    thr, up = L.direct_threshold_rule(F.col("p_type"), ADME_RULES)
    p = p.select("p_partkey", "p_retailprice", thr.alias("threshold"), up.alias("up"))
    cls = F.when(F.col("threshold").isNull(), F.lit(None).cast("double")).when(
        (F.col("up") & (F.col("p_retailprice") >= F.col("threshold"))) | (~F.col("up") & (F.col("p_retailprice") <= F.col("threshold"))), 1.0).otherwise(0.0)
    return p.select("p_partkey", "threshold", cls.alias("active"))
