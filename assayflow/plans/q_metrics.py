"""§2.7 metric queries and the flagship evaluation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.operators import metrics as M
from assayflow.operators.ordered import attach
from assayflow.plans.inputs import Tables
from assayflow.plans.registry import query
from assayflow.plans.sql_inputs import REGRESSION, SCORED, ba, f1, prec, rec, spec

R = 6  # decimals kept on both sides of every oracle comparison


def r6(c):
    return F.round(c, R)


# ------------------------------------------------------------------ flagship

def eval_report(t: Tables, metric: str = "f1"):
    """One row per dataset (lang): cutoff tuned on the data, counts, AUC, BA, F1, precision, recall, specificity."""
    from assayflow.session import materialize

    s = t.scored_documents()
    by = ["lang"]
    pts = materialize(M.roc_curve(s, by, "label", "probability"))  # one ROC pass feeds cutoff and AUC
    best = M.optimize_midpoint(s, by, "label", "probability", metric, points=pts).select("lang", "cutoff")
    pred = attach(s, best, by).withColumn("prediction", (F.col("probability") > F.col("cutoff")).cast("double"))
    counts = M.class_stats(M.confusion(pred, by, "label", "prediction"))
    auc = M.roc_auc(s, by, "label", "probability", points=pts)
    out = counts.join(auc, "lang").join(best, "lang")
    return out.select(
        F.col("lang").alias("dataset"),
        F.lit("minmax_n_chars").alias("method"),
        r6(F.col("cutoff")).alias("cutoff"),
        "tp",
        "fp",
        "tn",
        "fn",
        r6(F.col("roc_auc")).alias("roc_auc"),
        r6(F.col("ba")).alias("ba"),
        r6(F.col("f1")).alias("f1"),
        r6(F.col("precision")).alias("precision"),
        r6(F.col("recall")).alias("recall"),
        r6(F.col("specificity")).alias("specificity"),
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"),
    )


MIDPOINT_SQL = f"""
pc AS (SELECT lang, probability, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
       FROM scored GROUP BY lang, probability),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY lang ORDER BY probability DESC ROWS UNBOUNDED PRECEDING) AS cum_tp,
                  sum(neg) OVER (PARTITION BY lang ORDER BY probability DESC ROWS UNBOUNDED PRECEDING) AS cum_fp,
                  sum(pos) OVER (PARTITION BY lang) AS P, sum(neg) OVER (PARTITION BY lang) AS N,
                  lag(probability) OVER (PARTITION BY lang ORDER BY probability) AS prev_p
        FROM pc),
cand AS (SELECT lang, (prev_p + probability) / 2 AS cutoff, cum_tp AS tp, cum_fp AS fp, P - cum_tp AS fn, N - cum_fp AS tn
         FROM cum WHERE prev_p IS NOT NULL),
scoredc AS (SELECT *, {f1()} AS score FROM cand),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, cutoff ASC) AS rn FROM scoredc) WHERE rn = 1),
auc AS (SELECT lang, sum((neg / N) * (2 * cum_tp - pos) / (2 * P)) AS roc_auc FROM cum GROUP BY lang)
"""

EVAL_REPORT_SQL = f"""
WITH {SCORED}, {MIDPOINT_SQL},
pred AS (SELECT s.lang, s.label, CASE WHEN s.probability > b.cutoff THEN 1.0 ELSE 0.0 END AS prediction
         FROM scored s JOIN best b ON s.lang = b.lang),
cnt AS (SELECT lang, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                     count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
                     count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                     count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM pred GROUP BY lang)
SELECT lang AS dataset, 'minmax_n_chars' AS method, round(cutoff, 6) AS cutoff, tp, fp, tn, fn,
       round(roc_auc, 6) AS roc_auc, round({ba()}, 6) AS ba, round({f1()}, 6) AS f1,
       round({prec()}, 6) AS precision, round({rec()}, 6) AS recall, round({spec()}, 6) AS specificity,
       tp + fp + tn + fn AS n
FROM (SELECT c.*, a.roc_auc, b.cutoff FROM cnt c JOIN auc a ON c.lang = a.lang JOIN best b ON c.lang = b.lang) x
"""


@query("agg_eval_report", EVAL_REPORT_SQL)
def q_eval_report(spark, sf):
    return eval_report(Tables(spark, sf))


# ------------------------------------------------------------ §2.7 metrics

def _reg(spark, sf):
    return Tables(spark, sf).regression_pairs()


def _scored(spark, sf):
    """Scored documents with a fixed-cutoff prediction (probability >= 0.1)."""
    s = Tables(spark, sf).scored_documents()
    return s.withColumn("prediction", (F.col("probability") >= 0.1).cast("double"))


SCORED_PRED = SCORED + """,
sp AS (SELECT *, CASE WHEN probability >= 0.1 THEN 1.0 ELSE 0.0 END AS prediction FROM scored)"""

CONF_SQL = f"""WITH {SCORED_PRED},
cnt AS (SELECT lang, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                     count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
                     count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                     count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM sp GROUP BY lang)"""


@query("agg_rmse", f"WITH {REGRESSION} SELECT l_returnflag, round(sqrt(avg((label - prediction) * (label - prediction))), 6) AS rmse FROM reg GROUP BY l_returnflag")
def q_rmse(spark, sf):
    m = M.regression_metrics(_reg(spark, sf), ["l_returnflag"], "label", "prediction")
    return m.select("l_returnflag", r6(F.col("rmse")).alias("rmse"))


@query("agg_rmse_partial", f"WITH {REGRESSION} SELECT round(sqrt(avg((label - prediction) * (label - prediction))), 6) AS rmse, count(*) AS n FROM reg")
def q_rmse_partial(spark, sf):
    m = M.regression_metrics(_reg(spark, sf), [], "label", "prediction")
    return m.select(r6(F.col("rmse")).alias("rmse"), "n")


@query("agg_mae", f"WITH {REGRESSION} SELECT l_returnflag, l_linestatus, round(avg(abs(label - prediction)), 6) AS mae FROM reg GROUP BY ALL")
def q_mae(spark, sf):
    m = M.regression_metrics(_reg(spark, sf), ["l_returnflag", "l_linestatus"], "label", "prediction")
    return m.select("l_returnflag", "l_linestatus", r6(F.col("mae")).alias("mae"))


@query("agg_pearson", f"WITH {REGRESSION} SELECT l_returnflag, round(corr(label, prediction), 6) AS pearson FROM reg GROUP BY ALL")
def q_pearson(spark, sf):
    m = M.regression_metrics(_reg(spark, sf), ["l_returnflag"], "label", "prediction")
    return m.select("l_returnflag", r6(F.col("pearson")).alias("pearson"))


@query("agg_spearman", f"""WITH {REGRESSION},
rk AS (SELECT l_returnflag,
  rank() OVER (PARTITION BY l_returnflag ORDER BY label) + (count(*) OVER (PARTITION BY l_returnflag, label) - 1) / 2 AS rl,
  rank() OVER (PARTITION BY l_returnflag ORDER BY prediction) + (count(*) OVER (PARTITION BY l_returnflag, prediction) - 1) / 2 AS rp
  FROM reg)
SELECT l_returnflag, round(corr(rl, rp), 6) AS spearman FROM rk GROUP BY ALL""")
def q_spearman(spark, sf):
    m = M.spearman(_reg(spark, sf), ["l_returnflag"], "label", "prediction")
    return m.select("l_returnflag", r6(F.col("spearman")).alias("spearman"))


@query("agg_accuracy", f"WITH {SCORED_PRED} SELECT lang, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM sp GROUP BY lang")
def q_accuracy(spark, sf):
    return M.accuracy(_scored(spark, sf), ["lang"], "label", "prediction").select("lang", r6(F.col("accuracy")).alias("accuracy"))


@query("agg_confusion", CONF_SQL + " SELECT * FROM cnt")
def q_confusion(spark, sf):
    return M.confusion(_scored(spark, sf), ["lang"], "label", "prediction")


@query("agg_class_stats", CONF_SQL + f""" SELECT lang, round({prec()}, 6) AS precision, round({rec()}, 6) AS recall,
  round({spec()}, 6) AS specificity, round({ba()}, 6) AS ba, round({f1()}, 6) AS f1 FROM cnt""")
def q_class_stats(spark, sf):
    c = M.class_stats(M.confusion(_scored(spark, sf), ["lang"], "label", "prediction"))
    return c.select("lang", *[r6(F.col(x)).alias(x) for x in ("precision", "recall", "specificity", "ba", "f1")])


@query("agg_scaled_cost", CONF_SQL + " SELECT lang, round((fp + 1.0 + fn * 10.0) / (tp + tn + fp + fn), 6) AS scaled_cost FROM cnt")
def q_scaled_cost(spark, sf):
    c = M.confusion(_scored(spark, sf), ["lang"], "label", "prediction")
    return c.select("lang", r6(M.scaled_cost()).alias("scaled_cost"))


@query("agg_plain_cost", CONF_SQL + " SELECT lang, round(fp * CAST(1 AS DOUBLE) + fn * CAST(10 AS DOUBLE), 6) AS cost FROM cnt")
def q_plain_cost(spark, sf):
    c = M.confusion(_scored(spark, sf), ["lang"], "label", "prediction")
    return c.select("lang", r6(M.plain_cost()).alias("cost"))


@query("agg_tpr_fpr", CONF_SQL + """ SELECT lang,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS tpr,
  round(CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END, 6) AS fpr FROM cnt""")
def q_tpr_fpr(spark, sf):
    c = M.confusion(_scored(spark, sf), ["lang"], "label", "prediction")
    return c.select("lang", r6(M.tpr()).alias("tpr"), r6(M.fpr()).alias("fpr"))


@query("agg_f1_guarded", CONF_SQL + f""", pr AS (SELECT lang, {prec()} AS p, {rec()} AS r FROM cnt)
SELECT lang, round(CASE WHEN r = 0 THEN 0.0 ELSE 2.0 * p * r / (p + r) END, 6) AS f1 FROM pr""")
def q_f1_guarded(spark, sf):
    c = M.confusion(_scored(spark, sf), ["lang"], "label", "prediction")
    c = c.select("lang", M.precision().alias("precision"), M.recall().alias("recall"))
    return c.select("lang", r6(M.f1_guarded()).alias("f1"))


@query("agg_roc_curve", f"""WITH {SCORED}, {MIDPOINT_SQL}
SELECT lang, probability, CAST(cum_tp AS BIGINT) AS cum_tp, CAST(cum_fp AS BIGINT) AS cum_fp, round(cum_fp / N, 6) AS fpr, round(cum_tp / P, 6) AS tpr FROM cum""")
def q_roc_curve(spark, sf):
    pts = M.roc_curve(Tables(spark, sf).scored_documents(), ["lang"], "label", "probability")
    return pts.select("lang", "probability", "cum_tp", "cum_fp", r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


@query("agg_roc_auc", f"WITH {SCORED}, {MIDPOINT_SQL} SELECT lang, round(roc_auc, 6) AS roc_auc FROM auc")
def q_roc_auc(spark, sf):
    a = M.roc_auc(Tables(spark, sf).scored_documents(), ["lang"], "label", "probability")
    return a.select("lang", r6(F.col("roc_auc")).alias("roc_auc"))


@query("agg_roc_spark", f"""WITH {SCORED}, pc AS (SELECT probability, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER (ORDER BY probability DESC ROWS UNBOUNDED PRECEDING) AS cum_tp, sum(pos) OVER () AS tp_all, sum(neg) OVER () AS tn_all FROM pc),
a AS (SELECT sum((neg / tn_all) * (2 * cum_tp - pos) / (2 * tp_all)) AS auc FROM cum)
SELECT round(auc, 6) AS auc_mllib, round(auc, 6) AS auc_trapezoid FROM a""")
def q_roc_spark(spark, sf):
    """Spark's BinaryClassificationEvaluator next to the trapezoid AUC (rows-only check)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    s = Tables(spark, sf).scored_documents()
    # numBins=0: no down-sampling of the curve, so ties collapse exactly as in the trapezoid form
    ev = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label", metricName="areaUnderROC", numBins=0)
    spark_auc = ev.evaluate(s)
    ours = M.roc_auc(s, [], "label", "probability")
    return ours.select(F.round(F.lit(spark_auc), 6).alias("auc_mllib"), r6(F.col("roc_auc")).alias("auc_trapezoid"))


@query("agg_metric_dispatch", f"""WITH {REGRESSION}, {SCORED_PRED.replace('WITH', '')},
cnt AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
               count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM sp)
SELECT 'rmse' AS metric, round(sqrt(avg((label - prediction) * (label - prediction))), 6) AS value FROM reg
UNION ALL SELECT 'mae', round(avg(abs(label - prediction)), 6) FROM reg
UNION ALL SELECT 'accuracy', round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) FROM sp
UNION ALL SELECT 'precision', round({prec()}, 6) FROM cnt
UNION ALL SELECT 'recall', round({rec()}, 6) FROM cnt
UNION ALL SELECT 'f1', round({f1()}, 6) FROM cnt""")
def q_metric_dispatch(spark, sf):
    from assayflow.operators.evaluators import evaluate

    reg, sc = _reg(spark, sf), _scored(spark, sf)
    parts = [evaluate(reg, m, "label", "prediction") for m in ("rmse", "mae")]
    parts += [evaluate(sc, m, "label", "prediction") for m in ("accuracy", "precision", "recall", "f1")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("metric", r6(F.col("value")).alias("value"))
