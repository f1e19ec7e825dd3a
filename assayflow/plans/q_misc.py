"""Remaining inventory items: paired t, midpoints, table-quality features, readout-name classifier,
task chooser, bad-category rule and the UDF surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.operators import cv as CV
from assayflow.operators import labels as L
from assayflow.operators import metrics as M
from assayflow.operators import models as MD
from assayflow.operators import udfs as U
from assayflow.operators.ordered import add_position, neighbours
from assayflow.operators.summaries import percentiles
from assayflow.functions import scalar as S
from assayflow.plans.inputs import Tables
from assayflow.plans.q_metrics import CONF_SQL, r6
from assayflow.plans.registry import query
from assayflow.plans.sql_inputs import REGRESSION, SCORED, prec, rec


def paired_t(df, a: str, b: str):
    """Paired two-sided t test of two metric columns (one row): n, t = mean(d) / (sd(d) / sqrt(n)) and its p-value."""
    d = F.col(a) - F.col(b)
    g = df.agg(F.count(d).alias("n"), F.avg(d).alias("__m"), F.stddev_samp(d).alias("__s"))
    g = g.select("n", (F.col("__m") / (F.col("__s") / F.sqrt(F.col("n")))).alias("t"))
    return g.withColumn("p_value", S.t_two_sided(F.col("t"), F.col("n") - 1))


PAIRS_SQL = """pr AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS b
  FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0 AND count(*) FILTER (WHERE o_orderstatus = 'O') > 0)"""


# the p-value by Simpson's rule over the density, another way than the operator's
@query("agg_ttest_paired", f"""WITH {PAIRS_SQL}, st AS (SELECT count(a - b) AS n, avg(a - b) / (stddev_samp(a - b) / sqrt(count(a - b))) AS t FROM pr),
pts AS (SELECT n, t, k, abs(t) * k / 20000 AS x, CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w FROM st, range(0, 20001) r(k)),
den AS (SELECT n, t, sum(w * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * pi()) * power(1 + x * x / (n - 1), -n / 2.0)) * abs(t) / 60000 AS middle FROM pts GROUP BY n, t)
SELECT n, round(t, 6) AS t, round(1 - 2 * middle, 6) AS p_value FROM den""")
def q_ttest(spark, sf):
    o = Tables(spark, sf).orders
    pr = o.groupBy("o_custkey").agg(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("a"),
                                   F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("b")).na.drop()
    t = paired_t(pr, "a", "b")
    return t.select("n", r6(F.col("t")).alias("t"), r6(F.col("p_value")).alias("p_value"))


@query("win_midpoints", f"""WITH {SCORED}, d AS (SELECT DISTINCT lang, probability FROM scored),
n AS (SELECT lang, probability, lead(probability) OVER (PARTITION BY lang ORDER BY probability) AS nxt FROM d)
SELECT lang, round((probability + nxt) / 2, 6) AS midpoint FROM n WHERE nxt IS NOT NULL""")
def q_midpoints(spark, sf):
    s = Tables(spark, sf).scored_documents().select("lang", "probability").distinct()
    p = add_position(s, ["probability"], ["lang"], "pos")
    n = neighbours(p, ["lang"], "pos", ["probability"], offset=1, prefix="next_")
    return n.filter(F.col("next_probability").isNotNull()).select("lang", r6((F.col("probability") + F.col("next_probability")) / 2.0).alias("midpoint"))


def quality_features(df, by, label, pred, cut):
    """Per table: AUC, accuracy, precision, recall, Pearson, Spearman, cost (fp + 10 fn), kurtosis and skew of the label."""
    c = df.withColumn("__l", (F.col(label) >= cut).cast("double")).withColumn("__p", (F.col(pred) >= cut).cast("double"))
    conf = M.class_stats(M.confusion(c, by, "__l", "__p"))
    auc = M.roc_auc(c, by, "__l", pred)
    acc = M.accuracy(c, by, "__l", "__p")
    reg = M.regression_metrics(df, by, label, pred).select(*by, "pearson")
    sp = M.spearman(df, by, label, pred)
    v = F.col(label)
    n = F.count(v)
    mom = df.groupBy(*by).agg(L.skewness_g1(v).alias("skew"), (((n + 1) * F.kurtosis(v) + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"))
    out = conf.join(auc, list(by)).join(acc, list(by)).join(reg, list(by)).join(sp, list(by)).join(mom, list(by))
    return out.withColumn("cost", M.plain_cost())


QF_SQL = f"""WITH {REGRESSION},
c AS (SELECT *, CASE WHEN label >= 50000 THEN 1 ELSE 0 END AS lc, CASE WHEN prediction >= 50000 THEN 1 ELSE 0 END AS pc FROM reg),
cnt AS (SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE lc = 1 AND pc = 1) AS tp, count(*) FILTER (WHERE lc = 0 AND pc = 0) AS tn,
  count(*) FILTER (WHERE lc = 0 AND pc = 1) AS fp, count(*) FILTER (WHERE lc = 1 AND pc = 0) AS fn, avg(CASE WHEN lc = pc THEN 1.0 ELSE 0.0 END) AS accuracy,
  corr(label, prediction) AS pearson FROM c GROUP BY ALL),
pcnt AS (SELECT l_returnflag, l_linestatus, prediction, count(*) FILTER (WHERE lc = 1) AS pos, count(*) FILTER (WHERE lc = 0) AS neg FROM c GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY prediction DESC ROWS UNBOUNDED PRECEDING) AS cum_tp,
  sum(pos) OVER (PARTITION BY l_returnflag, l_linestatus) AS tot_pos, sum(neg) OVER (PARTITION BY l_returnflag, l_linestatus) AS tot_neg FROM pcnt),
auc AS (SELECT l_returnflag, l_linestatus, sum((neg / tot_neg) * (2 * cum_tp - pos) / (2 * tot_pos)) AS roc_auc FROM cum GROUP BY ALL),
rk AS (SELECT l_returnflag, l_linestatus, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY label) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, label) - 1) / 2 AS rl,
  rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY prediction) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, prediction) - 1) / 2 AS rp FROM reg),
sp AS (SELECT l_returnflag, l_linestatus, corr(rl, rp) AS spearman FROM rk GROUP BY ALL),
mo AS (SELECT l_returnflag, l_linestatus, any_value(n) AS n, avg(power(x - mu, 2)) AS m2, avg(power(x - mu, 3)) AS m3, avg(power(x - mu, 4)) AS m4
  FROM (SELECT l_returnflag, l_linestatus, label AS x, avg(label) OVER w AS mu, count(*) OVER w AS n FROM reg WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)) GROUP BY ALL)
SELECT cnt.l_returnflag, cnt.l_linestatus, round(roc_auc, 6) AS roc_auc, round(accuracy, 6) AS accuracy, round({prec()}, 6) AS precision, round({rec()}, 6) AS recall,
  round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, fp + 10 * fn AS cost,
  round(((n + 1) * (m4 / (m2 * m2) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)), 6) AS kurtosis, round(m3 / power(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 6) AS skew
FROM cnt JOIN auc USING (l_returnflag, l_linestatus) JOIN sp USING (l_returnflag, l_linestatus) JOIN mo USING (l_returnflag, l_linestatus)"""


@query("rd_quality_features", QF_SQL)
def q_quality_features(spark, sf):
    r = Tables(spark, sf).regression_pairs()
    q = quality_features(r, ["l_returnflag", "l_linestatus"], "label", "prediction", 50000.0)
    return q.select("l_returnflag", "l_linestatus", *[r6(F.col(c)).alias(c) for c in ("roc_auc", "accuracy", "precision", "recall", "pearson", "spearman")],
                    F.col("cost").cast("bigint").alias("cost"), r6(F.col("kurtosis")).alias("kurtosis"), r6(F.col("skew")).alias("skew"))


def _doc_group_features(t):
    """Nine quality features per (lang, source) table of the scored documents."""
    s = t.scored_documents().join(t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    s = s.withColumn("nc", F.col("n_chars").cast("double"))
    by = ["lang", "source"]
    c = s.withColumn("__p", (F.col("probability") >= 0.1).cast("double"))
    conf = M.class_stats(M.confusion(c, by, "label", "__p"))
    auc = M.roc_auc(s, by, "label", "probability")
    acc = M.accuracy(c, by, "label", "__p")
    reg = s.groupBy(*by).agg(M.pearson("label", "probability").alias("pearson"), F.skewness("nc").alias("skew"), F.kurtosis("nc").alias("kurtosis"), F.count(F.lit(1)).alias("n"),
                              F.avg("nc").alias("mean_chars"))
    from assayflow.session import materialize

    f = conf.join(auc, by).join(acc, by).join(reg, by).withColumn("cost", M.plain_cost())
    return materialize(f.na.fill(0.0, ["pearson", "skew", "kurtosis", "roc_auc"]))


def _category_label(f):
    """Stand-in category for the chooser, from something that is none of its features: 1 (Regression) for tables whose
    documents are at least as long on average as those of the median table."""
    med = percentiles(f, [], "mean_chars", [50.0], "n+1", ["m"]).select("m").scalar()
    return f.withColumn("label", (F.col("mean_chars") >= med).cast("double"))


FEATURES9 = ["roc_auc", "accuracy", "precision", "recall", "pearson", "cost", "kurtosis", "skew", "n"]


@query("rd_task_model")
def q_task_model(spark, sf):
    """Regression-vs-classification chooser on nine table features (AUC > 0.6 only): random forest and kernel SVM alone and as a vote.

    Where no table has such an AUC there is nothing to choose for, and the result has no rows."""
    from assayflow.operators.features import assemble, to_ml_vector

    t = Tables(spark, sf)
    f = _doc_group_features(t)
    f = assemble(f, FEATURES9, "a").withColumn("features", to_ml_vector("a")).filter(F.col("roc_auc") > 0.6)
    if f.isEmpty():
        return spark.createDataFrame([], "id string, lang string, source string, p_rf double, p_svm double, prediction double")
    f = _category_label(f)
    rf = MD.estimator("rf_class", numTrees=10).fit(f).transform(f).select("lang", "source", F.col("prediction").alias("p_rf"))
    from assayflow.operators.features import minmax_scale

    f = minmax_scale(f, "a", "s")  # kernel on [0,1]-scaled features
    lms = MD.sample_landmarks(f, "s", m=10)
    sv = MD.kernel_svm("rbf", lms, "s", "label", gamma=1.0).fit(f).transform(f).select("lang", "source", F.col("prediction").alias("p_svm"))
    j = rf.join(sv, ["lang", "source"])
    long = j.select("lang", "source", F.explode(F.array("p_rf", "p_svm")).alias("prediction")).withColumn("id", F.concat_ws("/", "lang", "source"))
    vote = MD.majority_vote(long, "id")
    return j.withColumn("id", F.concat_ws("/", "lang", "source")).join(vote, "id")


@query("lab_bad_category")
def q_bad_category(spark, sf):
    """AUC of at most 0.6 -> 'Bad'; otherwise the chooser model, which is fitted on the other tables only, decides Regression or Classification.

    Where every table is bad, no model is needed and none is fitted."""
    from assayflow.operators.features import assemble, to_ml_vector

    t = Tables(spark, sf)
    f = assemble(_doc_group_features(t), FEATURES9, "a").withColumn("features", to_ml_vector("a"))
    good = f.filter(F.col("roc_auc") > 0.6)
    if good.isEmpty():
        p = f.withColumn("prediction", F.lit(None).cast("double"))
    else:
        p = MD.estimator("rf_class", numTrees=10).fit(_category_label(good)).transform(f)
    cat = F.when(F.col("roc_auc") <= 0.6, "Bad").when(F.col("prediction") == 1.0, "Regression").otherwise("Classification")
    return p.select("lang", "source", r6(F.col("roc_auc")).alias("roc_auc"), cat.alias("category"))


@query("rd_ml_readouts")
def q_ml_readouts(spark, sf):
    """Text classifier over names and descriptions (tokenizer -> word counts -> naive Bayes, random forest, linear SVM), ranked by CV accuracy."""
    from assayflow.operators.features import word_vectors

    p = Tables(spark, sf).part
    label = (F.col("p_size") >= 25).cast("double")
    d = p.select(F.col("p_partkey").alias("no"), label.alias("label"), S.tokenize(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("tokens"))
    d = CV.add_folds(word_vectors(d, "no", "tokens"), ["no"], 3)
    ests = {"naive_bayes": MD.estimator("nb_multinomial"), "random_forest": MD.estimator("rf_class", numTrees=10),
            "linear_svm": MD.estimator("linear_svc", maxIter=20), "linear_svm_strict": MD.estimator("linear_svc", maxIter=20, regParam=0.1)}
    _, ranked = CV.leaderboard(ests, d, 3, "accuracy", classification=True)
    return ranked


# ----------------------------------------------------------------- UDF surface

@query("udf_row", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS p, unnest(v) AS y FROM e),
st AS (SELECT p, avg(y) AS m, stddev_samp(y) AS s FROM x GROUP BY p)
SELECT vec_id AS no, true AS same_value, true AS same_pair, round(sum((y - m) / s), 4) AS scaled FROM x JOIN st ON x.p = st.p GROUP BY vec_id""")
def q_udf_row(spark, sf):
    """Fitted models as row transformers of plain Column expressions: features -> value, -> (prediction, probability), -> vector."""
    from assayflow.plans.q_ml import _class_data, _reg_data

    t = Tables(spark, sf)
    d = _reg_data(t)
    lr = MD.estimator("linear_reg", regParam=0.1).fit(d)
    ours = MD.LinearRowModel(inputCol="a", outputCol="ours", weights=[float(x) for x in lr.coefficients], intercept=float(lr.intercept)).transform(d)
    value = lr.transform(ours).select("no", (F.abs(F.col("ours") - F.col("prediction")) < 1e-9).alias("same_value"))
    c = _class_data(t)
    lg = MD.estimator("logistic", maxIter=20).fit(c)
    pair = U.row_pair(c, "a", "pair", [float(x) for x in lg.coefficients], float(lg.intercept))
    pair = lg.transform(pair).select("no", ((F.col("pair.prediction") == F.col("prediction")) & (F.abs(F.col("pair.probability") - MD.probability_of_positive()) < 1e-9)).alias("same_pair"))
    width = c.agg(F.max(F.size("a"))).first()[0]
    st = c.agg(*[F.avg(F.col("a")[i]).alias(f"m{i}") for i in range(width)], *[F.stddev_samp(F.col("a")[i]).alias(f"s{i}") for i in range(width)]).first()
    vector = U.row_vector(c, "a", "scaled", [st[f"m{i}"] for i in range(width)], [st[f"s{i}"] for i in range(width)])
    vector = vector.select("no", F.round(F.aggregate("scaled", F.lit(0.0), lambda acc, x: acc + x), 4).alias("scaled"))
    return value.join(pair, "no").join(vector, "no")


@query("udf_column", "SELECT p_partkey, upper(p_name) AS name_upper, CAST(length(p_name) AS INTEGER) AS name_length FROM part")
def q_udf_column(spark, sf):
    p = Tables(spark, sf).part
    p = U.with_column_from(p, "name_upper", F.upper, "p_name")
    return U.with_column_from(p, "name_length", F.length, "p_name").select("p_partkey", "name_upper", "name_length")


@query("udf_predicate", "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.04 AND l_returnflag = 'R' GROUP BY 1")
def q_udf_predicate(spark, sf):
    li = Tables(spark, sf).lineitem
    pred = F.col("l_discount").between(0.02, 0.04) & (F.col("l_returnflag") == "R")
    return U.filter_by(li, pred).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("udaf_pair", "SELECT l_returnflag, round(sqrt(sum((l_tax - l_discount) * (l_tax - l_discount)) / count(*)), 6) AS rmse, count(*) AS n FROM lineitem GROUP BY 1")
def q_udaf_pair(spark, sf):
    a = U.pair_accumulator(Tables(spark, sf).lineitem, ["l_returnflag"], "l_tax", "l_discount")
    return a.select("l_returnflag", r6(F.col("rmse")).alias("rmse"), "n")


@query("udaf_metric", CONF_SQL + " SELECT lang, round(CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE tp / (tp + fp + fn) END, 6) AS jaccard FROM cnt")
def q_udaf_metric(spark, sf):
    from assayflow.plans.q_metrics import _scored

    c = M.confusion(_scored(spark, sf), ["lang"], "label", "prediction")
    jac = M.safe_div(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))
    return U.metric_over_counts(c, jac, "jaccard").select("lang", r6(F.col("jaccard")).alias("jaccard"))


@query("udtf_table", """SELECT o_orderkey AS key, o_orderpriority AS system,
  round(CASE WHEN stddev_pop(o_totalprice) OVER w > 0 THEN (o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w ELSE 0 END, 6) AS z
FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""")
def q_udtf_table(spark, sf):
    """A pandas table function applied per chunk of 1000 rows of each system; group statistics come from a Spark aggregate."""
    o = Tables(spark, sf).orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("system"), F.col("o_totalprice").alias("value"))
    st = o.groupBy("system").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return U.per_chunk_table(o.join(st, "system"), ["system"], ["key"], 1000, U.zscore_table, "key long, system string, z double")
