"""§2.13-2.14 model, cross-validation and screening queries, §2.18 UDF-surface queries and the
remaining §2.8/§2.9/§2.15 items that need models or pair statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayflow.operators import cv as CV
from assayflow.operators import labels as L
from assayflow.operators import metrics as M
from assayflow.operators import models as MD
from assayflow.operators import screening as SC
from assayflow.operators.features import descriptors, to_ml_vector
from assayflow.operators.metrics import checked
from assayflow.operators.ordered import attach, keyed_join
from assayflow.plans.inputs import Tables
from assayflow.plans.q_metrics import MIDPOINT_SQL, r6
from assayflow.plans.registry import query
from assayflow.plans.sql_inputs import SCORED
from assayflow.session import scratch_dir

K = 3


def _class_data(t):
    """embeddings as a classification system: features = embedding, label = (label >= 5)."""
    e = t.embeddings
    return e.select(F.col("vec_id").alias("no"), F.col("embedding").cast("array<double>").alias("a"), to_ml_vector("embedding").alias("features"),
                    (F.col("label") >= 5).cast("double").alias("label"), F.col("label").cast("double").alias("value"))


def _reg_data(t):
    e = _class_data(t)
    return e.withColumn("label", F.col("value"))


def _fit_predict(est, df, prob=False):
    m = est.fit(df)
    p = m.transform(df)
    cols = ["no", "label", "prediction"]
    if prob and "probability" in p.columns:
        return p.select(*cols, MD.probability_of_positive().alias("probability"))
    return p.select(*cols)


def _reg_query(name, **params):
    def fn(spark, sf):
        return _fit_predict(MD.estimator(name, **params), _reg_data(Tables(spark, sf)))
    return fn


def _class_query(name, prob=True, **params):
    def fn(spark, sf):
        return _fit_predict(MD.estimator(name, **params), _class_data(Tables(spark, sf)), prob)
    return fn


query("ml_rf_class")(_class_query("rf_class", numTrees=20))
query("ml_rf_reg")(_reg_query("rf_reg", numTrees=20))
query("ml_gbt_reg")(_reg_query("gbt_reg", maxIter=10))
query("ml_linear_svm")(_class_query("linear_svc", prob=False, maxIter=20))
query("ml_linear_svr")(_reg_query("linear_svr", maxIter=20))
query("ml_logistic")(_class_query("logistic", maxIter=20))
query("ml_linear_reg")(_reg_query("linear_reg", regParam=0.1, elasticNetParam=0.5))


@query("ml_dt")
def q_dt(spark, sf):
    t = Tables(spark, sf)
    c = _fit_predict(MD.estimator("dt_class", maxDepth=5), _class_data(t), True).select("no", F.lit("class").alias("task"), "prediction")
    r = _fit_predict(MD.estimator("dt_reg", maxDepth=5), _reg_data(t)).select("no", F.lit("reg").alias("task"), "prediction")
    return c.unionByName(r)


NB_SQL = """WITH e AS (SELECT vec_id AS no, CAST(label >= 5 AS DOUBLE) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT no, label, unnest(range(1, len(v) + 1)) AS p, unnest(v) AS y FROM e),
k AS (SELECT label, count(*) AS n, ln((count(*) + 1) / (SELECT count(*) + 2.0 FROM e)) AS pi FROM e GROUP BY label),
bt AS (SELECT x.label, p, (count(*) FILTER (WHERE y > 0) + 1) / (any_value(k.n) + 2.0) AS t FROM x JOIN k ON x.label = k.label GROUP BY x.label, p),
ms AS (SELECT label, p, sum(abs(y) * 100) AS s FROM x GROUP BY label, p), mt AS (SELECT label, p, ln((s + 1) / (sum(s) OVER (PARTITION BY label) + count(*) OVER (PARTITION BY label))) AS t FROM ms),
sc AS (SELECT 'bernoulli' AS model, x.no, b.label AS c, sum(CASE WHEN y > 0 THEN ln(t) ELSE ln(1 - t) END) AS s FROM x JOIN bt b ON x.p = b.p GROUP BY ALL
  UNION ALL SELECT 'multinomial', x.no, m.label, sum(abs(y) * 100 * t) FROM x JOIN mt m ON x.p = m.p GROUP BY ALL),
w AS (SELECT model, no, max(s + pi) FILTER (WHERE c = 0) AS s0, max(s + pi) FILTER (WHERE c = 1) AS s1 FROM sc JOIN k ON sc.c = k.label GROUP BY model, no)
SELECT w.no, e.label, CAST(CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS DOUBLE) AS prediction, round(1 / (1 + exp(s0 - s1)), 6) AS probability, model FROM w JOIN e ON w.no = e.no"""


@query("ml_nb", NB_SQL)
def q_nb(spark, sf):
    t = Tables(spark, sf)
    d = _class_data(t)
    bern = d.withColumn("features", to_ml_vector(F.transform("a", lambda x: F.when(x > 0, 1.0).otherwise(0.0))))
    multi = d.withColumn("features", to_ml_vector(F.transform("a", lambda x: F.abs(x) * 100)))
    b = _fit_predict(MD.estimator("nb_bernoulli", smoothing=1.0), bern, True).withColumn("model", F.lit("bernoulli"))
    m = _fit_predict(MD.estimator("nb_multinomial", smoothing=1.0), multi, True).withColumn("model", F.lit("multinomial"))
    return b.unionByName(m).withColumn("probability", r6(F.col("probability")))


@query("ml_glr")
def q_glr(spark, sf):
    d = _reg_data(Tables(spark, sf)).withColumn("label", F.col("label") + 1.0)
    g = _fit_predict(MD.estimator("glr_gaussian"), d).withColumn("family", F.lit("gaussian"))
    m = _fit_predict(MD.estimator("glr_gamma"), d).withColumn("family", F.lit("gamma"))
    return g.unionByName(m)


@query("ml_nn_class")
def q_nn(spark, sf):
    return _fit_predict(MD.estimator("mlp", layers=[64, 16, 2], maxIter=50), _class_data(Tables(spark, sf)), True)


def _kernel(spark, sf, regression):
    d = (_reg_data if regression else _class_data)(Tables(spark, sf))
    lms = MD.sample_landmarks(d, "a", m=30)
    eps = None
    if regression:
        eps = MD.svm_epsilon(M.label_scale(d, [], "label").first()[0])
    pipe = MD.kernel_svm("rbf", lms, "a", "label", regression=regression, gamma=0.5, epsilon=eps)
    return pipe.fit(d).transform(d).select("no", "label", "prediction")


@query("ml_kernel_svm_class")
def q_kernel_class(spark, sf):
    return _kernel(spark, sf, False)


@query("ml_kernel_svm_reg")
def q_kernel_reg(spark, sf):
    return _kernel(spark, sf, True)


@query("ml_pipeline")
def q_pipeline(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import MinMaxScaler

    d = _class_data(Tables(spark, sf))
    pipe = Pipeline(stages=[MinMaxScaler(inputCol="features", outputCol="scaled"), LogisticRegression(featuresCol="scaled", maxIter=20)])
    return pipe.fit(d).transform(d).select("no", "prediction")


@query("ml_persist", "SELECT vec_id AS no, true AS same FROM embeddings")
def q_persist(spark, sf):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression

    d = _class_data(Tables(spark, sf))
    lms = MD.sample_landmarks(d, "a", m=10)
    pipe = Pipeline(stages=[MD.KernelMap(inputCol="a", outputCol="k", landmarks=lms, kernel="rbf", gamma=0.5), LogisticRegression(featuresCol="k", maxIter=20)])
    model = pipe.fit(d)
    path = scratch_dir(spark, "pipeline")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = model.transform(d).select("no", MD.probability_of_positive().alias("p1"))
    b = again.transform(d).select("no", MD.probability_of_positive().alias("p2"))
    return a.join(b, "no").select("no", (F.abs(F.col("p1") - F.col("p2")) < 1e-9).alias("same"))


# ---------------------------------------------------------------- ensembles

VOTE_SQL = """WITH v AS (SELECT d.doc_id, coalesce(CAST(l.quality AS DOUBLE), 0.0) AS a, coalesce(CAST(l.toxic AS DOUBLE), 0.0) AS b,
  CASE WHEN d.n_chars > 2000 THEN 1.0 ELSE 0.0 END AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CAST(CASE WHEN a + b + c > 1.5 THEN 1 WHEN a + b + c < 1.5 THEN 0 ELSE 1 END AS DOUBLE) AS prediction FROM v"""


@query("ml_vote", VOTE_SQL)
def q_vote(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    long = d.select("doc_id", F.explode(F.array(
        F.coalesce(F.col("quality").cast("double"), F.lit(0.0)), F.coalesce(F.col("toxic").cast("double"), F.lit(0.0)),
        F.when(F.col("n_chars") > 2000, 1.0).otherwise(0.0))).alias("prediction"))
    return MD.majority_vote(long, "doc_id")


CONS_SQL = f"""WITH {SCORED},
mp AS (SELECT s.doc_id, s.lang, s.label, 'len' AS model, s.probability AS p FROM scored s
  UNION ALL SELECT s.doc_id, s.lang, s.label, 'lines', (len(string_split(d.text, chr(10))) - 1) / (len(string_split(d.text, chr(10))) + 1.0) FROM scored s JOIN documents d ON s.doc_id = d.doc_id
  UNION ALL SELECT s.doc_id, s.lang, s.label, 'digits', len(regexp_extract_all(d.text, '[0-9]')) / (d.n_chars + 1.0) FROM scored s JOIN documents d ON s.doc_id = d.doc_id),
pc AS (SELECT model, p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM mp GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_tp, sum(pos) OVER (PARTITION BY model) AS tot_pos, sum(neg) OVER (PARTITION BY model) AS tot_neg FROM pc),
w AS (SELECT model, sum((neg / tot_neg) * (2 * cum_tp - pos) / (2 * tot_pos)) AS weight FROM cum GROUP BY model),
kept AS (SELECT * FROM w WHERE model <> (SELECT arg_min(model, (weight, model)) FROM w)),
su AS (SELECT doc_id, any_value(label) AS label, sum(p * weight) AS probability FROM mp JOIN kept ON mp.model = kept.model GROUP BY doc_id),
rs AS (SELECT doc_id, label, round(probability, 6) AS probability FROM su),
qc AS (SELECT probability, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM rs GROUP BY 1),
qm AS (SELECT *, sum(pos) OVER (ORDER BY probability DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER (ORDER BY probability DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER () AS all_pos,
  lag(probability) OVER (ORDER BY probability) AS prev FROM qc),
qf AS (SELECT (prev + probability) / 2 AS cutoff, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (tp + fp + all_pos) END AS f1 FROM qm WHERE prev IS NOT NULL),
ct AS (SELECT cutoff FROM qf ORDER BY f1 DESC, cutoff LIMIT 1)
SELECT doc_id, probability, CAST(CASE WHEN probability > cutoff THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM rs, ct"""


def _model_probs(t):
    s = t.scored_documents()
    d = t.documents.select("doc_id", "text", "n_chars")
    j = s.join(d, "doc_id")
    lines = F.size(F.split("text", "\n")) - 1
    return j.select("doc_id", "lang", "label", F.explode(F.array(
        F.struct(F.lit("len").alias("model"), F.col("probability").alias("p")),
        F.struct(F.lit("lines").alias("model"), (lines / (lines + 2.0)).alias("p")),
        F.struct(F.lit("digits").alias("model"), (F.regexp_count("text", F.lit("[0-9]")) / (F.col("n_chars") + 1.0)).alias("p")))).alias("m")
    ).select("doc_id", "lang", "label", "m.model", "m.p")


@query("ml_consensus", CONS_SQL)
def q_consensus(spark, sf):
    t = Tables(spark, sf)
    mp = _model_probs(t)
    w = M.roc_auc(mp, ["model"], "label", "p").select("model", F.col("roc_auc").alias("weight"))
    c = MD.consensus(mp.withColumnRenamed("p", "probability"), w, "doc_id", "model")
    c = c.select("doc_id", r6(F.col("probability")).alias("probability")).join(t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    cut = M.optimize_midpoint(c, [], "label", "probability").select("cutoff").scalar()
    return M.apply_cutoff(c, "probability", cut).select("doc_id", "probability", "prediction")


@query("ml_consensus_model", "SELECT vec_id AS no, true AS same FROM embeddings")
def q_consensus_model(spark, sf):
    """Sub-models weighted by cross-validation, cutoff tuned on out-of-fold sums, stored and reloaded as one model; both give each row the same."""
    from assayflow.operators.consensus import ConsensusClassifier, ConsensusModel

    d = _folded(Tables(spark, sf))
    ests = {"logistic": MD.estimator("logistic", maxIter=20), "rf": MD.estimator("rf_class", numTrees=10), "dt": MD.estimator("dt_class", maxDepth=4)}
    model = ConsensusClassifier(ests, K).fit(d)
    path = scratch_dir(spark, "consensus")
    model.write().overwrite().save(path)
    a = model.transform(d).select("no", F.col("probability").alias("p1"), F.col("prediction").alias("c1"))
    b = ConsensusModel.load(path).transform(d).select("no", F.col("probability").alias("p2"), F.col("prediction").alias("c2"))
    return a.join(b, "no").select("no", ((F.abs(F.col("p1") - F.col("p2")) < 1e-9) & (F.col("c1") == F.col("c2"))).alias("same"))


@query("ml_prob_to_pred", f"""WITH {SCORED}, {MIDPOINT_SQL}
SELECT s.doc_id, CAST(CASE WHEN s.probability > b.cutoff THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM scored s JOIN best b ON s.lang = b.lang""")
def q_prob_to_pred(spark, sf):
    s = Tables(spark, sf).scored_documents()
    best = M.optimize_midpoint(s, ["lang"], "label", "probability").select("lang", "cutoff")
    return M.apply_cutoff(attach(s, best, ["lang"]), "probability", F.col("cutoff")).select("doc_id", "prediction")


def _doc_features(t):
    """Descriptor features of every document, computed once over the whole texts (materialized for the fits)."""
    from assayflow.session import materialize

    d = t.documents.select("doc_id", "lang", "text")
    return materialize(d.select("doc_id", "lang", descriptors(F.col("text")).alias("a")).withColumn("features", to_ml_vector("a")))


@query("ml_score_features")
def q_score_features(spark, sf):
    """Score every document with a stored model, trained on the labelled ones; prediction and probability aligned to the input key."""
    t = Tables(spark, sf)
    f = _doc_features(t)
    train = f.join(t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    path = scratch_dir(spark, "model")
    fitted = MD.estimator("logistic", maxIter=20).fit(train)
    fitted.write().overwrite().save(path)
    scored = type(fitted).load(path).transform(f.filter(F.col("a").isNotNull()))
    scored = scored.select("doc_id", "prediction", MD.probability_of_positive("probability").alias("probability"))
    return t.documents.select("doc_id").join(scored, "doc_id", "left")


# ----------------------------------------------------------- cross-validation

def _folded(t, regression=False):
    d = (_reg_data if regression else _class_data)(t)
    return CV.add_folds(d, ["no"], K)


@query("cv_predict")
def q_cv_predict(spark, sf):
    """Out-of-fold predictions with the overall accuracy and each fold's train and test accuracy."""
    p = CV.cv_predict(MD.estimator("logistic", maxIter=20), _folded(Tables(spark, sf)), K, keep=["no"], classification=True, with_train=True)
    return CV.cv_report(p, "accuracy")


@query("cv_predict_spark")
def q_cv_predict_spark(spark, sf):
    """MLlib CrossValidator with a seeded hash fold column: the out-of-fold predictions of the best grid point with its
    average metric, each from the sub-model that has not seen the row."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    d = CV.add_folds(_class_data(Tables(spark, sf)), ["no"], K, method="hash")
    lr = MD.estimator("logistic", maxIter=20)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(numBins=0), foldCol="fold", numFolds=K, collectSubModels=True)
    m = cv.fit(d)
    best = max(range(len(grid)), key=lambda i: (m.avgMetrics[i], -i))
    out = None
    for fold in range(K):
        p = m.subModels[fold][best].transform(d.filter(F.col("fold") == fold))
        p = p.select("no", "label", "prediction", MD.probability_of_positive("probability").alias("probability"), F.col("fold").alias("foldNo"))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("regParam", F.lit(float(grid[best][lr.regParam]))).withColumn("auc", F.lit(float(m.avgMetrics[best])))


@query("cv_grid", """SELECT CAST(t.l_tax AS DOUBLE) AS regParam, CAST(d.l_discount * 10 AS DOUBLE) AS elasticNetParam
FROM (SELECT DISTINCT round(l_tax, 2) AS l_tax FROM lineitem) t, (SELECT DISTINCT round(l_discount, 2) AS l_discount FROM lineitem) d""")
def q_cv_grid(spark, sf):
    """Parameter grid whose axes are value lists read from the data (value product, no join)."""
    from assayflow.operators.joins import value_product

    li = Tables(spark, sf).lineitem
    g = value_product({"regParam": li.select(F.round("l_tax", 2)), "d": li.select(F.round("l_discount", 2))})
    return g.select(F.col("regParam").cast("double"), (F.col("d") * 10).cast("double").alias("elasticNetParam"))


@query("cv_optimize")
def q_cv_optimize(spark, sf):
    t = Tables(spark, sf)
    grid = CV.param_grid({"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 0.5]})
    return CV.optimize(spark, lambda p: MD.estimator("linear_reg", **p), grid, _folded(t, True), K, "rmse", name="embeddings", method="linear_reg")


@query("cv_results_table")
def q_cv_results_table(spark, sf):
    t = Tables(spark, sf)
    grid = CV.param_grid({"maxDepth": [2, 4]})
    return CV.optimize(spark, lambda p: MD.estimator("dt_class", **p), grid, _folded(t), K, "accuracy", classification=True,
                       name="embeddings", method="dt_class")


@query("cv_apply_best", """WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity AS x FROM lineitem),
m AS (SELECT 1 AS k, true AS fit_intercept, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l UNION ALL SELECT 2, false, sum(x * y) / sum(x * x), 0 FROM l),
r AS (SELECT k, fit_intercept, a, b, sqrt(avg((y - a - b * x) * (y - a - b * x))) AS rmse FROM l, m GROUP BY ALL),
best AS (SELECT * FROM r ORDER BY rmse, k LIMIT 1)
SELECT l_orderkey, l_linenumber, fit_intercept, round(a + b * x, 2) AS prediction FROM l, best""")
def q_cv_apply_best(spark, sf):
    """Best row of a tuning table -> estimator with those parameters, fitted and applied to every line; the predictions are
    those of the normal equations."""
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("label"), to_ml_vector(F.array(F.col("l_quantity").cast("double"))).alias("features"))
    make = lambda p: MD.estimator("linear_reg", fitIntercept=p["fit_intercept"])
    tried = []
    for params in CV.param_grid({"fit_intercept": [True, False]}):
        tried.append((params["fit_intercept"], M.regression_metrics(make(params).fit(li).transform(li), [], "label", "prediction").first()["rmse"]))
    path = scratch_dir(spark, "tuning")
    spark.createDataFrame(tried, "fit_intercept boolean, rmse double").write.parquet(path)
    applied, best = CV.apply_best(spark.read.parquet(path), ["fit_intercept"], "rmse", make, li)
    return applied.select("l_orderkey", "l_linenumber", F.lit(best["fit_intercept"]).alias("fit_intercept"), F.round("prediction", 2).alias("prediction"))


@query("cv_tune_system")
def q_cv_tune_system(spark, sf):
    """Tune on each system (embedding label groups): columns mapped, nulls dropped, rows shuffled, results appended once."""
    t = Tables(spark, sf)
    e = t.embeddings.select(F.col("vec_id").alias("compound"), to_ml_vector("embedding").alias("fingerprint"), F.col("label").cast("double").alias("activity"),
                            F.concat(F.lit("S"), (F.col("label") >= 5).cast("int").cast("string")).alias("system"))
    mapping = {"compound": "no", "fingerprint": "features", "activity": "label"}
    path = scratch_dir(spark, "tuning-results")
    systems = [r[0] for r in e.select("system").distinct().orderBy("system").collect()]  # system names: metadata
    grid = CV.param_grid({"regParam": [0.0, 0.1]})
    for s in [*systems, systems[0]]:  # the last one is there already and is skipped
        CV.tune_system(spark, e.filter(F.col("system") == s), s, mapping, ["no"], lambda p: MD.estimator("linear_reg", **p), grid, K, "rmse", path, "linear_reg")
    return spark.read.parquet(path)


@query("cv_leaderboard")
def q_cv_leaderboard(spark, sf):
    t = Tables(spark, sf)
    ests = {"logistic": MD.estimator("logistic", maxIter=20), "rf": MD.estimator("rf_class", numTrees=10), "nb": MD.estimator("nb_bernoulli")}
    d = _folded(t).withColumn("features", to_ml_vector(F.transform("a", lambda x: F.when(x > 0, 1.0).otherwise(0.0))))
    _, ranked = CV.leaderboard(ests, d, K, "rocAuc", classification=True)
    return ranked


@query("cv_leaderboard_regression")
def q_cv_leaderboard_regression(spark, sf):
    """Regressors ranked by the correlation of their out-of-fold predictions."""
    ests = {"linear": MD.estimator("linear_reg", regParam=0.1), "rf": MD.estimator("rf_reg", numTrees=10), "dt": MD.estimator("dt_reg")}
    preds, _ = CV.leaderboard(ests, _folded(Tables(spark, sf), True), K, "rmse", keep=["no"])
    return CV.regression_leaderboard_metrics(preds)


@query("cv_label_variants")
def q_cv_label_variants(spark, sf):
    t = Tables(spark, sf)
    d = _folded(t, True)
    out = None
    for name, lab in (("raw", F.col("value")), ("log", F.log10(F.col("value") + 1.0))):
        p = CV.cv_predict(MD.estimator("linear_reg", regParam=0.1), d.withColumn("label", lab), K).withColumn("variant", F.lit(name))
        m = M.regression_metrics(p, ["variant"], "label", "prediction")
        out = m if out is None else out.unionByName(m)
    return out


@query("cv_percent_variants")
def q_cv_percent_variants(spark, sf):
    """Classifiers at 20, 30, 40 and 50 percent active of a continuous label (one threshold pass for all percents)."""
    t = Tables(spark, sf)
    d = _folded(t, True)
    th = L.percent_active_many(d, [], "value", [20.0, 30.0, 40.0, 50.0]).collect()  # four thresholds
    out = None
    for r in th:
        up = r["direction"] == "UP"
        lab = (F.col("value") >= r["threshold"]) if up else (F.col("value") <= r["threshold"])
        p = CV.cv_predict(MD.estimator("logistic", maxIter=20), d.withColumn("label", lab.cast("double")), K, classification=True)
        m = M.roc_auc(p, [], "label", "probability").select(F.lit(r["percent"]).alias("percent"), "roc_auc")
        out = m if out is None else out.unionByName(m)
    return out


@query("cv_two_step")
def q_cv_two_step(spark, sf):
    t = Tables(spark, sf)
    d = _folded(t)
    cls = CV.cv_predict(MD.estimator("logistic", maxIter=20), d, K, keep=["no"], classification=True)
    actives = d.join(cls.filter(F.col("prediction") == 1.0).select("no"), "no").withColumn("label", F.col("value"))
    reg = CV.cv_predict(MD.estimator("linear_reg", regParam=0.1), actives, K, keep=["no"])
    return reg.select("no", "label", "prediction", "foldNo")


@query("cv_auto_task")
def q_cv_auto_task(spark, sf):
    """lab_is_binary chooses classification or regression for each candidate label."""
    t = Tables(spark, sf)
    d = _folded(t)
    cands = d.select("no", "a", "features", "fold", F.explode(F.array(
        F.struct(F.lit("binary").alias("target"), F.col("label").alias("y")), F.struct(F.lit("value").alias("target"), F.col("value").alias("y")))).alias("c")
    ).select("no", "a", "features", "fold", "c.target", "c.y")
    kinds = {r["target"]: r["is_binary"] for r in L.is_binary(cands, ["target"], "y").collect()}  # one verdict per label
    out = None
    for target, binary in kinds.items():
        sub = cands.filter(F.col("target") == target).withColumn("label", F.col("y"))
        est = MD.estimator("logistic", maxIter=20) if binary else MD.estimator("linear_reg", regParam=0.1)
        p = CV.cv_predict(est, sub, K)
        metric = "accuracy" if binary else "rmse"
        m = CV.evaluate(p, metric).select(F.lit(target).alias("target"), F.lit("classification" if binary else "regression").alias("task"), "metric", "value")
        out = m if out is None else out.unionByName(m)
    return out


@query("cv_multi_system")
def q_cv_multi_system(spark, sf):
    t = Tables(spark, sf)
    d = _reg_data(t).withColumn("System", F.concat(F.lit("S"), (F.col("value") >= 5).cast("int").cast("string")))
    systems = [r[0] for r in d.select("System").distinct().orderBy("System").collect()]
    preds = None
    for s in systems:
        sd = CV.add_folds(d.filter(F.col("System") == s), ["no"], K)
        for name in ("linear_reg", "rf_reg"):
            est = MD.estimator(name, **({"regParam": 0.1} if name == "linear_reg" else {"numTrees": 10}))
            p = CV.cv_predict(est, sd, K).withColumn("System", F.lit(s)).withColumn("estimator", F.lit(name))
            preds = p if preds is None else preds.unionByName(p)
    m = M.regression_metrics(preds, ["System", "estimator"], "label", "prediction")
    best = m.groupBy("System").agg(F.min_by("estimator", F.struct("rmse", "estimator")).alias("best_estimator"))
    return m.join(best, "System")


# ------------------------------------------------------------------ screening

@query("scr_predict_reference")
def q_scr_predict(spark, sf):
    t = Tables(spark, sf)
    f = _doc_features(t)
    train = f.join(t.labels.select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")
    model = MD.estimator("rf_class", numTrees=10).fit(train)
    pred = SC.score_library(model, f, "doc_id", "a").select("doc_id", F.lit("toxic").alias("assay"), "prediction")
    return SC.hitrate_tested(t.documents.select("doc_id"), pred.withColumnRenamed("prediction", "active"), "doc_id", "assay", "active")


REPORT_SQL = " UNION ALL ".join(f"""SELECT * FROM (WITH {SCORED.replace("CAST(l.quality AS DOUBLE) AS label", f"CAST(l.{assay} AS DOUBLE) AS label")}, {MIDPOINT_SQL},
m AS (SELECT d.lang, min(d.n_chars) AS mn, max(d.n_chars) AS mx FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang),
p AS (SELECT d.lang, CASE WHEN CASE WHEN m.mx = m.mn THEN 0 ELSE (d.n_chars - m.mn) / (m.mx - m.mn) END > b.cutoff THEN 1 ELSE 0 END AS hit FROM documents d JOIN m ON d.lang = m.lang JOIN best b ON d.lang = b.lang)
SELECT p.lang, '{assay}' AS "toxField", 'length' AS model, count(*) AS tested_compounds, sum(hit)::BIGINT AS n_predicted, any_value(n.n) AS dataset_compounds, round(sum(hit) / count(*), 6) AS hitrate
FROM p JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) n ON p.lang = n.lang GROUP BY p.lang)""" for assay in ("quality", "toxic"))


@query("scr_report", REPORT_SQL)
def q_scr_report(spark, sf):
    """Every document scored for two assays by the length model (range and F1 cutoff per language, fitted on the labelled
    ones).  The scoring pass is timed and counted on the way; the time is part of the report, not of the compared columns."""
    t = Tables(spark, sf)
    sizes = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("dataset_compounds"))
    out = None
    for assay in ("quality", "toxic"):
        known = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
        scored = t.scored_documents().withColumn("label", F.col("toxic") if assay == "toxic" else F.col("label"))
        best = M.optimize_midpoint(scored, ["lang"], "label", "probability").select("lang", "cutoff")
        model = keyed_join(known.groupBy("lang").agg(F.min("n_chars").alias("mn"), F.max("n_chars").alias("mx")), best, ["lang"])

        def score(library, model=model):
            at = (F.col("n_chars") - F.col("mn")) / F.when(F.col("mx") > F.col("mn"), F.col("mx") - F.col("mn"))
            return M.apply_cutoff(attach(library, model, ["lang"]).withColumn("p", F.coalesce(at, F.lit(0.0))), "p", F.col("cutoff"))

        pred, seconds, seen = SC.timed_scores(score, t.documents.select("doc_id", "lang", "n_chars"), ["doc_id", "lang"])
        rep = SC.library_report(pred.withColumn("toxField", F.lit(assay)).withColumn("model", F.lit("length")), ["lang", "toxField", "model"], sizes)
        rep = rep.withColumn("time", F.lit(seconds))
        rep = rep.withColumn("n_predicted", checked(F.col("n_predicted"), F.lit(0 <= seen["predicted"] <= seen["tested"] and seconds > 0), "the scoring pass was not observed"))
        out = rep if out is None else out.unionByName(rep)
    return out.select("lang", "toxField", "model", "tested_compounds", "n_predicted", "dataset_compounds", r6(F.col("hitrate")).alias("hitrate"))


@query("scr_multi_target", """WITH p AS (SELECT doc_id, 'quality' AS assay, CAST(quality AS DOUBLE) AS pred FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels)
SELECT d.doc_id, coalesce(array_to_string(list_sort(list(p.assay) FILTER (WHERE p.pred = 1)), '|'), '') AS active,
  coalesce(array_to_string(list_sort(list(p.assay) FILTER (WHERE p.pred = 0)), '|'), '') AS inactive,
  CASE WHEN count(p.assay) = 0 THEN 'quality|toxic' ELSE '' END AS missing
FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id""")
def q_scr_multi_target(spark, sf):
    t = Tables(spark, sf)
    preds = t.labels.select("doc_id", F.expr("stack(2, 'quality', CAST(quality AS DOUBLE), 'toxic', CAST(toxic AS DOUBLE)) AS (assay, pred)"))
    assays = preds.select("assay").distinct()
    m = SC.multi_target(t.documents.select("doc_id"), assays, preds, "doc_id", "assay", "pred")
    return m.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("active", "inactive", "missing")])


THREE_SQL = """WITH s AS (SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 'training' WHEN d.lang = 'de' THEN 'leaderboard' ELSE 'score' END AS set_name,
  coalesce(CAST(l.toxic AS VARCHAR), 'x') AS toxic_text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, set_name, CAST(CASE toxic_text WHEN 'x' THEN NULL WHEN '1' THEN 1 ELSE 0 END AS DOUBLE) AS toxic FROM s"""


@query("scr_three_sets", THREE_SQL)
def q_scr_three_sets(spark, sf):
    from assayflow.operators.table import concat_by_name

    t = Tables(spark, sf)
    d = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.coalesce(F.col("toxic").cast("string"), F.lit("x")).alias("toxic_text")), "doc_id", "left")
    d = d.withColumn("toxic_text", F.coalesce("toxic_text", F.lit("x")))
    sets = [d.filter(F.col("lang") == "en").withColumn("set_name", F.lit("training")),
            d.filter(F.col("lang") == "de").withColumn("set_name", F.lit("leaderboard")),
            d.filter(~F.col("lang").isin("en", "de")).withColumn("set_name", F.lit("score"))]
    u = concat_by_name(sets)
    lab = F.when(F.col("toxic_text") == "x", F.lit(None).cast("double")).when(F.col("toxic_text") == "1", 1.0).when(F.col("toxic_text") == "0", 0.0).otherwise(
        F.raise_error(F.lit("label must be x, 1 or 0")).cast("double"))
    dup = u.groupBy("doc_id").count().agg(F.max("count")).scalar()
    return u.select(M.checked(F.col("doc_id"), dup <= 1, "sample id in two sets").alias("doc_id"), "set_name", lab.alias("toxic"))
