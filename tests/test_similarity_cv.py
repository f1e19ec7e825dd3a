"""Survey test kinds: similarity self-test, CV equivalence with MLlib's CrossValidator."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.operators import cv as CV
from assayflow.operators import joins as J
from assayflow.operators import models as MD
from assayflow.operators import similarity as S
from assayflow.operators.features import to_ml_vector, word_split

from .conftest import SF_SMALL


def test_every_item_is_its_own_nearest_neighbour(spark):
    b = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text")
    post = J.postings(b, "item_id", word_split(F.col("text")))
    s = J.nearest_similarity(post, "item_id", post, "item_id").collect()
    assert len(s) == b.count() and all(r["similarity"] == pytest.approx(1.0) for r in s)


def test_cv_metric_equals_crossvalidator(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    d = e.select(F.col("vec_id").alias("no"), to_ml_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))
    d = CV.add_folds(d, ["no"], 3)
    lr = MD.estimator("linear_reg", regParam=0.1)
    pred = CV.cv_predict(lr, d, 3)
    per_fold = [r["value"] for r in CV.fold_metrics(pred, "rmse").filter("foldNo >= 0").orderBy("foldNo").collect()]
    cvm = CrossValidator(estimator=lr, estimatorParamMaps=ParamGridBuilder().build(), evaluator=RegressionEvaluator(metricName="rmse"),
                         foldCol="fold").fit(d)
    assert sum(per_fold) / 3 == pytest.approx(cvm.avgMetrics[0], abs=1e-8)


def test_index_blocks_and_sides_agree(spark, monkeypatch):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang", "text")
    b = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text")
    dp = J.postings(d, "doc_id", word_split(F.col("text")), keep=["lang"])
    bp = J.postings(b, "item_id", word_split(F.col("text")))
    langs = ["de", "en", "es", "fr"]
    fast = {r[0]: r[1] for r in J.nearest_similarity(dp.drop("lang"), "doc_id", bp, "item_id").collect()}
    prof_fast = {r[0]: tuple(r[1:]) for r in J.similarity_profile(bp, "item_id", dp, "doc_id", "lang", langs).collect()}
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 300)
    slow = {r[0]: r[1] for r in J.nearest_similarity(dp.drop("lang"), "doc_id", bp, "item_id").collect()}
    prof_slow = {r[0]: tuple(r[1:]) for r in J.similarity_profile(bp, "item_id", dp, "doc_id", "lang", langs).collect()}
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 20_000)
    found = J.nearest_similarity(bp, "item_id", dp, "doc_id", ds_groups=["lang"]).collect()
    assert fast.keys() == slow.keys() and all(fast[k] == pytest.approx(slow[k]) for k in fast)
    assert prof_fast.keys() == prof_slow.keys() and all(prof_fast[k] == pytest.approx(prof_slow[k]) for k in prof_fast)
    for item, lang, best in found:
        assert best == pytest.approx(prof_fast[item][langs.index(lang)])


def tanimoto(a, b):
    dot = sum(n * b.get(f, 0) for f, n in a.items())
    return dot / (sum(n * n for n in a.values()) + sum(n * n for n in b.values()) - dot)


def bags(seed, n):
    """Vectors with a few common heavy features, many rare ones and some near copies."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bag = Counter({f"c{rng.randint(0, 5)}": rng.randint(1, 4) for _ in range(3)} | {f"r{rng.randint(0, 4000)}": rng.randint(1, 3) for _ in range(25)})
        if i % 4 == 3:
            bag = out[rng.randrange(len(out))].copy()
            bag[f"n{i}"] = 1
        out.append(bag)
    return out


@pytest.mark.parametrize("ids", ["string", "long"])
def test_search_is_exact_for_ids_of_any_type(spark, monkeypatch, ids):
    left, right = bags(1, 60), bags(2, 50) + bags(1, 60)[:20]
    name = (lambda k, i: f"{k}-{i}") if ids == "string" else (lambda k, i: i)
    frame = lambda key, kind, vectors: spark.createDataFrame([(name(kind, i), f"g{i % 3}", f, float(c)) for i, v in enumerate(vectors) for f, c in v.items()], f"{key} {ids}, g string, feature string, count double")
    a, b = frame("a", "left", left), frame("b", "right", right)
    want = {name("left", i): max(tanimoto(x, y) for y in right) for i, x in enumerate(left)}
    per_group = {(name("left", i), g): max(tanimoto(x, y) for j, y in enumerate(right) if f"g{j % 3}" == g) for i, x in enumerate(left) for g in ("g0", "g1", "g2")}
    for block in (200, 1_000_000):
        monkeypatch.setattr(S, "BLOCK_POSTINGS", block)
        got = J.nearest_similarity(a.drop("g"), "a", b.drop("g"), "b")
        assert got.schema["a"].dataType == a.schema["a"].dataType
        assert {r[0]: pytest.approx(r[1]) for r in got.collect()} == want
        wide = J.similarity_profile(a.drop("g"), "a", b, "b", "g", ["g0", "g1", "g2"]).collect()
        assert {(r["a"], g): pytest.approx(r[g]) for r in wide for g in ("g0", "g1", "g2")} == per_group


def test_few_of_the_pairs_that_share_a_feature_are_scored():
    vectors = bags(4, 3000)
    numbers = {f: i for i, f in enumerate(sorted({f for v in vectors for f in v}))}
    item, feature, count = (np.array(x) for x in zip(*[(i, numbers[f], float(c)) for i, v in enumerate(vectors) for f, c in v.items()]))
    index = S.Index(item, feature, count, len(vectors), len(numbers), np.zeros(len(vectors), np.int64), 1)
    sharing, dense = 0, np.zeros(len(numbers))
    for v in vectors[:200]:
        f, c = np.array([numbers[k] for k in v]), np.array([float(x) for x in v.values()])
        best = np.zeros(1)
        items, found = index.winners(f, c, float((c * c).sum()), best, dense, alone=True)
        assert max(best[0], *found) == pytest.approx(1.0)
        sharing += sum(1 for other in vectors if v.keys() & other.keys())
    assert index.scored < sharing / 50


def test_fold_report_has_overall_train_and_test_metrics(spark):
    rows = [(i, float(i % 7), float(i % 7 > 3) if i % 10 else 1.0) for i in range(60)]
    d = spark.createDataFrame(rows, "no long, x double, label double").withColumn("features", to_ml_vector(F.array("x")))
    p = CV.cv_predict(MD.estimator("logistic", maxIter=20), CV.add_folds(d, ["no"], 3), 3, keep=["no"], classification=True, with_train=True)
    raw, got = p.collect(), CV.cv_report(p, "accuracy").collect()
    assert len(raw) == 180 and sorted(r["no"] for r in got) == list(range(60))
    share = lambda xs: sum(r["prediction"] == r["label"] for r in xs) / len(xs)
    for r in got:
        for name, train in (("train_accuracy", True), ("test_accuracy", False)):
            assert r[name] == pytest.approx(share([x for x in raw if x["foldNo"] == r["foldNo"] and x["in_train"] == train]))
        assert r["accuracy"] == pytest.approx(share(got))


def test_mismatches_above_the_limit_fail(spark):
    a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 20).alias("y"))
    assert J.mismatch_rate(a, b, "k", F.col("y") > 0).first()[0] == pytest.approx(0.05)
    with pytest.raises(Exception, match="more than 5% mismatched rows"):
        J.mismatch_rate(a, b, "k", F.col("y") > 1).collect()


def test_queries_run_the_whole_job(spark):
    import __spark_entry__ as E

    got = E.queries()["ml_score_features"](spark, SF_SMALL)
    assert got.columns == ["doc_id", "prediction", "probability"] and got.filter("prediction <> cast(probability > 0.5 as double)").count() == 0
    assert got.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert {"accuracy", "train_accuracy", "test_accuracy", "foldNo"} <= set(E.queries()["cv_predict"](spark, SF_SMALL).columns)
