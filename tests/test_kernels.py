"""Kernel machines: whitened maps against the kernel itself, epsilon in label units, error below the linear model, Gram sums."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from assayflow.operators import kernels as K
from assayflow.operators import models as MD


def curve(spark, n=400, scale=1.0, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    y = scale * (np.sin(3 * x[:, 0]) * x[:, 1] + 0.02 * rng.normal(size=n))
    return spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "no long, a array<double>, label double")


def rmse(pred):
    return pred.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]


@pytest.mark.parametrize("kind, extra", [("linear", {}), ("polynomial", {"coef0": 1.0, "degree": 2}), ("rbf", {}), ("tanimoto", {"degree": 1})])
def test_inner_products_of_the_map_are_kernel_values_at_landmarks(kind, extra):
    marks = np.abs(np.random.default_rng(1).normal(size=(12, 12 if kind == "linear" else 3))) + 0.1
    mapped = K.WhitenedKernelMap(landmarks=marks.tolist(), kernel=kind, gamma=0.5, **extra).values()(marks)
    assert np.allclose(mapped @ mapped.T, K.kernel_matrix(kind, marks, marks, 0.5, **extra), atol=1e-4)


@pytest.mark.parametrize("kind, extra", [("rbf", {"gamma": 2.0}), ("polynomial", {"gamma": 1.0, "coef0": 1.0, "degree": 4}), ("sigmoid", {"gamma": 1.0, "coef0": 0.3}), ("tanimoto", {"degree": 2})])
def test_error_below_the_linear_model(spark, kind, extra):
    d = curve(spark)
    marks = MD.sample_landmarks(d, "a", m=40)
    fitted = MD.kernel_svm(kind, marks, "a", regression=True, epsilon=0.02, **extra).fit(d)
    linear = K.EpsilonRegression(inputCol="a", epsilon=0.02).fit(d).transform(d)
    assert rmse(fitted.transform(d)) < (0.35 if kind in ("rbf", "polynomial") else 0.95) * rmse(linear)


def test_epsilon_is_in_label_units(spark):
    d = curve(spark, scale=100.0)
    wide = K.EpsilonRegression(inputCol="a", epsilon=1000.0).fit(d)
    assert max(map(abs, wide.getOrDefault(wide.weights))) < 1e-6  # every label lies in the tube of a constant
    marks = MD.sample_landmarks(d, "a", m=40)
    for eps in (2.0, 20.0):
        p = MD.kernel_svm("rbf", marks, "a", regression=True, gamma=2.0, epsilon=eps, reg=1e-6, max_iter=150).fit(d).transform(d)
        beyond = p.agg(F.avg((F.abs(F.col("label") - F.col("prediction")) > eps * 1.1 + 0.5).cast("double"))).first()[0]
        assert beyond < 0.3  # the noise alone passes the narrow tube at one row in six
    assert rmse(p) > 3.0  # a wide tube leaves errors that a narrow one does not


def test_kernel_pipeline_is_stored_and_nulls_stay_null(spark, tmp_path):
    d = curve(spark, 60)
    model = MD.kernel_svm("rbf", MD.sample_landmarks(d, "a", m=8), "a", regression=True, gamma=2.0).fit(d)
    model.write().overwrite().save(str(tmp_path / "m"))
    more = d.unionByName(spark.createDataFrame([(99, None, 1.0)], d.schema))
    a = {r["no"]: r["prediction"] for r in model.transform(more).collect()}
    b = {r["no"]: r["prediction"] for r in PipelineModel.load(str(tmp_path / "m")).transform(more).collect()}
    assert a == b and a[99] is None and None not in [v for k, v in a.items() if k != 99]


def test_gram_sums_and_projection(spark):
    x = np.random.default_rng(2).normal(size=(200, 6))
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "no long, a array<double>").repartition(5)
    sums, width = K.gramian(d, "a")
    assert width == 6 and all(r["value"] == pytest.approx((x.T @ x)[r["i"], r["j"]]) for r in sums.collect()) and sums.count() == 21
    got = np.array([r["svd"] for r in K.svd_project(d, "no", "a", k=3).orderBy("no").collect()])
    v = np.linalg.svd(x, full_matrices=False)[2][:3]
    assert np.allclose(np.abs(got), np.abs(x @ v.T), atol=1e-8)
