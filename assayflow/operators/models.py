"""§2.13 models, ensembles and persistence on MLlib.

Estimators are MLlib's own (distributed training); kernel machines are in
``kernels``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.functions import scalar as S
from assayflow.operators.ordered import attach
from assayflow.operators.kernels import as_array, kernel_svm, svd_project  # noqa: F401


# --------------------------------------------------------------- estimators

def estimator(name: str, features: str = "features", label: str = "label", **params):
    """MLlib estimator by workbench name."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    common = dict(featuresCol=features, labelCol=label)
    table = {
        "rf_class": lambda: C.RandomForestClassifier(seed=1234, **common),
        "rf_reg": lambda: R.RandomForestRegressor(seed=1234, **common),
        "gbt_reg": lambda: R.GBTRegressor(seed=1234, **common),
        "dt_class": lambda: C.DecisionTreeClassifier(seed=1234, **common),
        "dt_reg": lambda: R.DecisionTreeRegressor(seed=1234, **common),
        "nb_bernoulli": lambda: C.NaiveBayes(modelType="bernoulli", **common),
        "nb_multinomial": lambda: C.NaiveBayes(modelType="multinomial", **common),
        "linear_svc": lambda: C.LinearSVC(**common),
        "linear_svr": lambda: R.LinearRegression(loss="huber", **common),
        "logistic": lambda: C.LogisticRegression(**common),
        "linear_reg": lambda: R.LinearRegression(**common),
        "glr_gaussian": lambda: R.GeneralizedLinearRegression(family="gaussian", **common),
        "glr_gamma": lambda: R.GeneralizedLinearRegression(family="gamma", link="log", **common),
        "mlp": lambda: C.MultilayerPerceptronClassifier(seed=1234, **common),
    }
    if name not in table:
        raise ValueError(f"Unknown estimator {name}")
    est = table[name]()
    if params:
        est = est.setParams(**params) if hasattr(est, "setParams") else est
    return est


def svm_epsilon(label_scale: float) -> float:
    """Default SVR epsilon: min(0.1, mean |label| / 20)."""
    return min(0.1, label_scale / 20.0)


# ------------------------------------------------------------ kernel map

class KernelMap(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Kernel values of each row's array against a fixed landmark set (linear, polynomial, rbf, sigmoid, tanimoto).

    Landmarks are a bounded sample (``sample_landmarks``) stored as a param,
    so the map is a pure Column expression -- no UDF, no driver data at
    transform time -- and persists with the pipeline.
    """

    landmarks = Param(Params._dummy(), "landmarks", "landmark vectors", typeConverter=TypeConverters.toListListFloat)
    kernel = Param(Params._dummy(), "kernel", "kernel name", typeConverter=TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel gamma", typeConverter=TypeConverters.toFloat)
    coef0 = Param(Params._dummy(), "coef0", "kernel offset", typeConverter=TypeConverters.toFloat)
    degree = Param(Params._dummy(), "degree", "kernel degree", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="a", outputCol="kernel_features", landmarks=None, kernel="rbf", gamma=1.0, coef0=0.0, degree=3):
        super().__init__()
        self._setDefault(kernel="rbf", gamma=1.0, coef0=0.0, degree=3, landmarks=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        x = F.col(self.getInputCol()).cast("array<double>")
        lms = self.getOrDefault(self.landmarks)
        vals = [S.kernel(self.getOrDefault(self.kernel), x, F.array(*[F.lit(float(v)) for v in lm]),
                         self.getOrDefault(self.gamma), self.getOrDefault(self.coef0), self.getOrDefault(self.degree)) for lm in lms]
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(*vals)))


def sample_landmarks(df: DataFrame, col: str, m: int = 50, seed: int = 1234) -> list[list[float]]:
    """A bounded landmark sample (m rows, chosen by a seeded hash order -- a top-m, not a scan of the data to the driver)."""
    rows = df.select(F.col(col).cast("array<double>").alias("a"), F.xxhash64(F.lit(seed), F.col(col).cast("string")).alias("h")).orderBy("h").limit(m).collect()
    return [list(r["a"]) for r in rows]


# ------------------------------------------------------------ ensembles

def majority_vote(preds: DataFrame, id_col: str, pred: str = "prediction", tie_positive: bool = True) -> DataFrame:
    """Majority of 0/1 predictions per id; ``tie_positive`` decides ties."""
    g = preds.groupBy(id_col).agg(F.sum(pred).alias("__s"), F.count(pred).alias("__n"))
    half = F.col("__n") / 2.0
    vote = F.when(F.col("__s") > half, 1.0).when(F.col("__s") < half, 0.0).otherwise(F.lit(1.0 if tie_positive else 0.0))
    return g.select(id_col, vote.alias("prediction"))


def consensus(probs: DataFrame, weights: DataFrame, id_col: str, model: str, prob: str = "probability", weight: str = "weight",
              drop_worst: bool = True) -> DataFrame:
    """Weighted sum (not mean) of model probabilities; weights are CV metrics; the worst model is dropped."""
    w = weights
    if drop_worst:
        worst = weights.agg(F.min_by(model, F.struct(weight, model)).alias("m")).scalar()
        w = weights.filter(F.col(model) != worst)
    j = attach(probs, w.select(model, weight), [model])
    return j.groupBy(id_col).agg(F.sum(F.col(prob) * F.col(weight)).alias("probability"))


def probability_of_positive(col: str = "probability") -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(col))[1]


class LinearRowModel(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Row transformer ``features -> w.x + b`` written as a Column expression (no per-row Python)."""

    weights = Param(Params._dummy(), "weights", "coefficients", typeConverter=TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol="a", outputCol="value", weights=None, intercept=0.0):
        super().__init__()
        self._setDefault(weights=[], intercept=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(float(x)) for x in self.getOrDefault(self.weights)])
        x = as_array(df, self.getInputCol())
        return df.withColumn(self.getOutputCol(), S.dot(x, w) + F.lit(self.getOrDefault(self.intercept)))
