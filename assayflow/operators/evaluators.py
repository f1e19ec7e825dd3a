"""Named-metric evaluation (``evaluate(df, "rmse")``) and MLlib-compatible evaluators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.operators import metrics as M

REGRESSION = {"rmse": False, "mae": False}
CLASSIFICATION = {"accuracy": True, "precision": True, "recall": True, "f1": True, "rocAuc": True}


def is_larger_better(metric: str) -> bool:
    if metric in REGRESSION:
        return REGRESSION[metric]
    if metric in CLASSIFICATION:
        return CLASSIFICATION[metric]
    raise ValueError(f"Unknown evaluation metric {metric}")


def evaluate(
    df: DataFrame, metric: str, label: str = "label", pred: str = "prediction", prob: str = "probability", by: Sequence[str] = ()
) -> DataFrame:
    """One row per group: (by..., metric, value).  Unknown metric names are an error."""
    by = list(by)
    if metric in ("rmse", "mae"):
        v = M.regression_metrics(df, by, label, pred).select(*by, F.col(metric).alias("value"))
    elif metric == "accuracy":
        v = M.accuracy(df, by, label, pred).select(*by, F.col("accuracy").alias("value"))
    elif metric in ("precision", "recall", "f1"):
        c = M.confusion(df, by, label, pred)
        v = c.select(*by, M.metric_expr(metric).alias("value"))
    elif metric == "rocAuc":
        v = M.roc_auc(df, by, label, prob).select(*by, F.col("roc_auc").alias("value"))
    else:
        raise ValueError(f"Unknown evaluation metric {metric}")
    return v.select(*by, F.lit(metric).alias("metric"), "value")


class GroupMetricEvaluator(Evaluator):
    """MLlib ``Evaluator`` over the named metrics above (usable in ``CrossValidator``)."""

    def __init__(self, metric: str = "rmse", labelCol: str = "label", predictionCol: str = "prediction", probabilityCol: str = "probability"):
        super().__init__()
        self.metric, self.labelCol, self.predictionCol, self.probabilityCol = metric, labelCol, predictionCol, probabilityCol

    def _evaluate(self, dataset: DataFrame) -> float:
        prob = self.probabilityCol
        ds = dataset
        if self.metric == "rocAuc" and dict(dataset.dtypes).get(prob, "double") != "double":
            from pyspark.ml.functions import vector_to_array

            ds = dataset.withColumn("__p1", vector_to_array(F.col(prob))[1])
            prob = "__p1"
        row = evaluate(ds, self.metric, self.labelCol, self.predictionCol, prob).first()
        return float(row["value"])

    def isLargerBetter(self) -> bool:
        return is_larger_better(self.metric)
