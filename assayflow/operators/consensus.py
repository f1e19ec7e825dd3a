"""A consensus of classifiers as one estimator and one stored model.

Each sub-model's weight is its ROC AUC from cross-validation.  The worst one is
dropped, the probabilities of the others are added up with their weights, and
the cutoff of the sum is tuned on the out-of-fold sums, so neither weights nor
cutoff have seen the rows they judge.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.operators import cv as CV
from assayflow.operators import metrics as M
from assayflow.operators.models import consensus, probability_of_positive


class ConsensusClassifier(Estimator, HasFeaturesCol, HasLabelCol):
    """Fits named classifiers (estimators with a probability column) on frames that have an id and a fold column."""

    def __init__(self, estimators: dict[str, Estimator], folds: int, idCol: str = "no", foldCol: str = "fold", labelCol: str = "label", metric: str = "f1", dropWorst: bool = True):
        super().__init__()
        self.estimators, self.folds, self.id_col, self.fold_col, self.metric, self.drop_worst = estimators, folds, idCol, foldCol, metric, dropWorst
        self._set(labelCol=labelCol)

    def out_of_fold(self, df: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, float]]:
        """(predictions of every model, their weighted sum per id, weight by model)."""
        from assayflow.session import materialize

        label = self.getLabelCol()
        preds, _ = CV.leaderboard(self.estimators, df, self.folds, "rocAuc", label=label, classification=True, keep=[self.id_col])
        preds = materialize(preds.withColumnRenamed("estimator", "model"))
        w = materialize(M.roc_auc(preds, ["model"], label, "probability").select("model", F.col("roc_auc").alias("weight")))
        weights = {r["model"]: r["weight"] for r in w.collect()}  # one row per model
        summed = consensus(preds, w, self.id_col, "model", drop_worst=self.drop_worst)
        if self.drop_worst:
            weights.pop(min(weights, key=lambda m: (weights[m], m)))
        return preds, summed, weights

    def _fit(self, df: DataFrame) -> ConsensusModel:
        _, summed, weights = self.out_of_fold(df)
        labelled = summed.join(df.select(self.id_col, self.getLabelCol()), self.id_col)
        best = M.optimize_midpoint(labelled, [], self.getLabelCol(), "probability", self.metric).first()
        if best is None:
            raise ValueError("the consensus gives all rows one probability")
        return ConsensusModel([self.estimators[m].fit(df) for m in weights], list(weights), [float(w) for w in weights.values()], float(best["cutoff"]))


class ConsensusModel(Model, MLWritable, MLReadable):
    """Adds ``probability`` (the weighted sum) and ``prediction`` (probability above the tuned cutoff)."""

    def __init__(self, models: list | None = None, names: list[str] | None = None, weights: list[float] | None = None, cutoff: float = 0.5):
        super().__init__()
        self.models, self.names, self.weights, self.cutoff = models or [], names or [], weights or [], cutoff

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.models):
            scored = m.transform(out).withColumn(f"__p{i}", probability_of_positive("probability"))
            out = scored.select(*out.columns, f"__p{i}")
        total = sum((F.lit(w) * F.col(f"__p{i}") for i, w in enumerate(self.weights)), F.lit(0.0))
        return M.apply_cutoff(out.withColumn("probability", total), "probability", self.cutoff).drop(*[f"__p{i}" for i in range(len(self.models))])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ConsensusModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        held = {"names": m.names, "weights": m.weights, "cutoff": m.cutoff}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"held": json.dumps(held)})
        for i, sub in enumerate(m.models):
            sub.write().overwrite().save(f"{path}/models/{i}")


class _Reader(MLReader):
    def load(self, path: str) -> ConsensusModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        held = json.loads(meta["held"])
        models = [DefaultParamsReader.loadParamsInstance(f"{path}/models/{i}", self.sparkSession) for i in range(len(held["names"]))]
        return ConsensusModel(models, held["names"], held["weights"], held["cutoff"])
