"""§2.14 cross-validation, tuning and leaderboards on MLlib.

Folds are a column of one cached, keyed frame (round-robin by position, or
a seeded hash); each fold fit is an MLlib (distributed) fit on a filter of
that frame.  The loops run over folds, grid points and estimators --
model-sized counts -- never over data rows.  Predictions of all folds and
estimators form one long DataFrame that is scored with grouped metrics.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.operators import metrics as M
from assayflow.operators.evaluators import evaluate, is_larger_better
from assayflow.operators.models import probability_of_positive
from assayflow.operators.ordered import add_position
from assayflow.operators.table import cv_fold, hash_fold
from assayflow.session import materialize


def add_folds(df: DataFrame, key: Sequence[str], k: int, method: str = "round_robin", seed: int = 1234, name: str = "fold") -> DataFrame:
    """Round-robin folds (position mod k over the key order) or seeded hash folds."""
    if method == "round_robin":
        return add_position(df, list(key), (), "__pos").withColumn(name, cv_fold(F.col("__pos"), k)).drop("__pos")
    return df.withColumn(name, hash_fold(key, k, seed))


def _score_cols(pred: DataFrame, classification: bool) -> DataFrame:
    if classification and "probability" in pred.columns and dict(pred.dtypes)["probability"] != "double":
        return pred.withColumn("probability", probability_of_positive("probability"))
    return pred


def cv_predict(est: Estimator, df: DataFrame, k: int, fold: str = "fold", label: str = "label", keep: Sequence[str] = (),
               classification: bool = False, parallelism: int = 4, with_train: bool = False, ready: bool = False) -> DataFrame:
    """Out-of-fold predictions (``foldNo`` added) for one estimator; ``with_train`` adds each fold's predictions of its own
    training rows, marked by the column ``in_train``.

    Fold fits are submitted concurrently (like ``CrossValidator(parallelism=...)``);
    each is a distributed MLlib fit on a filter of one frame, which is materialized
    unless it is ``ready``.  A fold whose training labels are all equal fails (checked before the fit).
    """
    from concurrent.futures import ThreadPoolExecutor

    df = df if ready else materialize(df)

    def run(f: int) -> DataFrame:
        train = df.filter(F.col(fold) != f)
        n_labels = train.agg(F.countDistinct(label)).first()[0]
        if n_labels < 2:
            raise ValueError(f"fold {f}: all training labels are equal")
        model = est.fit(train)
        p = model.transform(df.withColumn("in_train", F.col(fold) != f) if with_train else df.filter(F.col(fold) == f))
        cols = [*keep, label, "prediction"] + (["in_train"] if with_train else []) + (["probability"] if classification and "probability" in p.columns else [])
        return _score_cols(p.select(*cols), classification).withColumn("foldNo", F.lit(f))

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
        parts = list(pool.map(run, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_metrics(pred: DataFrame, metric: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Overall and per-fold metric: rows (by..., foldNo [-1 = all], value)."""
    per = evaluate(pred, metric, label, "prediction", "probability", [*by, "foldNo"]).select(*by, "foldNo", "value")
    allf = evaluate(pred, metric, label, "prediction", "probability", list(by)).select(*by, F.lit(-1).alias("foldNo"), "value")
    return per.unionByName(allf)


def cv_report(pred: DataFrame, metric: str, label: str = "label") -> DataFrame:
    """Out-of-fold predictions with the overall metric and the train and test metric of each row's fold, from predictions
    made ``with_train``."""
    test = pred.filter("not in_train").drop("in_train")
    parts = evaluate(pred, metric, label, "prediction", "probability", ["foldNo", "in_train"])
    folds = parts.groupBy(F.col("foldNo").alias("__fold")).agg(
        F.max(F.when(F.col("in_train"), F.col("value"))).alias(f"train_{metric}"), F.max(F.when(~F.col("in_train"), F.col("value"))).alias(f"test_{metric}"))
    overall = evaluate(test, metric, label, "prediction", "probability").select("value").scalar()
    return test.join(F.broadcast(folds), F.col("foldNo") == F.col("__fold")).drop("__fold").withColumn(metric, overall)  # a row a fold


def param_grid(spec: dict[str, Sequence]) -> list[dict]:
    """Cartesian parameter grid (name -> values) in declaration order."""
    names = list(spec)
    return [dict(zip(names, vals)) for vals in itertools.product(*[spec[n] for n in names])]


def optimize(spark: SparkSession, make: Callable[[dict], Estimator], grid: list[dict], df: DataFrame, k: int, metric: str,
             label: str = "label", classification: bool = False, name: str = "NAME", method: str = "METHOD") -> DataFrame:
    """Every grid point x every fold; results table NAME, METHOD, params..., metric, metric_1..k (grid-sized)."""
    rows = []
    df = materialize(df)
    for params in grid:
        pred = cv_predict(make(params), df, k, label=label, classification=classification, ready=True)
        fm = {r["foldNo"]: r["value"] for r in fold_metrics(pred, metric, label).collect()}  # k+1 numbers
        rows.append((name, method, *[params[p] for p in params], fm[-1], *[fm[f] for f in range(k)]))
    cols = ["NAME", "METHOD", *grid[0].keys(), metric, *[f"{metric}_{f + 1}" for f in range(k)]]
    return spark.createDataFrame(rows, cols)


def best_params(results: DataFrame, params: Sequence[str], metric: str) -> dict:
    """Best grid row of a stored tuning table (direction from the metric)."""
    key = F.col(metric) if is_larger_better(metric) else -F.col(metric)
    row = results.agg(F.max_by(F.struct(*params), key).alias("b")).first()["b"]
    return row.asDict()


def apply_best(results: DataFrame, params: Sequence[str], metric: str, make: Callable[[dict], Estimator], df: DataFrame) -> tuple[DataFrame, dict]:
    """Best row of a stored tuning table -> estimator with those parameters -> fitted on and applied to ``df``; and the parameters."""
    best = best_params(results, params, metric)
    return make(best).fit(df).transform(df), best


def tune_system(spark: SparkSession, df: DataFrame, system: str, mapping: dict[str, str], key: Sequence[str], make: Callable[[dict], Estimator],
                grid: list[dict], k: int, metric: str, path: str, method: str, classification: bool = False, seed: int = 1234) -> None:
    """Tune one system: columns mapped to their standard names, rows with nulls left out, the rest shuffled by seed and
    dealt into folds by position; the results are appended to ``path`` once, and a system that is there already is skipped."""
    from assayflow.operators.table import model_input, shuffle_rows
    from assayflow.sources import tables as IO

    if not IO.skip_done(spark, spark.createDataFrame([(system,)], "NAME string"), path).count():
        return
    rows = shuffle_rows(model_input(df, mapping), key, seed)
    folded = rows.withColumn("fold", cv_fold(F.col("pos"), k)).drop("pos")
    IO.append_once(spark, optimize(spark, make, grid, folded, k, metric, classification=classification, name=system, method=method), path)


def leaderboard(estimators: dict[str, Estimator], df: DataFrame, k: int, metric: str, label: str = "label",
                classification: bool = False, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Cross-validate several estimators; returns (long predictions with ``estimator``, ranked metrics)."""
    from concurrent.futures import ThreadPoolExecutor

    def run(item):
        name, est = item
        return cv_predict(est, df, k, label=label, classification=classification, keep=keep, ready=True).withColumn("estimator", F.lit(name))

    df = materialize(df)
    with ThreadPoolExecutor(max_workers=max(1, min(4, len(estimators)))) as pool:
        parts = list(pool.map(run, estimators.items()))
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p, allowMissingColumns=True)  # not every estimator has probabilities
    preds = materialize(preds)  # a model scores each row once, however many metrics are read from it
    m = evaluate(preds, metric, label, "prediction", "probability", ["estimator"])
    from pyspark.sql import Window

    order = F.col("value").desc() if is_larger_better(metric) else F.col("value").asc()
    ranked = m.withColumn("rank", F.rank().over(Window.orderBy(order)))  # one row per estimator: bounded
    return preds, ranked


def regression_leaderboard_metrics(preds: DataFrame, label: str = "label") -> DataFrame:
    """Regression leaderboard: rmse, mae, Pearson and Spearman per estimator, ranked by correlation (rank 1: the highest)."""
    from pyspark.sql import Window

    m = M.regression_metrics(preds, ["estimator"], label, "prediction")
    s = M.spearman(preds, ["estimator"], label, "prediction")
    best_first = Window.orderBy(F.col("pearson").desc_nulls_last(), "estimator")  # one row per estimator: bounded
    return m.join(s, "estimator").withColumn("rank", F.row_number().over(best_first))
