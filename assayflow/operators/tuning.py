"""Tuning-result analysis: global best, common best, deltas, complete methods, generalization.

All of these read a results table (one row per system x parameter
combination) and are grouped aggregates and joins -- no driver loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.operators.summaries import arg_best


def quality_filter(df: DataFrame, min_percent: float = 5.0, min_positives: int = 10, min_f1: float = 0.5, strict_f1: bool = True) -> DataFrame:
    """Keep rows with percent >= 5, positives >= 10 and f1 > 0.5 (``strict_f1=False``: f1 >= 0.5)."""
    f1c = F.col("f1") > min_f1 if strict_f1 else F.col("f1") >= min_f1
    return df.filter((F.col("percent") >= min_percent) & (F.col("positives") >= min_positives) & f1c)


def global_best(results: DataFrame, name: str, metric: str, larger_is_better: bool) -> DataFrame:
    """Best metric per system over all parameter combinations."""
    agg = F.max(metric) if larger_is_better else F.min(metric)
    return results.groupBy(name).agg(agg.alias("global"))


def common_best(results: DataFrame, name: str, params: Sequence[str], metric: str, larger_is_better: bool) -> DataFrame:
    """The one parameter combination whose per-system metric is closest (RMS) to the per-system best.

    Output: params..., rms_to_best, mean_metric (one row).
    """
    g = global_best(results, name, metric, larger_is_better)
    j = results.join(g, name)
    d = F.col(metric) - F.col("global")
    per = j.groupBy(*params).agg(F.sqrt(F.avg(d * d)).alias("rms_to_best"), F.avg(metric).alias("mean_metric"))
    best = per.agg(F.min_by(F.struct(*params, "rms_to_best", "mean_metric"), F.struct("rms_to_best", *params)).alias("b"))
    return best.select("b.*")


def common_best_by(results: DataFrame, by: Sequence[str], name: str, params: Sequence[str], metric: str, larger_is_better: bool) -> DataFrame:
    """``common_best`` separately for each feature type (or other grouping)."""
    agg = F.max(metric) if larger_is_better else F.min(metric)
    g = results.groupBy(*by, name).agg(agg.alias("global"))
    j = results.join(g, [*by, name])
    d = F.col(metric) - F.col("global")
    per = j.groupBy(*by, *params).agg(F.sqrt(F.avg(d * d)).alias("rms_to_best"), F.avg(metric).alias("mean_metric"))
    best = per.groupBy(*by).agg(F.min_by(F.struct(*params, "rms_to_best", "mean_metric"), F.struct("rms_to_best", *params)).alias("b"))
    return best.select(*by, "b.*")


def delta_table(results: DataFrame, name: str, params: Sequence[str], metric: str, larger_is_better: bool) -> DataFrame:
    """name, global, common, delta (= common - global; sign flipped when larger is better)."""
    g = global_best(results, name, metric, larger_is_better)
    cb = common_best(results, name, params, metric, larger_is_better).select(*params)
    common = results.join(cb, list(params)).select(name, F.col(metric).alias("common"))
    out = g.join(common, name)
    delta = F.col("global") - F.col("common") if larger_is_better else F.col("common") - F.col("global")
    return out.select(name, "global", "common", delta.alias("delta"))


def category_table(delta: DataFrame, name: str) -> DataFrame:
    """Stack global and common values with a ``cat`` column."""
    return delta.select(name, F.lit("global").alias("cat"), F.col("global").alias("value")).unionByName(
        delta.select(name, F.lit("common").alias("cat"), F.col("common").alias("value"))
    )


def complete_methods(summary: DataFrame, method: str, name: str, metric: str) -> DataFrame:
    """Methods covering the maximal number of systems, with their mean metric."""
    cov = summary.groupBy(method).agg(F.countDistinct(name).alias("n_systems"), F.avg(metric).alias("mean_metric"))
    top = cov.agg(F.max("n_systems").alias("m")).scalar()
    return cov.filter(F.col("n_systems") == top)


def best_params_list(results: DataFrame, params: Sequence[str]) -> DataFrame:
    """Distinct values per parameter, long form (parameter, value) -- grid-sized."""
    parts = [results.select(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")).distinct() for p in params]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def generalization(train: DataFrame, score: DataFrame, name: str, method: str, metric: str, larger_is_better: bool) -> DataFrame:
    """Best-on-training method joined to its score result and to the best-on-score method, with delta."""
    bt = arg_best(train.select(name, method, metric), [name], metric, larger_is_better).select(name, F.col(method).alias("train_method"))
    bs = arg_best(score.select(name, method, metric), [name], metric, larger_is_better).select(
        name, F.col(method).alias("score_method"), F.col(metric).alias("best_score")
    )
    sc = score.select(name, F.col(method).alias("train_method"), F.col(metric).alias("train_method_score"))
    j = bt.join(sc, [name, "train_method"]).join(bs, name)
    d = F.col("best_score") - F.col("train_method_score") if larger_is_better else F.col("train_method_score") - F.col("best_score")
    return j.withColumn("delta", d)
