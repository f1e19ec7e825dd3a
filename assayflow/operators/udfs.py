"""§2.18 the row / column / predicate / aggregate / table-function surface.

Expressions first: a caller passes Column expressions (predicates, derived
columns, metrics over confusion counts).  A Python table function runs as
``applyInPandas`` on a keyed frame (one group per task, group size bounded
by the caller's key), never as a driver loop.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.functions import scalar as S


def with_column_from(df: DataFrame, name: str, fn: Callable[[Column], Column], source: str) -> DataFrame:
    """Column from another column by a Column function."""
    return df.withColumn(name, fn(F.col(source)))


def filter_by(df: DataFrame, predicate: Column) -> DataFrame:
    """Caller's row predicate; null counts as false."""
    return df.filter(F.coalesce(predicate, F.lit(False)))


def pair_accumulator(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Mergeable two-column accumulator (sum of squared differences, count) -> rmse; Spark merges partials."""
    d = F.col(a) - F.col(b)
    g = df.groupBy(*by).agg(F.sum(d * d).alias("ssd"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("rmse", F.sqrt(F.col("ssd") / F.col("n")))


def row_pair(df: DataFrame, features: str, out: str, weights: Sequence[float], intercept: float, cutoff: float = 0.5) -> DataFrame:
    """Row transformer array -> (prediction, probability) of a logistic model, as a Column expression."""
    margin = S.dot(F.col(features), F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(intercept))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    return df.withColumn(out, F.struct((p > cutoff).cast("double").alias("prediction"), p.alias("probability")))


def row_vector(df: DataFrame, features: str, out: str, centre: Sequence[float], scale: Sequence[float]) -> DataFrame:
    """Row transformer array -> array: centred and scaled position by position (a constant position becomes 0)."""
    parts = F.arrays_zip(F.col(features).alias("x"), F.array(*[F.lit(float(c)) for c in centre]).alias("c"), F.array(*[F.lit(float(s)) for s in scale]).alias("s"))
    return df.withColumn(out, F.transform(parts, lambda p: F.when(p["s"] == 0, F.lit(0.0)).otherwise((p["x"] - p["c"]) / F.when(p["s"] != 0, p["s"]))))


def metric_over_counts(counts: DataFrame, metric: Column, name: str = "metric") -> DataFrame:
    """Caller's metric as a Column expression over tp, fp, tn, fn."""
    return counts.withColumn(name, metric)


def per_chunk_table(df: DataFrame, key: Sequence[str], order: Sequence[str], size: int,
                    fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A table -> table Python function applied to consecutive chunks of at most ``size`` rows per key
    (positions from the range-partitioned numbering), so no task ever holds a whole hot group."""
    from assayflow.operators.ordered import add_position

    numbered = add_position(df, list(order), list(key), "__pos")
    chunks = numbered.withColumn("__chunk", F.floor(F.col("__pos") / F.lit(size)).cast("long")).drop("__pos")
    return chunks.groupBy(*key, "__chunk").applyInPandas(fn, schema)


def zscore_table(pdf: pd.DataFrame) -> pd.DataFrame:
    """Example table function: population z-score of ``value`` from the group's ``mean`` and ``sd`` columns."""
    out = pdf[["key", "system"]].copy()
    sd = pdf["sd"].astype(float)
    z = (pdf["value"].astype(float) - pdf["mean"].astype(float)) / sd.where(sd > 0)
    out["z"] = z.fillna(0.0).round(6)
    return out
