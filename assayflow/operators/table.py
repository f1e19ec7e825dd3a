"""Core table verbs (§2.3-2.5, §2.9): projections, filters, positions, folds, sorts and set operations.

Rows have no implicit position in a DataFrame; every positional verb takes
an explicit total order and numbers rows with the range-partitioned
``add_position`` (balanced, never one partition).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.operators.metrics import checked
from assayflow.operators.ordered import Down, OrderSpec, add_position, keyed_join


# ------------------------------------------------------------- projections

def _require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"unknown columns {missing}; have {df.columns}")


def select(df: DataFrame, *names: str) -> DataFrame:
    _require(df, names)
    return df.select(*names)


def select_as(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    _require(df, [o for o, _ in pairs])
    return df.select(*[F.col(o).alias(n) for o, n in pairs])


def rename(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    _require(df, [o for o, _ in pairs])
    return df.withColumnsRenamed(dict(pairs))


def remove_columns(df: DataFrame, *names: str) -> DataFrame:
    """Unknown names are ignored."""
    return df.drop(*names)


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name} already exists")
    return df.withColumn(name, value)


def add_constant(df: DataFrame, name: str, value) -> DataFrame:
    return add_column(df, name, F.lit(value))


def column_at(df: DataFrame, i: int) -> str:
    return df.columns[i]


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def row_map(df: DataFrame, cols: Sequence[str] | None = None, name: str = "row") -> DataFrame:
    """Each row as a JSON object title -> value."""
    cols = list(cols or df.columns)
    return df.select(F.to_json(F.struct(*cols)).alias(name))


# ----------------------------------------------------------------- filters

def filter_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def filter_pred(df: DataFrame, pred: Column) -> DataFrame:
    """Keep rows where the predicate holds; null counts as false."""
    return df.filter(F.coalesce(pred, F.lit(False)))


def filter_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def with_position(df: DataFrame, order: Sequence[OrderSpec], name: str = "pos", by: Sequence[str] = ()) -> DataFrame:
    return add_position(df, order, by, name)


def gather(df: DataFrame, pos_col: str, positions: DataFrame, ord_col: str, at_col: str) -> DataFrame:
    """Rows at the given positions, duplicates allowed; ``ord_col`` keeps the requested order."""
    p = positions.select(F.col(ord_col), F.col(at_col).alias(pos_col))
    return p.join(df, pos_col, "inner")


def remove_positions(df: DataFrame, pos_col: str, positions: DataFrame, at_col: str) -> DataFrame:
    return df.join(positions.select(F.col(at_col).alias(pos_col)).distinct(), pos_col, "left_anti")


def slice_rows(df: DataFrame, pos_col: str, start: Column | int, end: Column | int) -> DataFrame:
    return df.filter((F.col(pos_col) >= start) & (F.col(pos_col) < end))


def null_positions(df: DataFrame, pos_col: str, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull()).select(pos_col)


def require_no_nulls(df: DataFrame, col: str) -> DataFrame:
    """The table itself, failing the job if ``col`` holds a null (check kept by the dependency)."""
    n = df.agg(F.count_if(F.col(col).isNull()).alias("n")).scalar()
    return df.withColumn(col, checked(F.col(col), n == 0, f"column {col} has null values"))


def estimator_input(df: DataFrame, key: str, label: str, features: str) -> DataFrame:
    return df.select(key, label, features).filter(F.col(label).isNotNull() & F.col(features).isNotNull())


def model_input(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Standard modelling projection: rename the source columns, drop rows with nulls."""
    _require(df, list(mapping))
    return df.select(*[F.col(o).alias(n) for o, n in mapping.items()]).na.drop("any")


def split_by_pred(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(inactive, active) by a 0/1 column; both values required and no nulls (checked in the plan)."""
    st = df.agg(
        F.count_if(F.col(col) == 0).alias("z"), F.count_if(F.col(col) == 1).alias("o"), F.count_if(~F.col(col).isin(0, 1) | F.col(col).isNull()).alias("b")
    )
    ok = st.select(((F.col("z") > 0) & (F.col("o") > 0) & (F.col("b") == 0)).alias("ok")).scalar()
    guarded = df.withColumn(col, checked(F.col(col), ok, f"{col} must hold both 0 and 1 and no nulls"))
    return guarded.filter(F.col(col) == 0), guarded.filter(F.col(col) == 1)


def active_only(df: DataFrame, pred: str = "prediction") -> DataFrame:
    return df.filter(F.col(pred) == 1.0)


def filter_dataset_protocol(df: DataFrame, dataset_col: str, protocol_col: str, dataset=None, protocol=None) -> DataFrame:
    """Optional dataset and protocol ids; unset means all."""
    cond = F.lit(True)
    if dataset is not None:
        cond = cond & (F.col(dataset_col) == dataset)
    if protocol is not None:
        cond = cond & (F.col(protocol_col) == protocol)
    return df.filter(cond)


# ------------------------------------------------------------------- sorts

def sort_default(df: DataFrame, col: str, tie: Sequence[str], pos: str = "pos") -> DataFrame:
    """Descending, nulls last (the workbench default); ``pos`` is the 0-based sorted position."""
    return add_position(df, [Down(col), *tie], (), pos)


def sort_reverse(df: DataFrame, col: str, tie: Sequence[str], pos: str = "pos") -> DataFrame:
    """Ascending with nulls first; ties in reversed input order."""
    return add_position(df, [col, *map(Down, tie)], (), pos)


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = 1234, pos: str = "pos") -> DataFrame:
    """Seeded shuffle: order by md5(seed:key...) -- reproducible across partitionings and engines, unlike rand()."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return add_position(df.withColumn("__h", h), ["__h", *key], (), pos).drop("__h")


# ------------------------------------------------------------ set operations

def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """UNION ALL by position; column titles and types must agree."""
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise ValueError(f"schemas differ: {a.schema.simpleString()} vs {b.schema.simpleString()}")
    return a.union(b)


def append_many(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(append, frames)


def concat_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).filter(F.col(col).isNotNull()).distinct()


def map_intersect(long: DataFrame, group: Sequence[str], member: Sequence[str], key: str, value: str) -> DataFrame:
    """Key/value pairs present in every map (member) of a group, long form (group..., key, value)."""
    sizes = long.select(*group, *member).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("__gs"))
    kv = long.select(*group, *member, key, value).distinct().groupBy(*group, key, value).agg(F.count(F.lit(1)).alias("__c"))
    j = keyed_join(kv, sizes, group)
    return j.filter(F.col("__c") == F.col("__gs")).select(*group, key, value)


# ----------------------------------------------------- folds and partitions

def cv_fold(pos: Column, k: int) -> Column:
    """Round-robin fold: position mod k."""
    return F.pmod(pos, F.lit(k)).cast("int")


def hash_fold(key: Sequence[str], k: int, seed: int = 1234) -> Column:
    """Fold from a hash of the key -- needs no numbering pass."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in key]), F.lit(k)).cast("int")


def holdout_part(pos: Column, n: Column, p: float) -> Column:
    """'test' for the first int(n*p + 0.5) rows, 'train' after."""
    return F.when(pos < F.floor(n * F.lit(p) + F.lit(0.5)), F.lit("test")).otherwise(F.lit("train"))


def chunk_id(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)).cast("long")
