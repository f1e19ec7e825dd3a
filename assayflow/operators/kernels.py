"""Kernel machines as a landmark map followed by a linear fit.

The workbench solves kernel SVMs on one machine.  Here a bounded landmark
sample spans the feature space: a row's kernel values to the landmarks, times
the inverse square root of the landmarks' own kernel matrix, are coordinates
whose inner products approximate the kernel.  Linear solvers then see all rows:
MLlib's linear SVC for classes, and for regression the epsilon-insensitive loss
minimised with gradients that every task adds up over its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasMaxIter, HasOutputCol, HasRegParam
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Eigenvalues of the landmark kernel below this share of the largest count as zero (or belong to an indefinite kernel).
LEAST_EIGENVALUE = 1e-9
#: Width of the rounded corner of the epsilon tube, as a share of the spread of the labels.
CORNER = 1e-3


def kernel_matrix(kind: str, x: np.ndarray, y: np.ndarray, gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> np.ndarray:
    """Kernel values of the rows of ``x`` (n x d) to those of ``y`` (m x d)."""
    dots = x @ y.T
    if kind == "linear":
        return dots
    if kind == "polynomial":
        return (gamma * dots + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * dots + coef0)
    squares = (x * x).sum(1)[:, None], (y * y).sum(1)[None, :]
    if kind == "rbf":
        return np.exp(-gamma * np.maximum(squares[0] + squares[1] - 2 * dots, 0.0))
    if kind == "tanimoto":
        whole = squares[0] + squares[1] - dots
        return np.divide(dots, whole, out=np.ones_like(dots), where=whole != 0) ** degree
    raise ValueError(f"Unknown kernel {kind}")


def by_rows(x: pd.Series, fn: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """``fn`` of the matrix of all arrays of a column, row by row; null arrays stay null."""
    known = np.flatnonzero(x.notna().to_numpy())
    out: list = [None] * len(x)
    if len(known):
        for i, row in zip(known, fn(np.stack([x.iloc[i] for i in known]).astype(float))):
            out[i] = row
    return pd.Series(out, dtype=object)


def inverse_root(kernel: np.ndarray) -> np.ndarray:
    """The inverse square root of a symmetric matrix on its positive part."""
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    good = values > LEAST_EIGENVALUE * max(values.max(), 1e-300)
    return (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T


class WhitenedKernelMap(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Array column -> vector of whitened kernel values to fixed landmarks (see module doc); null arrays stay null."""

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

    def values(self) -> Callable[[np.ndarray], np.ndarray]:
        marks = np.array(self.getOrDefault(self.landmarks), float)
        kind, rest = self.getOrDefault(self.kernel), [self.getOrDefault(p) for p in (self.gamma, self.coef0, self.degree)]
        white = inverse_root(kernel_matrix(kind, marks, marks, *rest))
        return lambda x: kernel_matrix(kind, x, marks, *rest) @ white

    def _transform(self, df: DataFrame) -> DataFrame:
        values = self.values()

        @pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            return by_rows(x, values)

        a = mapped(F.col(self.getInputCol()).cast("array<double>"))
        return df.withColumn("__k", a).withColumn(self.getOutputCol(), F.when(F.col("__k").isNotNull(), array_to_vector("__k"))).drop("__k")


def as_array(df: DataFrame, col: str) -> Column:
    """A vector or array column as an array."""
    if df.schema[col].dataType.typeName() == "vectorudt":
        return F.when(F.col(col).isNotNull(), vector_to_array(col))
    return F.col(col).cast("array<double>")


def summed(rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """``fn`` of (vectors, labels) summed over all batches of all tasks; ``rows`` has an array and a label column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                total += fn(flat.reshape(batch.num_rows, -1), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for i, v in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect():  # ``size`` rows
        out[i] = v
    return out


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float = 1e-7, memory: int = 8) -> np.ndarray:
    """Minimum of a smooth convex function by limited-memory quasi-Newton steps; ``f`` gives value and gradient."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        step, alphas = -grad, []
        for s, y in reversed(pairs):
            alphas.append((s @ step) / (s @ y))
            step = step - alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            step = step * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(alphas)):
            step = step + (a - (y @ step) / (s @ y)) * s
        size, slope = 1.0 if pairs else 1.0 / max(1.0, np.abs(grad).sum()), grad @ step
        while True:
            new_value, new_grad = f(x + size * step)
            if new_value <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        if size < 1e-10:
            break
        moved, turned = size * step, new_grad - grad
        if moved @ turned > 1e-14:
            pairs = [*pairs, (moved, turned)][-memory:]
        done = abs(value - new_value) <= tol * max(abs(value), abs(new_value), 1e-12)
        x, value, grad = x + moved, new_value, new_grad
        if done:
            break
    return x


class EpsilonRegression(Estimator, HasInputCol, HasLabelCol, HasRegParam, HasMaxIter, DefaultParamsReadable, DefaultParamsWritable):
    """Linear support vector regression: regParam / 2 |w|^2 + mean max(0, |label - w.x - b| - epsilon).

    ``epsilon`` is in units of the label.  The corners of the tube are rounded over ``CORNER`` standard deviations of the
    label, so the gradient, which the tasks add up, leads to the minimum.  Rows with a null label or vector are left out.
    """

    epsilon = Param(Params._dummy(), "epsilon", "half width of the tube, in label units", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol="features", labelCol="label", epsilon=0.1, regParam=1e-4, maxIter=60):
        super().__init__()
        self._setDefault(epsilon=0.1, regParam=1e-4, maxIter=60)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        from assayflow.operators.models import LinearRowModel
        from assayflow.session import materialize

        eps, reg = self.getOrDefault(self.epsilon), self.getRegParam()
        rows = materialize(df.select(as_array(df, self.getInputCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")).na.drop("any"))
        stats = rows.agg(F.count("y"), F.avg("y"), F.stddev_pop("y"), F.max(F.size("x"))).first()
        if not stats[0]:
            raise ValueError("no rows with a label and features")
        n, mean, spread, d = stats
        spread = spread or 1.0
        corner = CORNER * spread

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                r = x @ w[:-1] + w[-1] - y
                over = np.abs(r) - eps
                rounded = np.where(over <= 0, 0.0, np.where(over < corner, over * over / (2 * corner), over - corner / 2))
                pull = np.sign(r) * np.clip(over / corner, 0.0, 1.0)
                return np.concatenate([x.T @ pull, [pull.sum(), rounded.sum()]])

            total = summed(rows, part, d + 2) / n
            grad = total[:-1] + reg * np.append(w[:-1], 0.0)
            return float(total[-1] + reg / 2 * (w[:-1] @ w[:-1])), grad

        w = minimised(loss, np.append(np.zeros(d), mean), self.getMaxIter())
        return LinearRowModel(inputCol=self.getInputCol(), outputCol="prediction", weights=[float(v) for v in w[:-1]], intercept=float(w[-1]))


def kernel_svm(kind: str, landmarks: Sequence[Sequence[float]], input_col: str, label: str = "label", regression: bool = False,
               gamma: float = 1.0, epsilon: float | None = None, max_iter: int = 50, coef0: float = 0.0, degree: int = 3, reg: float = 1e-4):
    """Kernel SVM (classes) or SVR (regression) over a whitened landmark map; ``epsilon`` is in label units."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC

    km = WhitenedKernelMap(inputCol=input_col, outputCol="kernel_features", landmarks=[list(x) for x in landmarks], kernel=kind, gamma=gamma, coef0=coef0, degree=degree)
    if regression:
        fit = EpsilonRegression(inputCol="kernel_features", labelCol=label, epsilon=0.1 if epsilon is None else float(epsilon), regParam=reg, maxIter=max_iter)
    else:
        fit = LinearSVC(featuresCol="kernel_features", labelCol=label, maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[km, fit])


# ------------------------------------------------------------------ SVD

def gramian(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """Sums of products of every two positions of a fixed-width array column: (i, j, value) with i <= j, and the width.

    A task adds up its batches as matrices and hands on one row per (i, j).
    """
    rows = df.select(as_array(df, col).alias("x")).filter("x is not null")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])], names=["i", "j", "value"])

    parts = rows.mapInArrow(run, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value")), width


def svd_project(df: DataFrame, id_col: str, col: str, k: int = 10) -> DataFrame:
    """Rows projected onto the first k right singular vectors (uncentered), each turned so that its largest entry is positive."""
    sums, width = gramian(df, col)
    gram = np.zeros((width, width))
    for i, j, v in sums.collect():  # width^2 / 2 rows
        gram[i, j] = gram[j, i] = v
    vectors = np.linalg.eigh(gram)[1][:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])

    @pandas_udf("array<double>")
    def projected(x: pd.Series) -> pd.Series:
        return by_rows(x, lambda rows: rows @ vectors)

    return df.select(id_col, projected(as_array(df, col)).alias("svd"))
