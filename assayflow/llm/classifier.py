"""Document quality by histogram gradient-boosted trees over document statistics.

The statistics of a document come from its whole text.  Training bins each
statistic into at most ``BINS`` quantile bins and grows trees on gradient and
Hessian histograms (numpy).  The fitted ensemble is flattened into arrays
(feature, threshold, children, value), and a batch of documents walks all
trees level by level with array indexing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from assayflow.llm.common import cut, encoded, remainder

#: Labelled training rows at most (the smallest by hash of the id): the bound of the fit.
TRAIN_ROWS = 20_000
BINS = 64
THRESHOLD = 0.3

FEATURES = (
    "log_bytes upper digit blank newline punct symbol pipe bang high word_len words_per_line distinct_words top_word "
    "repeat_word distinct_pairs distinct_lines longest_word single_words symbol_words line_upper line_symbol line_repeat "
    "line_pipe line_bang short_lines"
).split()

_KIND = np.zeros(256, np.int64)  # 0 other
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in (32, 9, 11, 12, 13):
    _KIND[_c] = 3
_KIND[10] = 4
for _c in b".,;:'\"?()-":
    _KIND[_c] = 5
for _c in b"#$%&*+/<=>@[\\]^_`{}~":
    _KIND[_c] = 6
_KIND[ord("|")] = 7
_KIND[ord("!")] = 8
_KIND[128:] = 9


def statistics(text: str | None) -> list[float]:
    """The document's statistics; null and empty texts have defined ones (zeros)."""
    data = encoded(text)
    codes = np.frombuffer(data, np.uint8)
    n = max(1, len(codes))
    kinds = np.bincount(_KIND[codes], minlength=10) if len(codes) else np.zeros(10, np.int64)
    share = kinds / n
    words = data.split()
    w = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if len(words) > 1 else 1.0
    repeats = sum(map(bytes.__eq__, words, words[1:])) / w
    lines = [x for x in data.split(b"\n") if x.strip()]
    worst = [0.0] * 5
    short = 0
    for line in lines:
        short += len(line) < 24
        got = np.bincount(_KIND[np.frombuffer(line, np.uint8)], minlength=10) / len(line)
        own = line.split()
        values = (got[1], got[6], 1 - len(set(own)) / len(own) if len(own) > 7 else 0.0, got[7], got[8])
        if len(line) >= 24:
            worst = [max(a, b) for a, b in zip(worst, values)]
    symbol_words = sum(1 for x, k in counts.items() if x[-1:] in b"#$%&*!|") / max(1, len(counts))
    return [
        float(np.log1p(len(codes))), share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[9],
        float(lengths.mean()), len(words) / max(1, len(lines)), len(counts) / w, max(counts.values(), default=0) / w,
        repeats, pairs, len(set(lines)) / max(1, len(lines)), float(np.log1p(lengths.max())), float((lengths == 1).mean()),
        symbol_words, *worst, short / max(1, len(lines)),
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf has feature -1 and points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            f = self.feature[at]
            go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Histogram boosting for the logistic loss.  Without rows, or with one class only, the score is the smoothed share."""
    n, k = (len(x), x.shape[1]) if len(x) else (0, len(FEATURES))
    p = (float(y.sum()) + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], 1) if n else np.zeros((0, k), np.int64)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    f = np.full(n, base)

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        left[-1] = right[-1] = len(feature) - 1
        return len(feature) - 1

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        root = node()
        roots.append(root)
        level = [(root, np.arange(n))]
        for d in range(depth + 1):
            following = []
            for at, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-3, -1, -1)
                if d < depth and len(rows) >= 8:
                    for j in range(k):
                        if not len(edges[j]):
                            continue
                        b, m = binned[rows, j], len(edges[j]) + 1
                        gl, hl = np.cumsum(np.bincount(b, g[rows], m))[:-1], np.cumsum(np.bincount(b, h[rows], m))[:-1]
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        gain[(hl < least) | (hs - hl < least)] = -1
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (float(gain[i]), j, i)
                if best[1] < 0:
                    value[at] = rate * gs / (hs + l2)
                    f[rows] += value[at]
                    continue
                _, j, i = best
                goes = binned[rows, j] <= i
                feature[at], threshold[at], left[at], right[at] = j, float(edges[j][i]), node(), node()
                following += [(left[at], rows[goes]), (right[at], rows[~goes])]
            level = following
    as_int = lambda a: np.asarray(a, np.int64)
    return Trees(as_int(feature), np.asarray(threshold, float), as_int(left), as_int(right), np.asarray(value, float), as_int(roots), base, depth)


@pandas_udf(ArrayType(DoubleType()))
def _statistics(text: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in text])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int | None = 0) -> Trees:
    """Fit on at most ``TRAIN_ROWS`` labelled documents outside the held-out fold.

    Labels that are null or have a null id are left out; several labels of one id count as the largest.  Ids are
    taken in hash order, so the sample does not depend on partitioning.
    """
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).filter("id is not null and y is not null")
    if fold is not None:
        marked = marked.filter(remainder(F.col("id")) != fold)
    chosen = marked.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    chosen = F.broadcast(cut(chosen))  # TRAIN_ROWS rows at most
    texts = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")).join(chosen, F.col("doc") == F.col("id"))
    # of several texts of an id the one with the smallest hash
    rows = texts.select("id", "y", _statistics("text").alias("x"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("h"))
    rows = rows.groupBy("id", "y").agg(F.min_by("x", "h").alias("x")).collect()
    rows.sort(key=lambda r: str(r["id"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float))


def quality_score(model: Trees):
    """A Column function: whole text -> score in 0..1."""

    @pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in text], float).reshape(len(text), len(FEATURES))
        return pd.Series(model.probability(x))

    return score


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null texts count as empty and get the score of an empty text.  Repeated rows are scored each.  Labels, lang,
    source and the id are no inputs of a score; other columns are not looked at.  An empty table gives an empty result.
    """
    score = quality_score(fit_quality(docs, labels, id_col, text_col))
    out = docs.select(docs[id_col].alias("doc_id"), (remainder(docs[id_col]) == 0).alias("held_out"), score(docs[text_col]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
