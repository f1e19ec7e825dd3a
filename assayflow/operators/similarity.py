"""Exact nearest-neighbour search by Tanimoto similarity of sparse count vectors.

t(a, b) = dot / (|a|^2 + |b|^2 - dot).  One side is held as an inverted index
in blocks of a bounded number of postings, each shipped to the tasks in turn;
the other side streams past it.  For a streamed vector the features are taken
in the order of what they cost (postings) for what they explain (their share
of the norm): rare and heavy ones first.  What the untouched features can
still add is at most sqrt(rest of |a|^2 * |b|^2), so

* indexed vectors not met so far are given up as soon as that bound lies below
  the best similarity found, and the remaining postings are never read;
* those met are scored in full only where the part found and the bound
  together could still win.

No (vector, vector) rows are made: a task returns the best per streamed vector
and group, or the best per indexed vector and group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from assayflow.operators.ordered import at_most

#: Postings of an index block.
BLOCK_POSTINGS = 1_000_000
#: Postings of a vector's features that are read without looking at bounds.
FEW_POSTINGS = 2000
#: Features between two looks at the bound.
LOOK = 4
#: Bounds are compared with this slack, for rounding.
SLACK = 1.0 + 1e-9


class Index:
    """Count vectors by item and by feature."""

    def __init__(self, item: np.ndarray, feature: np.ndarray, count: np.ndarray, n_items: int, n_features: int, group: np.ndarray, n_groups: int):
        self.n_items, self.n_features, self.group, self.n_groups = n_items, n_features, group, n_groups
        order = np.argsort(item, kind="stable")
        self.features, self.counts = feature[order], count[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=n_items))])
        self.norms = np.bincount(item, count * count, minlength=n_items)
        self.roots = np.sqrt(self.norms)
        order = np.argsort(feature, kind="stable")
        self.items, self.weights = item[order], count[order]
        self.df = np.bincount(feature, minlength=n_features)
        self.lists = np.concatenate([[0], np.cumsum(self.df)])
        self.scored = 0

    def similarity(self, dot: np.ndarray, norm: float, of: np.ndarray | slice) -> np.ndarray:
        return dot / (norm + self.norms[of] - dot)

    def exact(self, items: np.ndarray, vector: np.ndarray, norm: float) -> np.ndarray:
        """Similarities of ``items`` (all with features) to a dense vector."""
        self.scored += len(items)
        sizes = self.starts[items + 1] - self.starts[items]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.starts[items] - ends + sizes, sizes)
        return self.similarity(np.add.reduceat(vector[self.features[at]] * self.counts[at], ends - sizes), norm, items)

    def winners(self, features: np.ndarray, counts: np.ndarray, norm: float, best: np.ndarray, vector: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """Items whose similarity to the given vector may exceed ``best`` (one per group if ``alone``, else one per
        item), and the similarities.  ``best`` is raised on the way if ``alone``; ``vector`` is a dense row of zeros."""
        order = np.argsort(self.df[features] / (counts * counts), kind="stable")
        features, counts = features[order], counts[order]
        rest = np.concatenate([np.cumsum((counts * counts)[::-1])[::-1], [0.0]])
        vector[features] = counts
        dots, met = np.zeros(self.n_items), np.zeros(self.n_items, bool)
        floor = (lambda: best[self.group]) if alone else (lambda: best)
        reach = self.lists[features + 1] - self.lists[features]
        if reach.sum() <= FEW_POSTINGS:  # reading them all costs less than bounding them
            at = np.arange(int(reach.sum())) + np.repeat(self.lists[features] - np.cumsum(reach) + reach, reach)
            dots = np.bincount(self.items[at], np.repeat(counts, reach) * self.weights[at], minlength=self.n_items)
            vector[features] = 0.0
            items = np.flatnonzero(dots)
            return items, self.similarity(dots[items], norm, items)
        done = 0
        for k, (f, c) in enumerate(zip(features, counts)):
            if k % LOOK == 0:
                most = np.sqrt(rest[k]) * self.roots
                if not np.any((self.similarity(most, norm, slice(None)) * SLACK > floor()) & ~met):
                    break
            here = slice(self.lists[f], self.lists[f + 1])
            dots[self.items[here]] += c * self.weights[here]
            met[self.items[here]] = True
            done = k + 1
            if alone and k % LOOK == LOOK - 1:  # the item ahead of the others raises the floor early
                ahead = np.array([np.argmax(self.similarity(dots, norm, slice(None)))])
                if met[ahead[0]]:
                    group = self.group[ahead[0]]
                    best[group] = max(best[group], self.exact(ahead, vector, norm)[0])
        most = np.minimum(dots + np.sqrt(rest[done]) * self.roots, np.sqrt(norm) * self.roots)
        items = np.flatnonzero(met & (self.similarity(most, norm, slice(None)) * SLACK >= floor()))
        sims = self.exact(items, vector, norm) if len(items) else np.empty(0)
        vector[features] = 0.0
        return items, sims


def gathered(postings: DataFrame, id_col: str, groups: Sequence[str], feature: str) -> DataFrame:
    """One row per vector: id, groups, its squared norm, features and counts."""
    listed = F.collect_list(F.struct(F.col(feature).cast("string").alias("f"), F.col("count").cast("double").alias("c")))
    g = postings.groupBy(id_col, *groups).agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("__norm"), listed.alias("__l"))
    return g.select(id_col, *groups, "__norm", F.col("__l.f").alias("__f"), F.col("__l.c").alias("__c"))


def blocks(postings: DataFrame, id_col: str, groups: Sequence[str], feature: str, block: int | None = None) -> Iterator[tuple[Index, dict, list, list]]:
    """Index blocks of whole vectors: (index, feature numbers, ids, groups).  A block reaches the driver, and no more than one."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    total = postings.count()
    n = max(1, -(-total // (block or BLOCK_POSTINGS)))
    for b in range(n if total else 0):
        part = postings.filter(F.pmod(key, F.lit(n)) == b) if n > 1 else postings
        rows = part.select(id_col, *groups, F.col(feature).cast("string").alias("__feature"), F.col("count").cast("double").alias("__count")).toArrow()
        if not rows.num_rows:
            continue
        coded = rows.column("__feature").combine_chunks().dictionary_encode()
        whose = list(zip(*[rows.column(c).to_pylist() for c in (id_col, *groups)]))
        numbers = {w: i for i, w in enumerate(dict.fromkeys(whose))}
        members = {g: i for i, g in enumerate(dict.fromkeys(w[1:] for w in numbers))}
        item = np.fromiter((numbers[w] for w in whose), np.int64, len(whose))
        index = Index(item, coded.indices.to_numpy(), rows.column("__count").to_numpy(), len(numbers), len(coded.dictionary),
                      np.fromiter((members[w[1:]] for w in numbers), np.int64, len(numbers)), len(members))
        yield index, {f: i for i, f in enumerate(coded.dictionary.to_pylist())}, [w[0] for w in numbers], list(members)


def _vectors(batch: pa.RecordBatch, known: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(row, feature numbers, counts, squared norm) of the vectors that share a feature with the index."""
    for i, (features, counts, norm) in enumerate(zip(batch.column("__f").to_pylist(), batch.column("__c").to_pylist(), batch.column("__norm").to_pylist())):
        both = [(known[f], c) for f, c in zip(features, counts) if f in known]
        if both:
            numbers, values = zip(*both)
            yield i, np.array(numbers), np.array(values), norm


def _best_of_streamed(stream: DataFrame, id_col: str, index: Index, known: dict, members: list, schema: StructType) -> DataFrame:
    """The best similarity of every streamed vector to each group of the index."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(index.n_features)
        for batch in batches:
            at, of, sims = [], [], []
            for i, features, counts, norm in _vectors(batch, known):
                best = np.zeros(index.n_groups)
                items, found = index.winners(features, counts, norm, best, vector, alone=True)
                np.maximum.at(best, index.group[items], found)
                for g in np.flatnonzero(best > 0):
                    at.append(i)
                    of.append(members[g])
                    sims.append(best[g])
            ids = batch.column(id_col).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([m[k] for m in of], arrow.field(k + 1).type) for k in range(len(schema) - 2)], pa.array(sims, pa.float64())], schema=arrow)

    return stream.mapInArrow(run, schema)


def _best_of_indexed(stream: DataFrame, group_col: str, index: Index, known: dict, ids: list, schema: StructType) -> DataFrame:
    """The best similarity of every indexed vector to each group of the streamed ones, per task."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, best = np.zeros(index.n_features), {}
        for batch in batches:
            names = batch.column(group_col).to_pylist()
            for i, features, counts, norm in _vectors(batch, known):
                own = best.setdefault(names[i], np.zeros(index.n_items))
                items, found = index.winners(features, counts, norm, own, vector, alone=False)
                own[items] = np.maximum(own[items], found)
        for name, own in best.items():
            at = np.flatnonzero(own > 0)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], arrow.field(0).type), pa.array([name] * len(at), arrow.field(1).type), pa.array(own[at])], schema=arrow)

    return stream.mapInArrow(run, schema)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _fields(df: DataFrame, cols: Sequence[str]) -> list[StructField]:
    return [StructField(c, df.schema[c].dataType) for c in cols]


def nearest_similarity(bg: DataFrame, bg_id: str, ds: DataFrame, ds_id: str, feature: str = "feature",
                       ds_groups: Sequence[str] = (), name: str = "similarity", all_ids: DataFrame | None = None) -> DataFrame:
    """For every background item the highest Tanimoto similarity to any dataset item (per ``ds_groups``).

    ``bg`` and ``ds`` are postings ``(id, feature, count)``; ``bg`` should be hash-partitioned by its id (``postings``
    does this).  Ids keep their type, whatever it is.  The dataset is indexed, in blocks of ``BLOCK_POSTINGS``; the
    background is read once per block.  Items sharing no feature (or none at all, when ``all_ids`` lists every
    background id) score 0; with ``ds_groups`` only (item, group) pairs that share a feature are returned.
    """
    groups = list(ds_groups)
    stream = gathered(bg, bg_id, [], feature)
    schema = StructType([*_fields(bg, [bg_id]), *_fields(ds, groups), StructField(name, DoubleType())])
    parts = [_best_of_streamed(stream, bg_id, index, known, members, schema) for index, known, _, members in blocks(ds, ds_id, groups, feature)]
    found = _union(parts) if parts else bg.sparkSession.createDataFrame([], schema)
    best = found.groupBy(bg_id, *groups).agg(F.max(name).alias(name))
    if groups:
        return best
    ids = all_ids.select(bg_id) if all_ids is not None else bg.select(bg_id).distinct()
    return ids.join(best, bg_id, "left").select(bg_id, F.coalesce(F.col(name), F.lit(0.0)).alias(name))


def similarity_profile(bg: DataFrame, bg_id: str, ds: DataFrame, ds_id: str, dataset_col: str, names: Sequence[str],
                       all_ids: DataFrame | None = None) -> DataFrame:
    """``nearest_similarity`` against several datasets at once: one output column per dataset name (0 when no overlap).

    The background is indexed and the datasets stream past it; only where it fills more than a block and the datasets
    have fewer postings it is the other way round.  Similarity is symmetric, so both ways give the same numbers.
    """
    if not at_most(bg, BLOCK_POSTINGS) and ds.count() < bg.count():
        best = nearest_similarity(bg, bg_id, ds, ds_id, ds_groups=[dataset_col])
    else:
        stream = gathered(ds, ds_id, [dataset_col], "feature")
        schema = StructType([*_fields(bg, [bg_id]), *_fields(ds, [dataset_col]), StructField("similarity", DoubleType())])
        parts = [_best_of_indexed(stream, dataset_col, index, known, ids, schema) for index, known, ids, _ in blocks(bg, bg_id, [], "feature")]
        found = _union(parts) if parts else bg.sparkSession.createDataFrame([], schema)
        best = found.groupBy(bg_id, dataset_col).agg(F.max("similarity").alias("similarity"))
    wide = best.groupBy(bg_id).pivot(dataset_col, list(names)).agg(F.max("similarity"))
    ids = all_ids.select(bg_id) if all_ids is not None else bg.select(bg_id).distinct()
    return ids.join(wide, bg_id, "left").select(bg_id, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names])
