"""§2.6 joins: keyed joins with audits, lookups, suffix joins, value-list products and
sparse Tanimoto similarity (the nearest-neighbour search itself is in ``similarity``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.operators.metrics import checked
from assayflow.operators.similarity import nearest_similarity, similarity_profile  # noqa: F401
from assayflow.session import materialize


def inner_join_audited(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` that fails unless the rows of both sides are partners one to one.

    One full join, computed once; the audit and the result both read it.
    """
    ra = a.withColumn("__a", F.lit(1))
    rb = b.select(F.col(key).alias("__bk"), *[c for c in b.columns if c != key], F.lit(1).alias("__b"))
    j = materialize(ra.join(rb, ra[key] == rb["__bk"], "full"))
    per_key = j.groupBy(key).agg(F.count("__a").alias("na"), F.count("__b").alias("nb"))
    ok = per_key.agg(F.coalesce(F.bool_and((F.col("na") == 1) & (F.col("nb") == 1)), F.lit(True))).scalar()
    return j.select(checked(F.col(key), ok, "rows lost in the keyed join").alias(key), *[c for c in j.columns if c not in (key, "__bk", "__a", "__b")])


def merge_check(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str],
                same: Callable[[Column, Column], Column] | None = None,
                max_mismatch: float = 0.05, max_missing: float = 0.01) -> DataFrame:
    """Full join on ``key``; per row ``missing`` (one side absent) and ``mismatch`` (values differ by ``same``).
    Fails the job above 5 % mismatches or 1 % missing rows."""
    same = same or (lambda x, y: x.eqNullSafe(y))
    ra = a.select(key, *[F.col(c).alias(f"a_{c}") for c in cols])
    rb = b.select(F.col(key).alias("__bk"), *[F.col(c).alias(f"b_{c}") for c in cols])
    j = ra.join(rb, ra[key] == rb["__bk"], "full")
    missing = ra[key].isNull() | rb["__bk"].isNull()
    eq = F.lit(True)
    for c in cols:
        eq = eq & F.coalesce(same(F.col(f"a_{c}"), F.col(f"b_{c}")), F.lit(False))
    j = materialize(j.select(F.coalesce(ra[key], rb["__bk"]).alias(key), *[f"a_{c}" for c in cols], *[f"b_{c}" for c in cols],
                             missing.alias("missing"), (~missing & ~eq).alias("mismatch")))
    rates = j.agg(F.avg(F.col("mismatch").cast("double")).alias("mm"), F.avg(F.col("missing").cast("double")).alias("ms"))
    ok = rates.select((F.col("mm") <= max_mismatch) & (F.col("ms") <= max_missing)).scalar()
    return j.withColumn("mismatch", checked(F.col("mismatch"), ok, "merge check failed: too many mismatched or missing rows"))


def mismatch_rate(a: DataFrame, b: DataFrame, key: str, pred: Column, limit: float = 0.05) -> DataFrame:
    """Share of joined rows failing ``pred`` (written over columns of both sides); above ``limit`` the job fails."""
    rate = a.join(b, key).agg(F.avg(F.when(pred, F.lit(0.0)).otherwise(F.lit(1.0))).alias("mismatch_rate"))
    ok = F.col("mismatch_rate").isNull() | (F.col("mismatch_rate") <= limit)
    return rate.select(checked(F.col("mismatch_rate"), ok, f"more than {limit:.0%} mismatched rows").alias("mismatch_rate"))


def lookup(df: DataFrame, dim: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Attach attributes by id, missing -> null (dimension side broadcast by the planner when small)."""
    return df.join(dim, df[left_key] == dim[right_key], "left").drop(dim[right_key])


def join_with_suffixes(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner join; columns present on both sides (other than keys) get suffixes."""
    common = (set(a.columns) & set(b.columns)) - set(keys)
    ra = a.select(*[F.col(c).alias(c + suffixes[0] if c in common else c) for c in a.columns])
    rb = b.select(*[F.col(c).alias(c + suffixes[1] if c in common else c) for c in b.columns])
    return ra.join(rb, list(keys))


def left_join_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Left join that fails when the right side has duplicate keys."""
    dup = b.groupBy(key).count().agg(F.max("count").alias("m")).scalar()
    j = a.join(b, key, "left")
    return j.withColumn(key, checked(F.col(key), F.coalesce(dup, F.lit(0)) <= 1, "right side of a 1:1 join has duplicate keys"))


def value_product(lists: dict[str, DataFrame], max_len: int = 1000) -> DataFrame:
    """Cartesian product of distinct value lists (grid), each at most ``max_len`` long (checked).

    Each list is reduced to one array (bounded by the guard) and the product
    is generated by successive ``explode`` -- no join.
    """
    arrays = []
    for name, df in lists.items():
        col = df.columns[0]
        arr = df.agg(F.array_sort(F.collect_set(col)).alias("a")).scalar()
        arrays.append((name, checked(arr, F.size(arr) <= max_len, f"value list {name} longer than {max_len}")))
    out = None
    for name, arr in arrays:
        if out is None:
            spark = next(iter(lists.values())).sparkSession
            out = spark.range(1).select(F.explode(arr).alias(name))
        else:
            out = out.withColumn("__a", arr).select("*", F.explode("__a").alias(name)).drop("__a")
    return out


# ------------------------------------------------------ similarity search

#: Characters of text whose words one task counts, where ``postings`` is told the sizes.
TASK_CHARS = 4_000_000


def postings(df: DataFrame, id_col: str, tokens: Column, name: str = "feature", partitions: int | None = None,
             keep: Sequence[str] = (), chars: Column | None = None) -> DataFrame:
    """Exploded sparse count vectors (id, keep..., feature, count).  The input is hash-partitioned by id first,
    so the per-(id, feature) counts and everything keyed by id downstream need no further shuffle.

    A task holds the words of its rows while it counts and gathers them, many times the size of their text.  With
    ``chars`` (the length of each row's text) there are as many partitions as keep ``TASK_CHARS`` in a task, so that does
    not grow with the table; without it their number is left to Spark, which merges partitions by the bytes of text."""
    if chars is not None and not partitions:
        wanted = -(-int(df.agg(F.sum(chars.cast("long"))).first()[0] or 0) // TASK_CHARS)
        partitions = wanted if wanted > df.sparkSession.sparkContext.defaultParallelism else None
    d = df.repartition(partitions, id_col) if partitions else df.repartition(id_col)
    e = d.select(id_col, *keep, F.explode(tokens).alias(name)).filter(F.col(name) != "")
    return e.groupBy(id_col, *keep, name).agg(F.count(F.lit(1)).cast("double").alias("count"))


def tanimoto_pairs(post: DataFrame, id_cols: Sequence[str], pairs: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Tanimoto of given pairs of sparse count vectors (postings ``id..., feature, count``).

    ``pairs`` lists (left ids..., right ids...); only the listed pairs are
    scored, through two keyed joins on (id, feature) -- never all pairs.
    Pairs without a shared feature score 0.
    """
    ids = list(id_cols)
    norms = post.groupBy(*ids).agg(F.sum(F.col("count") * F.col("count")).alias("__n"))
    pa = post.select(*[F.col(c).alias(l) for c, l in zip(ids, left)], "feature", F.col("count").alias("__ca"))
    pb = post.select(*[F.col(c).alias(r) for c, r in zip(ids, right)], "feature", F.col("count").alias("__cb"))
    j = pairs.join(pa, list(left)).join(pb, [*right, "feature"])
    dots = j.groupBy(*left, *right).agg(F.sum(F.col("__ca") * F.col("__cb")).alias("__dot"))
    na = norms.select(*[F.col(c).alias(l) for c, l in zip(ids, left)], F.col("__n").alias("__na"))
    nb = norms.select(*[F.col(c).alias(r) for c, r in zip(ids, right)], F.col("__n").alias("__nb"))
    out = pairs.join(dots, [*left, *right], "left").join(na, list(left), "left").join(nb, list(right), "left")
    den = F.col("__na") + F.col("__nb") - F.coalesce(F.col("__dot"), F.lit(0.0))
    t = F.when(F.col("__dot").isNull(), F.lit(0.0)).otherwise(F.col("__dot") / den)
    return out.select(*left, *right, t.alias("tanimoto"))
