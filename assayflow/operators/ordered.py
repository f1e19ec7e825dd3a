"""Order-dependent primitives that stay balanced under skew.

The original workbench numbers rows implicitly (vector positions) and walks
sorted vectors to build ROC curves, cumulative sums, ranks and percentiles.
A ``Window.partitionBy(group).orderBy(...)`` would do the same but sends a
whole group to one task -- fatal when one group holds a third of the rows.

``running_sums`` is the one scalable building block used instead:

1. splitters are picked from a bounded sample of the keys (group, order); the
   bucket of a row is the number of splitters at or below its key, a plain
   expression that gives the same answer wherever and whenever it is computed;
2. running sums inside each (group, bucket): one shuffle, in which a hot group
   is spread over many buckets;
3. bucket totals, added up on the map side; the offset of a bucket is the sum
   of the totals of the same group in earlier buckets.  A group continues from
   an earlier bucket only where a splitter cuts it, so the offset table has at
   most as many rows as there are splitters and is broadcast.

Frames of at most ``PLAIN_ROWS`` rows (grids, value counts of few values) need
no splitters: there a window over the group is bounded by that number.

Positions, average ranks, lag/lead by position, cumulative ROC counts and
percentile positions are all derived from it.  Order keys must be total
(append a unique key) and reproducible: a key that is itself a sum of floating
point numbers is to be written down first (``materialize``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.session import materialize

#: Rows up to which an ordered window over a whole group is used as it is.
PLAIN_ROWS = 20_000
#: Splitters at most, and sampled keys for each of them.
MAX_BUCKETS = 2048
KEYS_PER_BUCKET = 24
#: Rows of group statistics that are broadcast; beyond it they are joined by shuffle, salted.
BROADCAST_GROUPS = 100_000
SALTS = 16
#: Rows of a group from which it is dealt over ``SALTS`` tasks, where the statistics tell the number of rows.
HOT_ROWS = 100_000


@dataclass(frozen=True)
class Down:
    """An order key from the largest value to the smallest, NaN first and nulls last."""

    key: Column | str


OrderSpec = Column | str | Down


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _descends(df: DataFrame, key: Column) -> list[Column]:
    """Columns whose ascending order is the descending order of ``key``."""
    kind = df.select(key.alias("k")).schema[0].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        turned = [F.bitwise_not(key)]
    elif kind in ("float", "double"):
        turned = [~F.coalesce(F.isnan(key), F.lit(False)), -key]
    elif kind.startswith("decimal"):
        turned = [-key]
    elif kind == "boolean":
        turned = [~key]
    elif kind == "date":
        turned = [-F.unix_date(key)]
    elif kind == "timestamp":
        turned = [-F.unix_micros(key)]
    else:
        raise TypeError(f"no descending order for keys of type {kind}")
    return [key.isNull(), *turned]


def _ascending(df: DataFrame, order: Sequence[OrderSpec]) -> list[Column]:
    """Columns whose ascending order, nulls first, is ``order``.  ``F.col(name).desc()`` and its kin count as well."""
    out: list[Column] = []
    for o in order:
        sorted_by = re.fullmatch(r"Column<'(\w+) (ASC|DESC) NULLS (FIRST|LAST)'>", str(o)) if isinstance(o, Column) else None
        if sorted_by:
            key, way, nulls = F.col(sorted_by[1]), *sorted_by.groups()[1:]
            out += [key.isNull() if nulls == "LAST" else key.isNotNull(), *(_descends(df, key)[1:] if way == "DESC" else [key])]
        else:
            out += _descends(df, _col(o.key)) if isinstance(o, Down) else [_col(o)]
    return out


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows (reads no more than one row beyond)."""
    return df.limit(rows + 1).count() <= rows


def _comparable(df: DataFrame, keys: Sequence[Column]) -> Column:
    """The keys as one struct, in types whose JSON is exact."""
    kinds = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).schema
    plain = {"date": F.unix_date, "timestamp": F.unix_micros}
    return F.struct(*[plain.get(f.dataType.simpleString(), lambda c: c)(k).alias(f.name) for k, f in zip(keys, kinds)])


def _splitters(key: DataFrame, n_rows: int, buckets: int) -> list[str]:
    """At most ``buckets`` - 1 keys (as JSON) of a bounded sample, in order, evenly spaced."""
    share = min(1.0, buckets * KEYS_PER_BUCKET / max(1, n_rows))
    sample = key.sample(share, seed=11) if share < 1.0 else key
    rows = [r[0] for r in sample.orderBy("key").select(F.to_json("key")).collect()]
    cuts = [rows[len(rows) * i // buckets] for i in range(1, buckets)] if rows else []
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def _bucket(key: DataFrame, n_rows: int, buckets: int) -> Callable[[Column], Column]:
    """Number of splitters at or below a key, by binary search in a constant array."""
    cuts = _splitters(key, n_rows, buckets)
    if not cuts:
        return lambda _: F.lit(0)
    listed = F.from_json(F.lit(f"[{','.join(cuts)}]"), f"array<{key.schema['key'].dataType.simpleString()}>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def bucket(of: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, by: F.when((at + by <= len(cuts)) & (F.get(listed, at + by - 1) <= of), at + by).otherwise(at))

    return bucket


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[OrderSpec],
    values: Sequence[Column | str],
    names: Sequence[str],
    num_partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``values`` within ``by`` groups, ordered by ``order`` (nulls first).

    ``num_partitions`` sets the number of buckets; without it frames of at most ``PLAIN_ROWS`` rows get none.
    """
    by, vals = list(by), [_col(v) for v in values]
    ordered = _ascending(df, order)
    key = _comparable(df, [*map(F.col, by), *ordered])
    bare = df.select(key.alias("key"))
    n_rows = bare.count()
    if num_partitions is None and n_rows <= PLAIN_ROWS:
        w = Window.partitionBy(*by).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(v).over(w).alias(n) for v, n in zip(vals, names)])
    buckets = num_partitions or min(MAX_BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.select("*", *[v.alias(f"__rs_v{i}") for i, v in enumerate(vals)], _bucket(bare, n_rows, buckets)(key).alias("__rs_bucket"))
    w = Window.partitionBy(*by, "__rs_bucket").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *[F.sum(f"__rs_v{i}").over(w).alias(f"__rs_sum{i}") for i in range(len(vals))])
    totals = dealt.groupBy(*by, "__rs_bucket").agg(*[F.sum(f"__rs_v{i}").alias(f"__rs_total{i}") for i in range(len(vals))], F.count(F.lit(1)).alias("__rs_rows"))
    earlier = Window.partitionBy(*by).orderBy("__rs_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    offsets = totals.select(
        *[F.col(c).alias(f"__rs_by{j}") for j, c in enumerate(by)],
        F.col("__rs_bucket").alias("__rs_in"),
        *[F.sum(f"__rs_total{i}").over(earlier).alias(f"__rs_before{i}") for i in range(len(vals))],
        F.sum("__rs_rows").over(earlier).alias("__rs_earlier"),
    ).filter("__rs_earlier > 0")  # only groups that a splitter cuts: at most a row per splitter
    cond = [local[c].eqNullSafe(offsets[f"__rs_by{j}"]) for j, c in enumerate(by)] + [local["__rs_bucket"] == offsets["__rs_in"]]
    joined = local.join(F.broadcast(offsets), cond, "left")
    both = lambda i: F.when(F.col(f"__rs_sum{i}").isNull(), F.col(f"__rs_before{i}")).otherwise(F.col(f"__rs_sum{i}") + F.coalesce(F.col(f"__rs_before{i}"), F.lit(0)))
    return joined.select(*[local[c] for c in df.columns], *[both(i).alias(names[i]) for i in range(len(vals))])


def add_position(
    df: DataFrame,
    order: Sequence[OrderSpec],
    by: Sequence[str] = (),
    name: str = "pos",
    num_partitions: int | None = None,
) -> DataFrame:
    """0-based row position (within ``by`` groups) in ``order``; order must be total."""
    text_down = any(isinstance(o, Down) and df.select(_col(o.key)).schema[0].dataType.simpleString() == "string" for o in order)
    if text_down:  # text has no descending expression: count from the other end
        turned = [_col(o.key) if isinstance(o, Down) else Down(o) for o in order]
        out = running_sums(df, by, turned, [F.lit(1).cast("long")], [name], num_partitions)
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        return attach(out, sizes, by).withColumn(name, F.col("__n") - F.col(name)).drop("__n")
    out = running_sums(df, by, order, [F.lit(1).cast("long")], [name], num_partitions)
    return out.withColumn(name, F.col(name) - 1)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner", ready: bool = False, rows: str | None = None) -> DataFrame:
    """Per-group statistics (one row per ``keys``, null-safe) next to the rows they describe.

    The statistics are computed once and their number of rows is looked at: up to ``BROADCAST_GROUPS`` they are
    broadcast, so the rows of ``df`` stay where they are; beyond it both sides are shuffled on the keys and a salt,
    which deals a hot group over ``SALTS`` tasks.  ``ready``: the statistics are materialized already.  ``rows`` names a
    column of the statistics with the number of rows of each key; then only groups of ``HOT_ROWS`` rows are salted.
    """
    keys = list(keys)
    if not keys:
        return with_row(df, stats)
    stats = stats if ready else materialize(stats)
    if at_most(stats, BROADCAST_GROUPS):
        return keyed_join(df, F.broadcast(stats), keys, how)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    upto = F.lit(SALTS - 1).cast("long")
    salted = df.withColumn("__at_salt", salt)
    if rows:  # the hot groups are few: no more than all rows over HOT_ROWS
        hot = stats.filter(F.col(rows) >= HOT_ROWS).select(*keys, F.lit(True).alias("__at_hot"))
        salted = keyed_join(df, F.broadcast(hot), keys, "left").withColumn("__at_salt", F.when(F.col("__at_hot"), salt).otherwise(F.lit(0).cast("long"))).drop("__at_hot")
        upto = F.when(F.col(rows) >= HOT_ROWS, upto).otherwise(F.lit(0).cast("long"))
    spread = stats.withColumn("__at_salt", F.explode(F.sequence(F.lit(0).cast("long"), upto)))
    return keyed_join(salted, spread, [*keys, "__at_salt"], how).drop("__at_salt")


def average_rank(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    name: str = "rank",
    num_partitions: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """1-based average rank of ``value`` within ``by`` (ties share the mean rank).

    Works on the distinct (group, value) counts: rank = rows before + (ties + 1) / 2.  ``counted``: the same rows as they
    were before columns were added to them, if counting those is less work.
    """
    counts = materialize((df if counted is None else counted).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")))
    cum = running_sums(counts, by, [value], ["__n"], ["__cum"], num_partitions)
    ranks = cum.select(*by, value, "__n", ((F.col("__cum") - F.col("__n")) + (F.col("__n") + 1) / 2.0).alias(name))
    return attach(df, ranks, [*by, value], "left", rows="__n").drop("__n")


def neighbours(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    cols: Sequence[str],
    offset: int = 1,
    prefix: str = "next_",
) -> DataFrame:
    """lead/lag by position (``offset`` > 0 = following row) through an equi-join on (group, pos).

    Balanced under skew: the join key includes the position, so a hot group
    spreads over all tasks.
    """
    other = df.select(
        *[F.col(c).alias(f"__b{j}") for j, c in enumerate(by)],
        (F.col(pos) - offset).alias("__bpos"),
        *[F.col(c).alias(f"{prefix}{c}") for c in cols],
    )
    cond = [df[c].eqNullSafe(other[f"__b{j}"]) for j, c in enumerate(by)] + [df[pos] == other["__bpos"]]
    return df.join(other, cond, "left").select(*[df[c] for c in df.columns], *[f"{prefix}{c}" for c in cols])


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row.

    Done with a scalar subquery -- computed once, shipped as a value -- so
    no join is planned; Spark fails the query if the frame has more than
    one row, which makes the size bound explicit.
    """
    cols = one_row.columns
    s = one_row.select(F.struct(*[F.col(c) for c in cols]).alias("__r")).scalar()
    return df.withColumn("__row", s).select(*[F.col(c) for c in df.columns], *[F.col(f"__row.{c}").alias(c) for c in cols])


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``keys`` that is safe for frames sharing lineage (self-joins).

    The right side's key columns are renamed before the join and dropped
    after it, so the result has ``left``'s keys once.  With no keys it joins
    a right side that the caller guarantees to be one row.
    """
    keys = list(keys)
    if not keys:
        return with_row(left, right)
    rcols = [c for c in right.columns if c not in keys]
    r = right.select(*[F.col(c).alias(f"__j{j}") for j, c in enumerate(keys)], *[F.col(c).alias(c) for c in rcols])
    cond = [left[c].eqNullSafe(r[f"__j{j}"]) for j, c in enumerate(keys)]
    out = left.join(r, cond, how)
    return out.select(*[left[c] for c in left.columns], *[r[c] for c in rcols])
