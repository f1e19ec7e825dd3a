"""§2.8 summaries, percentiles, best-of-group and hit rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.operators.metrics import checked
from assayflow.operators.ordered import Down, add_position, attach, keyed_join, running_sums, with_row
from assayflow.session import materialize

#: Bins of the histogram that narrows a percentile down.
BINS = 1024


def summary_stats(df: DataFrame, by: Sequence[str], value: str, n_rows: Column | None = None) -> DataFrame:
    """count, mean, min, max, population variance and sd (mergeable, partial+final aggregation).

    ``n_rows`` switches to the sparse form: ``value`` rows are the non-zero
    entries and ``n_rows`` the number of vectors, so implicit zeros count.
    """
    v = F.col(value).cast("double")
    if n_rows is None:
        return df.groupBy(*by).agg(
            F.count(v).alias("count"),
            F.avg(v).alias("mean"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.var_pop(v).alias("variance"),
            F.stddev_pop(v).alias("sd"),
        )
    g = df.groupBy(*by).agg(
        F.sum(v).alias("__s"), F.sum(v * v).alias("__ss"), F.min(v).alias("__mn"), F.max(v).alias("__mx"),
        F.count(v).alias("__nz"), F.first(n_rows).alias("count"),
    )
    mean = F.col("__s") / F.col("count")
    var = F.col("__ss") / F.col("count") - mean * mean
    zeros = F.col("count") > F.col("__nz")
    return g.select(
        *by,
        "count",
        mean.alias("mean"),
        F.when(zeros, F.least(F.col("__mn"), F.lit(0.0))).otherwise(F.col("__mn")).alias("min"),
        F.when(zeros, F.greatest(F.col("__mx"), F.lit(0.0))).otherwise(F.col("__mx")).alias("max"),
        var.alias("variance"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"),
    )


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    """Equal-width bin of ``x`` in [lo, hi]; never decreasing in ``x`` (groups with NaN or infinite bounds have one bin)."""
    at = (x - lo) / (hi - lo)
    return F.when(hi > lo, F.when(F.isnan(at), F.lit(BINS - 1)).otherwise(F.least(F.floor(at * BINS), F.lit(BINS - 1)))).otherwise(F.lit(0)).cast("int")


def percentiles(
    df: DataFrame, by: Sequence[str], value: str, ps: Sequence[float], method: str = "n+1", names: Sequence[str] | None = None,
    long: bool = False,
) -> DataFrame:
    """Exact percentiles per group without sorting rows or collecting a group into one task.

    ``method="n+1"``: position p(n+1)/100 (1-based), below 1 -> min, at or
    above n -> max, linear interpolation (commons-math default).
    ``method="n-1"``: position 1 + p(n-1)/100 (numpy/pandas linear).

    A histogram per group tells which bins hold the wanted positions.  Rows of
    those bins become (group, value) counts, added up on the map side, so rows
    of one value travel as one; running sums of the counts give each value the
    positions it fills.  The rows themselves are not shuffled.
    """
    by = list(by)
    names = list(names or [f"p{str(p).replace('.', '_')}" for p in ps])
    clean = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    x = F.col("__x")
    stats = materialize(clean.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__mn"), F.max("__x").alias("__mx")))
    n = F.col("__n")
    wanted = []
    for i, p in enumerate(ps):
        t = F.lit(p / 100.0) * (n + 1) if method == "n+1" else F.lit(1.0) + F.lit(p / 100.0) * (n - 1)
        edge = (t < 1) | (t >= n)
        lo = F.when(t < 1, F.lit(0)).when(t >= n, n - 1).otherwise(F.floor(t) - 1).cast("long")
        wanted.append(F.struct(F.lit(i).alias("i"), lo.alias("lo"), F.when(edge, F.lit(0.0)).otherwise(t - F.floor(t)).alias("d")))
    targets = stats.select(*by, F.array(*wanted).alias("__tg"))  # an entry per percentile
    serves = lambda first, end: F.filter("__tg", lambda t: ((t["lo"] >= first) & (t["lo"] < end)) | ((t["d"] > 0) & (t["lo"] + 1 >= first) & (t["lo"] + 1 < end)))

    placed = attach(clean, stats.select(*by, "__mn", "__mx"), by).select(*by, "__x", _bin(x, F.col("__mn"), F.col("__mx")).alias("__bin"))
    bins = placed.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)  # at most BINS rows
    bins = keyed_join(bins.withColumn("__end", F.sum("__c").over(upto)), targets, by)
    held = bins.filter(F.size(serves(F.col("__end") - F.col("__c"), F.col("__end"))) > 0).select(*by, "__bin", (F.col("__end") - F.col("__c")).alias("__before"))

    counts = attach(placed, held, [*by, "__bin"]).groupBy(*by, "__bin", "__before", "__x").agg(F.count(F.lit(1)).alias("__c"))
    cum = running_sums(materialize(counts), [*by, "__bin"], ["__x"], ["__c"], ["__cum"])
    end = F.col("__before") + F.col("__cum")
    hits = keyed_join(cum, targets, by).select(*by, "__x", (end - F.col("__c")).alias("__first"), end.alias("__end"), F.explode(serves(end - F.col("__c"), end)).alias("t"))
    at = lambda pos: F.max(F.when((pos >= F.col("__first")) & (pos < F.col("__end")), x))
    vals = hits.groupBy(*by, "t.i").agg(at(F.col("t.lo")).alias("__a"), at(F.col("t.lo") + 1).alias("__b"), F.first("t.d").alias("__d"))
    step = F.when(F.col("__d") > 0, F.col("__d") * (F.col("__b") - F.col("__a"))).otherwise(F.lit(0.0))
    vals = vals.select(*by, "i", (F.col("__a") + step).alias("__v"))
    if long:  # (by..., i, value) with i the index into ps
        return vals.withColumnRenamed("__v", "value")
    return vals.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("__v"))).alias(name) for i, name in enumerate(names)])


def descriptive(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """mean, sample sd/variance, geometric mean, median (p(n+1)), bias-corrected skewness and kurtosis."""
    v = F.col(value).cast("double")
    n = F.col("n")
    g = df.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.var_samp(v).alias("variance"),
        # commons-math form: a zero gives 0, a negative value gives NaN
        F.when(F.count_if(v < 0) > 0, F.lit(float("nan")))
        .when(F.count_if(v == 0) > 0, F.lit(0.0))
        .otherwise(F.exp(F.avg(F.ln(v))))
        .alias("geometric_mean"),
        F.skewness(v).alias("__g1"),
        F.kurtosis(v).alias("__g2"),
    )
    g = g.select(
        *by,
        "n",
        "mean",
        "sd",
        "variance",
        "geometric_mean",
        (F.col("__g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        (((n + 1) * F.col("__g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
    )
    med = percentiles(df, by, value, [50.0], "n+1", ["median"])
    return g.join(med, list(by)) if by else with_row(g, med)


def arg_best(df: DataFrame, by: Sequence[str], metric: str, larger_is_better: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """Whole best row per group (idxmax / idxmin) via ``max_by`` -- partial aggregation, no group-sized task."""
    cols = [c for c in df.columns if c not in by]
    m = F.col(metric) if larger_is_better else -F.col(metric)
    # earlier tie keys win: negate them when they are numeric is not general, so order by metric then reversed tie
    key = F.struct(m.alias("m"), *[(-F.col(t)).alias(f"t{i}") for i, t in enumerate(tie)])
    best = df.groupBy(*by).agg(F.max_by(F.struct(*cols), key).alias("__b"))
    return best.select(*by, *[F.col(f"__b.{c}").alias(c) for c in cols])


def hitrate(df: DataFrame, by: Sequence[str], active: str) -> DataFrame:
    """compounds, actives and hit rate per assay."""
    a = F.col(active).cast("double")
    return df.groupBy(*by).agg(
        F.count(a).alias("n_compounds"),
        F.sum(a).cast("long").alias("n_active"),
        F.avg(a).alias("hitrate"),
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, value: str, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """k most frequent values (value breaks ties), with their rank; the limit is the feature.

    Ranks come from the range-partitioned ``add_position`` over the value
    counts, so a group with very many distinct values is still spread over
    many tasks.
    """
    vc = value_counts(df.filter(F.col(value).isNotNull()), by, value)
    if not by:  # TakeOrderedAndProject: per-partition top-k, then a k-row merge
        vc = vc.orderBy(F.col("count").desc(), F.col(value).asc()).limit(k)
    ranked = add_position(vc, [Down("count"), value], by, "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.filter(F.col("rank") <= k)


def group_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Largest group size per key, asserted to be 1 inside the plan."""
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__c")).agg(F.max("__c").alias("m"))
    return g.select(checked(F.col("m"), F.col("m") <= 1, "key is not unique").alias("max_group_size"))
