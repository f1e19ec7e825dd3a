"""§2.15 distribution statistics: histograms, CDF curves, Gaussian KDE, cut points, Kaplan-Meier, normality.

Grid-valued results (histogram bins, KDE grids) are evaluated by letting
every value emit its contribution to each grid point and aggregating with
partial (map-side) aggregation: the shuffle carries grid-sized partial sums
per task, never values x grid rows.  Row-order logic (cumulative sums,
positions) goes through ``running_sums``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.functions import scalar as S
from assayflow.operators.ordered import add_position, attach, keyed_join, neighbours, running_sums, with_row
from assayflow.session import materialize

N_GRID = 100


def _join(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two small frames (a few rows per group) side by side; statistics go next to data rows with ``attach``."""
    return keyed_join(df, small, by) if by else with_row(df, small)


def _beside(grid: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], offset: int, prefix: str) -> DataFrame:
    """Columns of the following (1) or preceding (-1) row of a grid, which has a bounded number of rows per group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return grid.select("*", *[F.lead(c, offset).over(w).alias(f"{prefix}{c}") for c in cols])


# ------------------------------------------------------------- histograms

def bounds(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def normalize_range(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """(v - min) / (max - min) per group (max > min required)."""
    j = attach(df, bounds(df, by, value), by)
    return j.withColumn(out, (F.col(value) - F.col("min")) / (F.col("max") - F.col("min"))).drop("min", "max")


def frequency(df: DataFrame, by: Sequence[str], value: str, n_bins: int = 10, normalize: bool = False) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed, zero-filled; density when ``normalize``."""
    b = materialize(bounds(df, by, value).withColumn("__w", (F.col("max") - F.col("min")) / F.lit(float(n_bins))))
    j = attach(df.select(*by, value), b, by, ready=True)
    idx = F.least(F.floor((F.col(value) - F.col("min")) / F.col("__w")).cast("int"), F.lit(n_bins - 1))
    counts = j.groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("__c"))
    grid = b.select(*by, "__w", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    g = keyed_join(grid, counts, [*by, "bin"], "left").withColumn("count", F.coalesce("__c", F.lit(0.0)))
    if normalize:
        w = Window.partitionBy(*by)  # n_bins rows per group: bounded
        g = g.withColumn("count", F.col("count") / (F.sum("count").over(w) * F.col("__w")))
    return g.select(*by, "bin", "count")


def value_cdf(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Value-weighted cumulative curve over sorted values (x rescaled to [0,1], y = running sum / total),
    preceded by the seed point (0,0) whose x is rescaled like the others; ``key`` orders ties."""
    b = df.groupBy(*by).agg(F.min(value).alias("__mn"), F.max(value).alias("__mx"), F.sum(value).alias("__s"))
    b = materialize(b)
    cum = running_sums(df.select(*by, value, key), by, [value, key], [value, F.lit(1).cast("long")], ["__cs", "__p"])
    pts = attach(cum, b, by, ready=True).select(*by, F.col("__p").alias("point"), ((F.col(value) - F.col("__mn")) / (F.col("__mx") - F.col("__mn"))).alias("x"),
                                   (F.col("__cs") / F.col("__s")).alias("y"))
    seed = b.select(*by, F.lit(0).cast("long").alias("point"), ((F.lit(0.0) - F.col("__mn")) / (F.col("__mx") - F.col("__mn"))).alias("x"), F.lit(0.0).alias("y"))
    return pts.unionByName(seed)


def step_cdf(points: DataFrame, by: Sequence[str], point: str = "point") -> DataFrame:
    """Step-line coordinates: for each point after the first, (x_i, y_{i-1}) then (x_i, y_i)."""
    prev = neighbours(points, by, point, ["y"], offset=-1, prefix="prev_").filter(F.col("prev_y").isNotNull())
    return prev.select(*by, point, F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.col("x"), F.col("prev_y").alias("y")), F.struct(F.lit(1).alias("k"), F.col("x"), F.col("y")))).alias("s")
    ).select(*by, point, "s.k", "s.x", "s.y")


# -------------------------------------------------------------------- KDE

def kde_params(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, min, max and the rule-of-thumb bandwidth 1.06 * sd * n^-0.2 (sample sd)."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("sd")
    ).withColumn("h", F.lit(1.06) * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))


def _grid_x(i: Column, n_points: int) -> Column:
    return F.col("min") + i * (F.col("max") - F.col("min")) / F.lit(float(n_points - 1))


def kde_grid(df: DataFrame, by: Sequence[str], value: str, n_points: int = N_GRID, bandwidth: str | None = None,
             params: DataFrame | None = None) -> DataFrame:
    """Gaussian KDE on ``n_points`` equally spaced x from min to max: density, first and second
    derivative and CDF (means of kernel values over the data).

    Every value emits its contribution to each grid point and the sums are
    partially aggregated per task, so the shuffle carries grid-sized partial
    sums.  ``bandwidth`` names a per-row bandwidth column (adaptive KDE);
    default is the group's rule-of-thumb bandwidth.
    """
    p = params if params is not None else kde_params(df, by, value)
    p = materialize(p.select(*by, "n", "min", "max", "h"))
    j = attach(df.select(*by, value, *([bandwidth] if bandwidth else [])), p, by, ready=True)
    h = F.col(bandwidth) if bandwidth else F.col("h")
    # explode a plain index sequence (whole-stage codegen) rather than an array of structs from a lambda
    e = j.select(*by, h.alias("__h"), "min", "max", value, F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i"))
    hh = F.col("__h")
    e = e.select(*by, "i", "__h", ((_grid_x(F.col("i"), n_points) - F.col(value)) / hh).alias("u"))
    u = F.col("u")
    g = e.groupBy(*by, "i").agg(
        F.avg(S.gauss(u) / hh).alias("density"),
        F.avg(S.gauss_d1(u) / (hh * hh)).alias("d1"),
        F.avg(S.gauss_d2(u) / (hh * hh * hh)).alias("d2"),
        F.avg(S.normal_cdf(u)).alias("cdf"),
    )
    g = _join(g, p.select(*by, "min", "max"), by)
    return g.select(*by, "i", _grid_x(F.col("i"), n_points).alias("x"), "density", "d1", "d2", "cdf")


def _pilot_steps(params: DataFrame, n_bins: int) -> DataFrame:
    """``params`` with the pilot grid of each group: ``bins`` steps of width ``step`` from min to max, at least
    ``n_bins`` - 1 of them and none wider than a twelfth of the bandwidth."""
    width = F.col("max") - F.col("min")
    fine = F.when(F.col("h") > 0, F.ceil(F.lit(12.0) * width / F.col("h"))).otherwise(F.lit(0))
    bins = F.greatest(F.lit(n_bins - 1).cast("long"), fine)
    return params.withColumn("bins", bins).withColumn("step", width / F.col("bins"))


def binned_pilot(df: DataFrame, by: Sequence[str], value: str, params: DataFrame) -> DataFrame:
    """Fixed-bandwidth density on a fine grid from linearly binned data: the data pass only spreads each value over its
    two nearest bins.  Bins that hold something reach the grid points within 8 bandwidths, so empty stretches of a
    heavy-tailed group cost nothing; ``params`` carries ``bins`` and ``step`` (``_pilot_steps``)."""
    j = attach(df.select(*by, value), params.select(*by, "min", "bins", "step"), by)
    pos = F.when(F.col("step") > 0, (F.col(value) - F.col("min")) / F.col("step")).otherwise(F.lit(0.0))
    lo = F.least(F.floor(pos), F.col("bins") - 1)
    j = j.select(*by, lo.alias("__lo"), (pos - lo).alias("__t"))
    spread = j.select(*by, F.explode(F.array(F.struct(F.col("__lo").alias("b"), (F.lit(1.0) - F.col("__t")).alias("w")),
                                                F.struct((F.col("__lo") + 1).alias("b"), F.col("__t").alias("w")))).alias("s"))
    bins = spread.groupBy(*by, F.col("s.b").alias("b")).agg(F.sum("s.w").alias("w"))
    bins = _join(bins, params.select(*by, "n", "h", "bins", "step"), by)
    reach = F.when((F.col("h") > 0) & (F.col("step") > 0), F.ceil(F.lit(8.0) * F.col("h") / F.col("step"))).otherwise(F.col("bins"))
    e = bins.select(*by, "w", "h", "n", "step", "b", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("b") - reach), F.least(F.col("bins"), F.col("b") + reach))).alias("i"))
    e = e.select(*by, "i", "h", "n", (F.col("w") * S.gauss((F.col("i") - F.col("b")) * F.col("step") / F.col("h"))).alias("c"))
    return e.groupBy(*by, "i").agg(F.sum("c").alias("__s"), F.first("h").alias("h"), F.first("n").alias("n")).select(
        *by, "i", (F.col("__s") / (F.col("n") * F.col("h"))).alias("density"))


def kde_adaptive_bandwidths(df: DataFrame, by: Sequence[str], value: str, pilot_points: int = 1024) -> DataFrame:
    """Per-sample bandwidths b_i = h / (pilot(v_i) * n), rescaled by h / geometric mean.

    The pilot density at every sample would be all-pairs; instead it is the
    binned KDE on a fine grid (linear binning), at least ``pilot_points`` and
    so many that a step is at most h / 12, interpolated linearly at each
    sample -- no pairs are formed; error O(step^2 / h^2) whatever the range
    (checked against brute force in the tests).
    """
    p = materialize(_pilot_steps(kde_params(df, by, value), pilot_points))
    pilot = materialize(binned_pilot(df, by, value, p))
    j = attach(df, p.select(*by, "n", "min", "h", "bins", "step"), by)
    pos = F.when(F.col("step") > 0, (F.col(value) - F.col("min")) / F.col("step")).otherwise(F.lit(0.0))
    j = j.withColumn("__lo", F.least(F.floor(pos), F.col("bins") - 1)).withColumn("__t", pos - F.col("__lo"))
    lo = pilot.select(*by, F.col("i").alias("__lo"), F.col("density").alias("__d0"))
    hi = pilot.select(*by, (F.col("i") - 1).alias("__lo"), F.col("density").alias("__d1"))
    j = attach(j, keyed_join(lo, hi, [*by, "__lo"]), [*by, "__lo"])
    dens = F.col("__d0") + F.col("__t") * (F.col("__d1") - F.col("__d0"))
    j = j.withColumn("__b", F.col("h") / (dens * F.col("n")))
    gm = j.groupBy(*by).agg(F.exp(F.avg(F.ln("__b"))).alias("__gm"))
    j = attach(j, gm, by)
    out = j.withColumn("bandwidth", F.col("__b") * F.col("h") / F.col("__gm")).drop("__lo", "__t", "__d0", "__d1", "__b", "__gm", "n", "min", "h", "bins", "step")
    return materialize(out)


def kde_adaptive_grid(df: DataFrame, by: Sequence[str], value: str, n_points: int = N_GRID) -> DataFrame:
    bw = kde_adaptive_bandwidths(df, by, value)
    return kde_grid(bw, by, value, n_points, bandwidth="bandwidth")


def kde_cdf_at(df: DataFrame, by: Sequence[str], value: str, xs: DataFrame, bandwidth: str | None = None) -> DataFrame:
    """Kernel CDF at a few x per group (``xs``: by..., __k, x); each value contributes to each x, partially aggregated."""
    p = kde_params(df, by, value).select(*by, "h")
    cand = xs.groupBy(*by).agg(F.collect_list(F.struct("__k", "x")).alias("__xs"))  # bounded: candidates per group
    j = attach(df.select(*by, value, *([bandwidth] if bandwidth else [])), _join(p, cand, by), by)
    h = F.col(bandwidth) if bandwidth else F.col("h")
    e = j.select(*by, F.explode(F.transform("__xs", lambda c: F.struct(c["__k"].alias("k"), S.normal_cdf((c["x"] - F.col(value)) / h).alias("c")))).alias("e"))
    return e.groupBy(*by, F.col("e.k").alias("__k")).agg(F.avg("e.c").alias("cdf"))


def proportion(cdf: Column) -> Column:
    """Smaller tail mass at x: min(cdf, 1 - cdf)."""
    return F.when(cdf > 0.5, F.lit(1.0) - cdf).otherwise(cdf)


def invert_cdf(grid: DataFrame, by: Sequence[str], y: Column | float, name: str = "x_at") -> DataFrame:
    """x where the CDF grid crosses ``y``: the two grid rows around y, linear interpolation."""
    yy = y if isinstance(y, Column) else F.lit(y)
    nb = _beside(grid.select(*by, "i", "x", "cdf"), by, ["i"], ["x", "cdf"], 1, "n_")
    seg = nb.filter((F.col("cdf") <= yy) & (F.col("n_cdf") >= yy) & (F.col("n_cdf") > F.col("cdf")))
    x = F.col("x") + (yy - F.col("cdf")) * (F.col("n_x") - F.col("x")) / (F.col("n_cdf") - F.col("cdf"))
    return seg.groupBy(*by).agg(F.min_by(x, F.col("i")).alias(name))


def derivative_points(grid: DataFrame, by: Sequence[str]) -> DataFrame:
    """Minima, maxima and inflection points where the first / second derivative changes sign between grid points."""
    g = _beside(grid, by, ["i"], ["d1", "d2"], -1, "p_")
    g = g.filter(F.col("p_d1").isNotNull())
    kinds = F.array(
        F.when((F.col("d1") >= 0) & (F.col("p_d1") < 0), F.lit("Minimum")).when((F.col("d1") <= 0) & (F.col("p_d1") > 0), F.lit("Maximum")),
        F.when(((F.col("d2") >= 0) & (F.col("p_d2") < 0)) | ((F.col("d2") <= 0) & (F.col("p_d2") > 0)), F.lit("InflectionPoint")),
    )
    return g.select(*by, "i", "x", F.col("density").alias("y"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("point_type"))


def minima_between_maxima(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Minima whose neighbouring extrema (minima and maxima only, ordered by x) are both maxima."""
    ext = points.filter(F.col("point_type").isin("Minimum", "Maximum"))
    a = _beside(ext, by, ["x", "point_type"], ["point_type", "y", "x"], -1, "prev_")
    a = _beside(a, by, ["x", "point_type"], ["point_type", "y", "x"], 1, "next_")
    return a.filter((F.col("point_type") == "Minimum") & (F.col("prev_point_type") == "Maximum") & (F.col("next_point_type") == "Maximum"))


def inflection_pairs(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adjacent inflection points (in the full x-ordered list of derivative points)."""
    a = _beside(points, by, ["x", "point_type"], ["point_type", "y", "x"], 1, "next_")
    return a.filter((F.col("point_type") == "InflectionPoint") & (F.col("next_point_type") == "InflectionPoint"))


def cut_point(df: DataFrame, by: Sequence[str], value: str, pic50: bool = False, share: float = 0.333) -> DataFrame:
    """Classification cut point of each group's distribution (on the [0,1]-normalized values, adaptive KDE).

    1. first minimum between two maxima with tail mass >= 0.20, depth >= 0.15 (and, for pIC50, not below the median);
    2. else the first pair of adjacent inflection points with tail mass >= 0.20 and |gradient| <= 5;
    3. else the x where the CDF reaches 1 - share (skew >= 0 or pIC50) or ``share``.
    Direction: CDF(x) >= 0.5 -> UP for 1 and 2; skew sign for 3.  x is reported un-normalized.
    """
    from assayflow.operators.labels import skewness_g1

    norm = materialize(normalize_range(df, by, value, "__z"))
    bw = kde_adaptive_bandwidths(norm, by, "__z")
    grid = materialize(kde_grid(bw, by, "__z", N_GRID, bandwidth="bandwidth"))
    pts = materialize(derivative_points(grid, by))
    mid = invert_cdf(grid, by, 0.5, "__mid")
    cdf_at = grid.select(*by, "i", "cdf")

    mins = minima_between_maxima(pts, by)
    mins = keyed_join(mins, cdf_at, [*by, "i"])
    mins = _join(mins, mid, by)
    depth = F.greatest(F.col("prev_y") - F.col("y"), F.col("next_y") - F.col("y"))
    ok = (proportion(F.col("cdf")) >= 0.20) & (depth >= 0.15)
    if pic50:
        ok = ok & (F.col("x") >= F.col("__mid"))
    c1 = mins.filter(ok).groupBy(*by).agg(F.min_by(F.struct(F.col("x").alias("x"), F.col("cdf").alias("cdf")), F.col("x")).alias("m"))
    c1 = c1.select(*by, F.col("m.x").alias("x1"), F.when(F.col("m.cdf") >= 0.5, "UP").otherwise("DOWN").alias("dir1"))

    pairs = inflection_pairs(pts, by)
    xm = (F.col("x") + F.col("next_x")) / 2.0
    pairs = pairs.withColumn("xm", xm).withColumn("grad", F.abs((F.col("y") - F.col("next_y")) / (F.col("x") - F.col("next_x"))))
    # exact kernel CDF at each candidate midpoint (a handful of x per group)
    pairs = pairs.withColumn("__k", F.col("i"))
    cm = kde_cdf_at(bw, by, "__z", pairs.select(*by, "__k", F.col("xm").alias("x")), "bandwidth")
    pairs = keyed_join(pairs, cm.withColumnRenamed("cdf", "__cm"), [*by, "__k"])
    pairs = _join(pairs, mid, by)
    ok2 = (proportion(F.col("__cm")) >= 0.20) & (F.col("grad") <= 5.0)
    if pic50:
        ok2 = ok2 & (F.col("xm") >= F.col("__mid"))
    c2 = pairs.filter(ok2).groupBy(*by).agg(F.min_by(F.struct(F.col("xm").alias("x"), F.col("__cm").alias("cdf")), F.col("x")).alias("m"))
    c2 = c2.select(*by, F.col("m.x").alias("x2"), F.when(F.col("m.cdf") >= 0.5, "UP").otherwise("DOWN").alias("dir2"))

    sk = df.groupBy(*by).agg(skewness_g1(F.col(value).cast("double")).alias("skew"))
    target = F.when(F.lit(pic50) | (F.col("skew") >= 0), F.lit(1.0 - share)).otherwise(F.lit(share))
    g3 = _join(grid, sk, by).withColumn("__t", target)
    x3 = _invert_with_target(g3, by)
    c3 = _join(x3, sk, by).select(*by, "x3", F.when(F.col("skew") >= 0, "UP").otherwise("DOWN").alias("dir3"))

    b = bounds(df, by, value)
    out = _join(b, c3, by)
    out = keyed_join(out, c2, by, "left") if by else out.join(c2, how="left")
    out = keyed_join(out, c1, by, "left") if by else out.join(c1, how="left")
    kind = F.when(F.col("x1").isNotNull(), "Minimum").when(F.col("x2").isNotNull(), "Inflection").otherwise("Proportion")
    xn = F.coalesce("x1", "x2", "x3")
    return out.select(
        *by, kind.alias("point_type"), (F.col("min") + xn * (F.col("max") - F.col("min"))).alias("cut"),
        F.coalesce(F.when(F.col("x1").isNotNull(), F.col("dir1")), F.when(F.col("x2").isNotNull(), F.col("dir2")), F.col("dir3")).alias("direction"),
    )


def _invert_with_target(grid: DataFrame, by: Sequence[str]) -> DataFrame:
    nb = _beside(grid.select(*by, "i", "x", "cdf", "__t"), by, ["i"], ["x", "cdf"], 1, "n_")
    yy = F.col("__t")
    seg = nb.filter((F.col("cdf") <= yy) & (F.col("n_cdf") >= yy) & (F.col("n_cdf") > F.col("cdf")))
    x = F.col("x") + (yy - F.col("cdf")) * (F.col("n_x") - F.col("x")) / (F.col("n_cdf") - F.col("cdf"))
    return seg.groupBy(*by).agg(F.min_by(x, F.col("i")).alias("x3"))


# ---------------------------------------------------------- Kaplan-Meier

def kaplan_meier(df: DataFrame, by: Sequence[str], value: str, modifier: str) -> tuple[DataFrame, DataFrame]:
    """Kaplan-Meier table for one-sided censored data, per group.

    Left-censored groups ('<' present) are ordered by descending value,
    right-censored ('>') ascending; censored readings sort before exact ones
    on ties.  One entry per distinct exact value: total at risk (readings at
    or beyond it in that order), exact count, survival factor f (product of
    (total - exact) / total over earlier entries).  Returns (table, summary
    with mean and variance; variance is scaled by n/(n-1)).
    """
    by = list(by)
    kind = df.groupBy(*by).agg(
        F.count_if(F.col(modifier) == "<").alias("__nl"), F.count_if(F.col(modifier) == ">").alias("__nr"), F.count(F.lit(1)).alias("__n")
    )
    kind = kind.select(*by, "__n", F.when(F.col("__nl") > 0, F.when(F.col("__nr") == 0, F.lit(-1.0)).otherwise(
        F.raise_error(F.lit("left and right censored values in one group")).cast("double"))).otherwise(F.lit(1.0)).alias("__dir"))
    kind = materialize(kind)
    j = attach(df.select(*by, value, modifier), kind, by, ready=True)
    # sign-flip the value so that KM order (descending for left-censored) is ascending in __s
    j = j.withColumn("__s", F.col(value) * F.col("__dir"))
    per = j.groupBy(*by, "__s", value).agg(F.count(F.lit(1)).alias("__c"), F.count_if(F.col(modifier) == "=").alias("exact"))
    # total at risk = readings at or after this value in KM order = n - readings strictly before it
    before = running_sums(per, by, ["__s"], ["__c"], ["__cum"])
    before = _join(before, kind.select(*by, "__n"), by)
    ent = before.filter(F.col("exact") > 0).select(*by, "__s", value, "exact", (F.col("__n") - (F.col("__cum") - F.col("__c"))).alias("total"))
    r = (F.col("total") - F.col("exact")) / F.col("total")
    ent = ent.withColumn("__lr", F.when(r > 0, F.ln(r)).otherwise(F.lit(0.0))).withColumn("__z", (r <= 0).cast("long"))
    cum = running_sums(ent, by, ["__s"], ["__lr", "__z"], ["__slr", "__sz"])
    f = F.when(F.col("__sz") - F.col("__z") > 0, F.lit(0.0)).otherwise(F.exp(F.col("__slr") - F.col("__lr")))
    tab = cum.withColumn("f", f)
    tab = add_position(tab, ["__s"], by, "index")
    last = tab.groupBy(*by).agg(F.max("index").alias("__last"))
    tab = _join(tab, last, by)
    step = F.when(F.col("index") == F.col("__last"), F.col("f")).otherwise(F.col("f") * (F.lit(1.0) - r))
    tab = tab.withColumn("__step", step)
    summ = tab.groupBy(*by).agg(F.sum(F.col(value) * F.col("__step")).alias("mean"), F.sum(F.col(value) * F.col(value) * F.col("__step")).alias("__sq"))
    summ = _join(summ, kind.select(*by, "__n"), by).select(
        *by, "mean", ((F.col("__sq") - F.col("mean") * F.col("mean")) * F.col("__n") / (F.col("__n") - 1)).alias("variance"))
    return tab.select(*by, "index", value, "total", "exact", "f"), summ


# ------------------------------------------------------------ normality

def ks_statistic(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of standardized values to N(0,1) and its asymptotic p-value, per group."""
    st = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__sd"), F.count(value).alias("n"))
    pos = add_position(df.select(*by, value, key).filter(F.col(value).isNotNull()), [value, key], by, "__p")
    j = attach(pos, st, by)
    cdf = S.normal_cdf((F.col(value) - F.col("__m")) / F.col("__sd"))
    d = F.greatest((F.col("__p") + 1) / F.col("n") - cdf, cdf - F.col("__p") / F.col("n"))
    g = j.groupBy(*by).agg(F.max(d).alias("ks"), F.first("n").alias("n"))
    lam = F.sqrt(F.col("n")) * F.col("ks")
    pval = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
                       lambda acc, k: acc + F.lit(2.0) * F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return g.withColumn("p_value", F.least(F.greatest(pval, F.lit(0.0)), F.lit(1.0)))


def normality(df: DataFrame, by: str, value: str, key: str = "event_id") -> DataFrame:
    """KS normality of a column and of its log10 (when all values > 0), per group."""
    raw = ks_statistic(df, [by], value, key).select(by, F.col("ks").alias("ks_raw"), F.col("p_value").alias("p_raw"))
    pos = df.groupBy(by).agg(F.min(value).alias("__mn")).filter(F.col("__mn") > 0).select(by)
    lg = df.join(pos, by, "left_semi").withColumn("__lg", F.log10(value))
    logd = ks_statistic(lg, [by], "__lg", key).select(by, F.col("ks").alias("ks_log"), F.col("p_value").alias("p_log"))
    return raw.join(logd, by, "left")
