"""§2.10 labels: thresholds, percent-active cut points, binary detection, transforms, cutoff sweeps.

Everything is grouped: one job handles every (table, label) group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.operators import metrics as M
from assayflow.operators.metrics import checked
from assayflow.operators.ordered import attach, average_rank, keyed_join, with_row
from assayflow.operators.summaries import percentiles
from assayflow.session import materialize


def threshold(value: Column, cut: Column | float, greater_better: bool = True) -> Column:
    """Continuous -> 0/1: >= cut (or <= cut when lower is better); null stays null."""
    c = cut if isinstance(cut, Column) else F.lit(cut)
    hit = value >= c if greater_better else value <= c
    return F.when(value.isNull(), F.lit(None).cast("double")).when(hit, F.lit(1.0)).otherwise(F.lit(0.0))


def threshold_table(df: DataFrame, by: Sequence[str], value: str, cut, out: str, greater_better: bool = True) -> DataFrame:
    """Adds the 0/1 column; a group whose result holds a single class fails the job."""
    t = df.withColumn(out, threshold(F.col(value), cut, greater_better))
    if by:
        n = t.groupBy(*by).agg(F.countDistinct(out).alias("__k"))
        t = attach(t, n, by)
        return t.withColumn(out, checked(F.col(out), F.col("__k") == 2, "thresholding gives a single class")).drop("__k")
    k = t.agg(F.countDistinct(out)).scalar()
    return t.withColumn(out, checked(F.col(out), k == 2, "thresholding gives a single class"))


def skewness_g1(v: Column) -> Column:
    """Bias-corrected sample skewness (commons-math) from Spark's population g1."""
    n = F.count(v)
    return F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)


def percent_active(df: DataFrame, by: Sequence[str], value: str, percent: float = 10.0, direction: str | None = None) -> DataFrame:
    """Threshold at the p-th percent: direction UP if skewness > 0 (else DOWN) unless given;
    UP -> percentile(100 - p), DOWN -> percentile(p), percentile position p(n+1)."""
    return percent_active_many(df, by, value, [percent], direction).drop("percent")


def percent_active_many(df: DataFrame, by: Sequence[str], value: str, percents: Sequence[float], direction: str | None = None) -> DataFrame:
    """``percent_active`` for several percents with one numbering pass: (by..., percent, skewness, direction, threshold)."""
    by = list(by)
    sk = df.groupBy(*by).agg(skewness_g1(F.col(value).cast("double")).alias("skewness"))
    k = len(percents)
    ps = [100.0 - p for p in percents] + [float(p) for p in percents]
    pc = percentiles(df, by, value, ps, "n+1", long=True)
    idx = F.col("i") % k
    pc = pc.groupBy(*by, idx.alias("__pi")).agg(
        F.max(F.when(F.col("i") < k, F.col("value"))).alias("__hi"), F.max(F.when(F.col("i") >= k, F.col("value"))).alias("__lo")
    )
    pmap = F.element_at(F.array(*[F.lit(float(p)) for p in percents]), F.col("__pi") + 1)
    j = keyed_join(pc, sk, by)
    d = F.lit(direction) if direction else F.when(F.col("skewness") > 0, F.lit("UP")).otherwise(F.lit("DOWN"))
    return j.select(
        *by, pmap.alias("percent"), "skewness", d.alias("direction"), F.when(d == "UP", F.col("__hi")).otherwise(F.col("__lo")).alias("threshold")
    )


def _top2(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Two commonest values per group (count desc, value asc) by two max_by aggregations -- no group-wide sort."""
    vc = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    order = F.struct(F.col("__c"), -F.col(value))
    first = vc.groupBy(*by).agg(
        F.max_by(F.struct(F.col(value).alias("v"), F.col("__c").alias("c")), order).alias("t1"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("__c").alias("n"),
    )
    rest = keyed_join(vc, first.select(*by, F.col("t1.v").alias("__v1")), by).filter(F.col(value) != F.col("__v1"))
    second = rest.groupBy(*by).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col("__c").alias("c")), order).alias("t2"))
    return keyed_join(first, second, by, "left")


def is_binary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """2 distinct -> yes; 1 -> no; distinct*10 > n -> no; top-2 count * 1.25 > n -> yes; else no."""
    t = _top2(df, by, value)
    top2 = F.col("t1.c") + F.coalesce(F.col("t2.c"), F.lit(0))
    verdict = (
        F.when(F.col("n_distinct") == 1, F.lit(False))
        .when(F.col("n_distinct") == 2, F.lit(True))
        .when(F.col("n_distinct") * 10 > F.col("n"), F.lit(False))
        .otherwise(top2 * 1.25 > F.col("n"))
    )
    return t.select(*by, "n", "n_distinct", F.col("t1.v").alias("v1"), F.col("t2.v").alias("v2"), verdict.alias("is_binary"))


def binarize_common(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """The rarer side of the midpoint between the two commonest values becomes 1 (only where is_binary)."""
    b = is_binary(df, by, value).filter("is_binary").select(*by, "v1", "v2")
    j = attach(df, b, by)
    mid = (F.col("v1") + F.col("v2")) / 2.0
    high = F.col(value) > mid
    common_higher = F.col("v1") > F.col("v2")
    val = F.when(F.col(value).isNull(), F.lit(None).cast("double")).when(
        (high & ~common_higher) | (~high & common_higher), F.lit(1.0)
    ).otherwise(F.lit(0.0))
    return j.withColumn(out, val).drop("v1", "v2")


def inactive_value(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """A repeated maximum (more than 10 rows and over 5 %) marks 'inactive'; null otherwise."""
    vc = df.groupBy(*by, value).agg(F.count(value).alias("__c"))
    g = vc.groupBy(*by).agg(F.max(value).alias("__mx"), F.sum("__c").alias("__n"), F.coalesce(F.max_by("__c", value), F.lit(0)).alias("__mc"))
    return g.select(*by, F.when((F.col("__mc") > 10) & (F.col("__mc") * 20 > F.col("__n")), F.col("__mx")).alias("inactive_value"))


def distribution_info(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, distinct count, n > 50, categorical (< 10 distinct), number of categories."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.countDistinct(value).alias("n_distinct"))
    return g.select(
        *by, "n", "n_distinct", (F.col("n") > 50).alias("has_enough_values"), (F.col("n_distinct") < 10).alias("is_categorical"),
        F.when(F.col("n_distinct") < 10, F.col("n_distinct")).alias("n_categories"),
    )


def log_table(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Groups whose labels are all > 0 get ``log_<label>`` = ln(label); the old label is kept as ``arithmetic_<label>``."""
    ok = df.groupBy(*by).agg(F.min(label).alias("__mn")).filter(F.col("__mn") > 0).select(*by)
    j = attach(df, ok, by) if by else df.filter(df.agg(F.min(label)).scalar() > 0)
    return j.withColumnRenamed(label, f"arithmetic_{label}").withColumn(f"log_{label}", F.ln(F.col(f"arithmetic_{label}")))


def pic50(value: Column, exponent: Column, is_log: Column | bool = False, reverse: Column | bool = True) -> Column:
    """Unit-aware pIC50: molar units -> -(log10(v) + exponent); log units -> v (negated when reverse)."""
    il = F.lit(is_log) if isinstance(is_log, bool) else is_log
    rv = F.lit(reverse) if isinstance(reverse, bool) else reverse
    lg = F.when(il, value).otherwise(F.log10(value) + exponent)
    return F.when(rv, -lg).otherwise(lg)


def positive_shift(df: DataFrame, label: str, out: str) -> DataFrame:
    """Shift labels by 1 - min when min <= 0 (the minimum becomes 1)."""
    mn = df.agg(F.min(label)).scalar()
    return df.withColumn(out, F.col(label) + F.when(mn <= 0, F.lit(1.0) - mn).otherwise(F.lit(0.0)))


def shift_inactive(df: DataFrame, label: str, activity: str, out: str, step: float = 1.0, exclude: bool = False) -> DataFrame:
    """Add ``step`` to the label of inactives (activity 0), or drop inactives when ``exclude``."""
    if exclude:
        return df.filter(F.col(activity) == 1).withColumn(out, F.col(label))
    return df.withColumn(out, F.when(F.col(activity) == 0, F.col(label) + F.lit(step)).otherwise(F.col(label)))


def regression_to_class(df: DataFrame, by: Sequence[str], label: str, pred: str, cut: Column, greater_better: Column,
                        min_count: int = 1, min_proportion: float = 0.0) -> DataFrame:
    """Threshold label and prediction; the raw prediction becomes ``probability``, the raw label ``regressionLabel``.
    Groups with too few positives are dropped."""
    def cls(c):
        return F.when(greater_better, F.when(c >= cut, 1.0).otherwise(0.0)).otherwise(F.when(c <= cut, 1.0).otherwise(0.0))

    t = df.select("*", F.col(label).alias("regressionLabel"), F.col(pred).alias("probability")).withColumn(label, cls(F.col(label))).withColumn(
        pred, cls(F.col(pred))
    )
    st = t.groupBy(*by).agg(F.sum(label).alias("__np"), F.count(F.lit(1)).alias("__n"))
    keep = st.filter((F.col("__np") >= min_count) & (F.col("__np") / F.col("__n") >= min_proportion)).select(*by)
    return attach(t, keep, by) if by else t


def direct_threshold_rule(name: Column, rules: Sequence[tuple[str, float, bool]]) -> tuple[Column, Column]:
    """Threshold and direction chosen by protocol-name substring rules (first match wins)."""
    thr = F.lit(None).cast("double")
    up = F.lit(None).cast("boolean")
    for pat, t, g in reversed(list(rules)):
        hit = F.lower(name).contains(pat.lower())
        thr = F.when(hit, F.lit(t)).otherwise(thr)
        up = F.when(hit, F.lit(g)).otherwise(up)
    return thr, up


def binary_category(cat: Column, both_is: float = 1.0) -> Column:
    """Regression -> 1, Classification -> 0, Both -> configurable; anything else fails the job."""
    return (
        F.when(cat == "Regression", F.lit(1.0))
        .when(cat == "Classification", F.lit(0.0))
        .when(cat == "Both", F.lit(both_is))
        .otherwise(F.raise_error(F.concat(F.lit("Unknown category "), cat)).cast("double"))
    )


def cutoff_sweep(df: DataFrame, by: Sequence[str], label: str, pred: str, percents: Sequence[int] = tuple(range(1, 50)),
                 min_positives: int = 10, min_percent: float = 5.0, min_f1: float = 0.5, n_steps: int = 100) -> tuple[DataFrame, DataFrame]:
    """Regression -> classification sweep over label percents.

    For each group and percent: label threshold and direction from
    ``percent_active``; label and prediction thresholded; the prediction
    cutoff re-tuned for F1 over ``n_steps`` linear steps (``p >= cutoff``); ROC
    AUC on the raw prediction.  Returns (detail, best): detail has every (group,
    percent) with a positive; best keeps per group the highest AUC among rows with
    positives >= 10, percent >= 5 and f1 >= 0.5.

    A row that is positive at one percent is so at all larger ones, so it is
    kept once, with the first percent at which it is positive, its prediction's
    step and its prediction's rank.  Counts and rank sums per (first percent,
    step), added up along both, give every confusion matrix; the rank sums of
    the positives give the AUCs.
    """
    by, k = list(by), len(percents)
    thr = materialize(percent_active_many(df, by, label, [float(p) for p in percents]).select(*by, "percent", "threshold", "direction"))
    listed = thr.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("percent", "threshold", "direction"))).alias("__t"))  # an entry per percent
    known = df.select(*by, label, pred).filter(F.col(pred).isNotNull())
    rng = known.groupBy(*by).agg(F.min(pred).alias("__mn"), F.max(pred).alias("__mx"))
    group = materialize(keyed_join(listed, rng, by) if by else with_row(listed, rng))
    positive = lambda t: F.coalesce(F.when(t["direction"] == "UP", F.col(label) >= t["threshold"]).otherwise(F.col(label) <= t["threshold"]), F.lit(False))
    rows = attach(known, group, by, ready=True).select(
        *by, pred, F.size(F.filter("__t", lambda t: ~positive(t))).alias("__first"), M.linspace_step(F.col(pred), F.col("__mn"), F.col("__mx"), n_steps).alias("step"))
    cells = average_rank(rows, by, pred, "__rank").groupBy(*by, "__first", "step").agg(F.count(F.lit(1)).alias("__c"), F.sum("__rank").alias("__r"))

    # k + 1 by n_steps cells per group, from here on
    grid = group.select(*by, "__mn", "__mx", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("__first"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("step"))
    g = keyed_join(grid, cells, [*by, "__first", "step"], "left").na.fill(0, ["__c", "__r"])
    above = Window.partitionBy(*by, "__first").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy(*by, "step").orderBy("__first").rowsBetween(Window.unboundedPreceding, 0)
    g = g.select("*", F.sum("__c").over(above).alias("__ca"), F.sum("__r").over(above).alias("__ra"))
    g = g.select("*", F.sum("__ca").over(upto).alias("tp"), F.sum("__ra").over(upto).alias("__rs"), F.sum("__ca").over(Window.partitionBy(*by, "step")).alias("__at"))
    whole = Window.partitionBy(*by, "__first")
    g = g.select("*", F.max("tp").over(whole).alias("positives"), F.max("__rs").over(whole).alias("__rp"), F.max("__at").over(whole).alias("__n"))
    g = g.filter((F.col("__first") < k) & (F.col("positives") > 0)).withColumn("fp", F.col("__at") - F.col("tp"))
    g = g.withColumn("fn", F.col("positives") - F.col("tp")).withColumn("tn", F.col("__n") - F.col("positives") - F.col("fp"))
    g = g.withColumn("cutoff", F.col("__mn") + F.col("step") * (F.col("__mx") - F.col("__mn")) / F.lit(float(n_steps - 1)))
    kept = ["tp", "tn", "fp", "fn", "positives", "cutoff", "__rp", "__n"]
    best_cut = g.groupBy(*by, "__first").agg(F.max_by(F.struct(*kept), F.struct(M.metric_expr("f1"), -F.col("step"))).alias("b")).select(*by, "__first", "b.*")
    pos, neg = F.col("positives").cast("double"), (F.col("__n") - F.col("positives")).cast("double")
    auc = F.when(neg == 0, F.lit(float("nan"))).otherwise((F.col("__rp") - pos * (pos + 1) / 2) / (pos * F.when(neg > 0, neg)))
    det = M.class_stats(best_cut).withColumn("roc_auc", auc).withColumn("accuracy", M.metric_expr("accuracy"))
    det = det.withColumn("percent", F.element_at(F.array(*[F.lit(float(p)) for p in sorted(percents)]), F.col("__first") + 1)).withColumn("pct_positive", pos * 100.0 / F.col("__n"))
    det = keyed_join(det, thr, [*by, "percent"]).drop("__first", "__rp", "__n", "cutoff")
    ok = (F.col("positives") >= min_positives) & (F.col("pct_positive") >= min_percent) & (F.col("f1") >= min_f1)
    best = det.filter(ok).groupBy(*by).agg(F.max_by(F.struct(*[c for c in det.columns if c not in by]), F.struct("roc_auc", -F.col("percent"))).alias("b"))
    return det, best.select(*by, "b.*")
