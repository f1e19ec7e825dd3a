"""Regression and classification metrics, grouped from the start.

Every function takes grouping columns ``by`` so that many (assay, method,
dataset) tables are evaluated in one job.  Aggregates are built-ins, so
Spark runs them as partial (map-side) + final aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.session import materialize
from assayflow.operators.ordered import Down, average_rank, neighbours, running_sums, with_row


def safe_div(num: Column, den: Column, zero: float | None = 0.0) -> Column:
    """num / den, with ``zero`` when the denominator is 0 (the workbench's convention)."""
    return F.when(den == 0, F.lit(zero)).otherwise(num.cast("double") / den)


def checked(value: Column, ok: Column, msg: str) -> Column:
    """``value`` if ``ok`` else fail the job; the result depends on the check, so pruning keeps it."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(msg)))


# ---------------------------------------------------------------- regression

def pearson(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation aggregate; null (not a division error) when either side is constant."""
    xc = F.col(x) if isinstance(x, str) else x
    yc = F.col(y) if isinstance(y, str) else y
    den = F.stddev_pop(xc) * F.stddev_pop(yc)
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(F.covar_pop(xc, yc) / den)


def regression_metrics(df: DataFrame, by: Sequence[str], label: str, pred: str) -> DataFrame:
    """rmse = sqrt(mean((l-p)^2)), mae = mean(|l-p|), Pearson correlation, count."""
    d = F.col(label) - F.col(pred)
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"),
        pearson(label, pred).alias("pearson"),
        F.count(F.lit(1)).alias("n"),
    )


def spearman(df: DataFrame, by: Sequence[str], label: str, pred: str, key: str | None = None) -> DataFrame:
    """Spearman correlation = Pearson correlation of average ranks (ties share the mean rank)."""
    r = average_rank(df, by, label, "__rl")
    r = average_rank(r, by, pred, "__rp", counted=df)  # the first ranks are not joined once more to count the rows
    return r.groupBy(*by).agg(pearson("__rl", "__rp").alias("spearman"))


def label_scale(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """mean(|label|) -- the label dimensionality used to size SVR epsilon."""
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(label))).alias("label_scale"))


# ------------------------------------------------------------ classification

def confusion(df: DataFrame, by: Sequence[str], label: str, pred: str) -> DataFrame:
    """tp, tn, fp, fn; labels and predictions must be 0/1 (checked inside the plan)."""
    l, p = F.col(label), F.col(pred)
    bad = F.count_if(l.isNull() | p.isNull() | ~(l.isin(0.0, 1.0) & p.isin(0.0, 1.0)))
    g = df.groupBy(*by).agg(
        F.count_if((l == 1) & (p == 1)).alias("tp"),
        F.count_if((l == 0) & (p == 0)).alias("tn"),
        F.count_if((l == 0) & (p == 1)).alias("fp"),
        F.count_if((l == 1) & (p == 0)).alias("fn"),
        bad.alias("__bad"),
    )
    ok = F.col("__bad") == 0
    msg = "labels and predictions must be 0 or 1"
    return g.select(*by, *[checked(F.col(c), ok, msg).alias(c) for c in ("tp", "tn", "fp", "fn")])


def accuracy(df: DataFrame, by: Sequence[str], label: str, pred: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def precision(tp="tp", fp="fp") -> Column:
    return safe_div(F.col(tp), F.col(tp) + F.col(fp))


def recall(tp="tp", fn="fn") -> Column:
    return safe_div(F.col(tp), F.col(tp) + F.col(fn))


def specificity(tn="tn", fp="fp") -> Column:
    return safe_div(F.col(tn), F.col(tn) + F.col(fp))


def balanced_accuracy() -> Column:
    return (specificity() + recall()) / 2.0


def f1(p: Column | None = None, r: Column | None = None) -> Column:
    """2pr/(p+r); 0 when precision or recall is 0."""
    p = precision() if p is None else p
    r = recall() if r is None else r
    return F.when((r == 0.0) | (p == 0.0), F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


METRICS = {
    "precision": precision,
    "recall": recall,
    "specificity": specificity,
    "ba": balanced_accuracy,
    "f1": f1,
    "accuracy": lambda: safe_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
}


def metric_expr(metric: str | Column) -> Column:
    """A named metric over (tp, fp, tn, fn) columns, or a caller's Column expression."""
    if isinstance(metric, Column):
        return metric
    if metric not in METRICS:
        raise ValueError(f"Unknown classification metric {metric}")
    return METRICS[metric]()


def class_stats(counts: DataFrame) -> DataFrame:
    """precision, recall, specificity, balanced accuracy and F1 from count columns."""
    return counts.select(
        "*",
        precision().alias("precision"),
        recall().alias("recall"),
        specificity().alias("specificity"),
        balanced_accuracy().alias("ba"),
        f1().alias("f1"),
    )


def scaled_cost(fp_cost: float = 1.0, fn_cost: float = 10.0) -> Column:
    """(fp + fpCost + fn * fnCost) / n -- the workbench adds fpCost rather than multiplying (kept)."""
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return (F.col("fp") + F.lit(fp_cost) + F.col("fn") * F.lit(fn_cost)) / n


def plain_cost(fp_cost: float = 1.0, fn_cost: float = 10.0) -> Column:
    """fp * fpCost + fn * fnCost (notebook form)."""
    return F.col("fp") * F.lit(fp_cost) + F.col("fn") * F.lit(fn_cost)


def tpr() -> Column:
    return safe_div(F.col("tp"), F.col("tp") + F.col("fn"))


def fpr() -> Column:
    return safe_div(F.col("fp"), F.col("fp") + F.col("tn"))


def f1_guarded(p: str = "precision", r: str = "recall") -> Column:
    """Notebook F1 from precision/recall columns; 0 when recall is 0."""
    return F.when(F.col(r) == 0.0, F.lit(0.0)).otherwise(F.lit(2.0) * F.col(p) * F.col(r) / (F.col(p) + F.col(r)))


# ------------------------------------------------------------------- ROC

def _prob_counts(df: DataFrame, by: Sequence[str], label: str, prob: str) -> DataFrame:
    return df.groupBy(*by, prob).agg(
        F.count_if(F.col(label) == 1).alias("__pos"),
        F.count_if(F.col(label) == 0).alias("__neg"),
    )


def roc_curve(df: DataFrame, by: Sequence[str], label: str, prob: str) -> DataFrame:
    """ROC points by descending probability; tied probabilities collapse to one point; (0,0) not emitted.

    Output: by..., prob, fpr, tpr, and the cumulative counts.  Cumulative
    sums come from ``running_sums`` so a hot group never lands in one task.
    """
    counts = materialize(_prob_counts(df, by, label, prob))
    totals = counts.groupBy(*by).agg(F.sum("__pos").alias("__P"), F.sum("__neg").alias("__N"))
    cum = running_sums(counts, by, [Down(prob)], ["__pos", "__neg"], ["cum_tp", "cum_fp"])
    cond = [cum[c].eqNullSafe(totals[c]) for c in by]
    j = cum.join(totals, cond, "inner") if by else with_row(cum, totals)
    return j.select(
        *[cum[c] for c in by],
        cum[prob],
        "cum_tp",
        "cum_fp",
        "__pos",
        "__neg",
        "__P",
        "__N",
        # a single-class group has no ROC curve: NaN coordinates (0/0, as in the workbench), no division error
        safe_div(F.col("cum_fp"), F.col("__N"), float("nan")).alias("fpr"),
        safe_div(F.col("cum_tp"), F.col("__P"), float("nan")).alias("tpr"),
    )


def roc_auc(df: DataFrame, by: Sequence[str], label: str, prob: str, points: DataFrame | None = None) -> DataFrame:
    """Trapezoid area under the ROC points starting from (0,0) (``points``: a precomputed ``roc_curve``)."""
    pts = points if points is not None else roc_curve(df, by, label, prob)
    # groups with only one class have no ROC curve: NaN AUC (0/0, as in the workbench) instead of a division error
    trap = F.when((F.col("__N") == 0) | (F.col("__P") == 0), F.lit(float("nan"))).otherwise(
        (F.col("__neg") / F.col("__N")) * (F.lit(2.0) * F.col("cum_tp") - F.col("__pos")) / (F.lit(2.0) * F.col("__P")))
    return pts.groupBy(*by).agg(F.sum(trap).alias("roc_auc"))


# ------------------------------------------------------- cutoff optimizers

def optimize_midpoint(
    df: DataFrame, by: Sequence[str], label: str, prob: str, metric: str | Column = "f1", points: DataFrame | None = None
) -> DataFrame:
    """Cutoff maximizing ``metric`` among midpoints of neighbouring distinct probabilities.

    Predictions are ``prob > cutoff``; the smallest cutoff wins ties.  Every
    candidate is scored in one pass from cumulative counts over descending
    probability (tp/fp at cutoff between p_prev and p = counts at or above p).
    Output: by..., cutoff, score (null when a group has a single distinct probability).
    """
    pts = points if points is not None else roc_curve(df, by, label, prob)
    ranked = running_sums(pts, by, [prob], [F.lit(1).cast("long")], ["__rn"])
    prev = neighbours(ranked, by, "__rn", [prob], offset=-1, prefix="prev_")
    cand = prev.filter(F.col(f"prev_{prob}").isNotNull()).select(
        *by,
        ((F.col(f"prev_{prob}") + F.col(prob)) / 2.0).alias("cutoff"),
        F.col("cum_tp").alias("tp"),
        F.col("cum_fp").alias("fp"),
        (F.col("__P") - F.col("cum_tp")).alias("fn"),
        (F.col("__N") - F.col("cum_fp")).alias("tn"),
    )
    scored = cand.withColumn("score", metric_expr(metric))
    best = scored.groupBy(*by).agg(
        F.max_by(F.struct("cutoff", "score", "tp", "fp", "tn", "fn"), F.struct(F.col("score"), -F.col("cutoff"))).alias("b")
    )
    return best.select(*by, "b.*")


def linspace_step(x: Column, lo: Column, hi: Column, n_steps: int) -> Column:
    """The highest of ``n_steps`` equally spaced values from lo to hi that is at most x."""
    cut = lambda s: lo + s * (hi - lo) / F.lit(float(n_steps - 1))
    guess = F.when(hi == lo, F.lit(n_steps - 1)).otherwise(F.floor((x - lo) / F.when(hi != lo, hi - lo) * (n_steps - 1))).cast("int")
    # the guess can be off by one because of rounding: hold it against the exact cutoff formula
    down = F.when(x < cut(guess), guess - 1).otherwise(guess)
    return F.when((down < n_steps - 1) & (x >= cut(down + 1)), down + 1).otherwise(down)


def optimize_linspace(
    df: DataFrame, by: Sequence[str], label: str, prob: str, metric: str | Column = "f1", n_steps: int = 100
) -> DataFrame:
    """Cutoff among ``n_steps`` equally spaced values from min to max; predict ``prob >= cutoff``.

    Returns the full (cutoff index, cutoff, metric) table; ``best_linspace``
    picks the first best.  Counts at each cutoff come from cumulative counts:
    the candidate grid is matched to the distinct probabilities by bucket, so
    no row-by-cutoff product is formed.
    """
    rng = df.groupBy(*by).agg(F.min(prob).alias("__mn"), F.max(prob).alias("__mx"))
    grid = rng.select(*by, "__mn", "__mx", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("step")).select(
        *by,
        "step",
        (F.col("__mn") + F.col("step") * (F.col("__mx") - F.col("__mn")) / F.lit(float(n_steps - 1))).alias("cutoff"),
        "__mn",
        "__mx",
    )
    # counts of rows with prob >= cutoff: bucket each probability to the highest step whose cutoff <= prob,
    # then suffix-sum over steps (grid is small per group: n_steps rows).
    counts = _prob_counts(df, by, label, prob)
    cond = [counts[c].eqNullSafe(rng[c]) for c in by]
    b = (counts.join(rng, cond, "inner") if by else with_row(counts, rng)).select(
        *[counts[c] for c in by], "__pos", "__neg", linspace_step(F.col(prob), F.col("__mn"), F.col("__mx"), n_steps).alias("__b")
    )
    per_step = b.groupBy(*by, "__b").agg(F.sum("__pos").alias("__sp"), F.sum("__neg").alias("__sn"))
    cond = [grid[c].eqNullSafe(per_step[c]) for c in by] + [grid["step"] == per_step["__b"]]
    g = grid.join(per_step, cond, "left").select(
        *[grid[c] for c in by], "step", "cutoff", F.coalesce("__sp", F.lit(0)).alias("__sp"), F.coalesce("__sn", F.lit(0)).alias("__sn")
    )
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    wt = Window.partitionBy(*by)
    g = g.select(
        *by,
        "step",
        "cutoff",
        F.sum("__sp").over(w).alias("tp"),
        F.sum("__sn").over(w).alias("fp"),
        F.sum("__sp").over(wt).alias("__P"),
        F.sum("__sn").over(wt).alias("__N"),
    )
    g = g.select(*by, "step", "cutoff", "tp", "fp", (F.col("__P") - F.col("tp")).alias("fn"), (F.col("__N") - F.col("fp")).alias("tn"))
    return g.withColumn("score", metric_expr(metric))


def best_linspace(sweep: DataFrame, by: Sequence[str]) -> DataFrame:
    """First (lowest step) cutoff with the best score."""
    best = sweep.groupBy(*by).agg(
        F.max_by(F.struct("step", "cutoff", "score"), F.struct(F.col("score"), -F.col("step"))).alias("b")
    )
    return best.select(*by, "b.*")


def apply_cutoff(df: DataFrame, prob: str, cutoff: Column | float, out: str = "prediction", strict: bool = True) -> DataFrame:
    """Replace the prediction column with ``prob > cutoff`` (or ``>=`` when not strict)."""
    c = F.col(prob) > cutoff if strict else F.col(prob) >= cutoff
    return df.withColumn(out, c.cast("double"))
