"""Classification metrics, ROC and cutoff optimizers against brute-force reimplementations of the definitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayflow.operators import metrics as M


def _scores(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    label = (rng.random(n) < 0.3).astype(float)
    prob = np.round(np.clip(label * 0.2 + rng.random(n) * 0.8, 0, 1), 2)  # ties on purpose
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n), "label": label, "p": prob})
    return pdf, spark.createDataFrame(pdf)


def _auc_brute(label, prob):
    # trapezoid over ROC points by descending probability, ties collapsed, starting at (0,0)
    order = np.argsort(-prob, kind="stable")
    P, N = label.sum(), (1 - label).sum()
    x = y = 0.0
    area = 0.0
    pts = []
    for p in np.unique(prob)[::-1]:
        sel = prob == p
        x2 = x + ((1 - label[sel]).sum()) / N
        y2 = y + (label[sel].sum()) / P
        area += (x2 - x) * (y + y2) / 2
        x, y = x2, y2
    return area


def test_roc_auc_matches_definition(spark):
    pdf, df = _scores(spark)
    got = {r["g"]: r["roc_auc"] for r in M.roc_auc(df, ["g"], "label", "p").collect()}
    for g, sub in pdf.groupby("g"):
        assert got[g] == pytest.approx(_auc_brute(sub.label.values, sub.p.values), abs=1e-12)


def test_midpoint_optimizer_matches_brute_force(spark):
    pdf, df = _scores(spark)
    got = {r["g"]: (r["cutoff"], r["score"]) for r in M.optimize_midpoint(df, ["g"], "label", "p", "f1").collect()}
    for g, sub in pdf.groupby("g"):
        u = np.unique(sub.p.values)
        best = None
        for a, b in zip(u[:-1], u[1:]):
            t = (a + b) / 2
            pred = (sub.p.values > t).astype(float)
            tp = ((sub.label == 1) & (pred == 1)).sum()
            fp = ((sub.label == 0) & (pred == 1)).sum()
            fn = ((sub.label == 1) & (pred == 0)).sum()
            pr = tp / (tp + fp) if tp + fp else 0.0
            rc = tp / (tp + fn) if tp + fn else 0.0
            f1 = 0.0 if pr == 0 or rc == 0 else 2 * pr * rc / (pr + rc)
            if best is None or f1 > best[1]:
                best = (t, f1)
        assert got[g][0] == pytest.approx(best[0]) and got[g][1] == pytest.approx(best[1])


def test_linspace_optimizer_first_best(spark):
    pdf, df = _scores(spark)
    sw = M.optimize_linspace(df, ["g"], "label", "p", "f1", 100)
    best = {r["g"]: (r["step"], r["score"]) for r in M.best_linspace(sw, ["g"]).collect()}
    for g, sub in pdf.groupby("g"):
        mn, mx = sub.p.min(), sub.p.max()
        scores = []
        for i in range(100):
            c = mn + i * (mx - mn) / 99.0
            pred = (sub.p.values >= c).astype(float)
            tp = ((sub.label == 1) & (pred == 1)).sum(); fp = ((sub.label == 0) & (pred == 1)).sum(); fn = ((sub.label == 1) & (pred == 0)).sum()
            pr = tp / (tp + fp) if tp + fp else 0.0
            rc = tp / (tp + fn) if tp + fn else 0.0
            scores.append(0.0 if pr == 0 or rc == 0 else 2 * pr * rc / (pr + rc))
        i = int(np.argmax(scores))
        assert best[g][0] == i and best[g][1] == pytest.approx(scores[i])


def test_class_stats_zero_denominators(spark):
    c = spark.createDataFrame([(0, 0, 5, 0)], "tp long, tn long, fp long, fn long")
    r = M.class_stats(c).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0


def test_scaled_cost_adds_fp_cost(spark):
    c = spark.createDataFrame([(1, 1, 2, 1)], "tp long, tn long, fp long, fn long")
    assert c.select(M.scaled_cost()).first()[0] == pytest.approx((2 + 1 + 1 * 10) / 5)


def test_confusion_rejects_non_binary(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "label double, prediction double")
    with pytest.raises(Exception):
        M.confusion(df, [], "label", "prediction").collect()
