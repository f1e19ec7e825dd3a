"""Label operators against brute force: percent-active thresholds and the regression-to-classification sweep."""

import math

import numpy as np
import pandas as pd
import pytest

from assayflow.operators import labels as L


def _pct(s, q):
    s = np.sort(s)
    pos = q * (len(s) + 1) / 100
    if pos < 1:
        return s[0]
    if pos >= len(s):
        return s[-1]
    lo = int(math.floor(pos))
    return s[lo - 1] + (pos - lo) * (s[lo] - s[lo - 1])


def _skew(v):
    n = len(v)
    m = v.mean()
    m2 = ((v - m) ** 2).mean()
    m3 = ((v - m) ** 3).mean()
    return m3 / m2 ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)


def _auc(lab, prob):
    P, N = lab.sum(), (1 - lab).sum()
    x = y = area = 0.0
    for p in np.unique(prob)[::-1]:
        sel = prob == p
        x2 = x + (1 - lab[sel]).sum() / N
        y2 = y + lab[sel].sum() / P
        area += (x2 - x) * (y + y2) / 2
        x, y = x2, y2
    return area


def _f1(lab, pred):
    tp = ((lab == 1) & (pred == 1)).sum(); fp = ((lab == 0) & (pred == 1)).sum(); fn = ((lab == 1) & (pred == 0)).sum()
    pr = tp / (tp + fp) if tp + fp else 0.0
    rc = tp / (tp + fn) if tp + fn else 0.0
    return (0.0 if pr == 0 or rc == 0 else 2 * pr * rc / (pr + rc)), tp, fp, fn


def _sweep(label, pred):
    sk = _skew(label)
    up = sk > 0
    best = None
    for p in range(1, 50):
        thr = _pct(label, 100 - p) if up else _pct(label, p)
        lab = (label >= thr) if up else (label <= thr)
        lab = lab.astype(float)
        if lab.sum() < 1:
            continue
        mn, mx = pred.min(), pred.max()
        scores = []
        for i in range(100):
            c = mn + i * (mx - mn) / 99.0
            scores.append(_f1(lab, (pred >= c).astype(float))[0])
        c = mn + int(np.argmax(scores)) * (mx - mn) / 99.0
        f1, tp, fp, fn = _f1(lab, (pred >= c).astype(float))
        auc = _auc(lab, pred)
        if tp + fn >= 10 and (tp + fn) * 100.0 / len(lab) >= 5.0 and f1 >= 0.5:
            if best is None or auc > best[1]:
                best = (float(p), auc, f1)
    return best


def test_percent_active_matches_definition(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.lognormal(0, 1, 301), 3)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": v}))
    r = L.percent_active(df, ["g"], "v", 10.0).first()
    assert r["direction"] == ("UP" if _skew(v) > 0 else "DOWN")
    assert r["threshold"] == pytest.approx(_pct(v, 90.0 if _skew(v) > 0 else 10.0))


def test_cutoff_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    n = 160
    label = np.round(rng.lognormal(1, 0.6, n), 3)
    pred = np.round(label * 0.8 + rng.normal(0, 0.8, n), 3)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "label": label, "prediction": pred}))
    _, best = L.cutoff_sweep(df, ["g"], "label", "prediction")
    got = best.first()
    exp = _sweep(label, pred)
    assert got["percent"] == exp[0]
    assert got["roc_auc"] == pytest.approx(exp[1]) and got["f1"] == pytest.approx(exp[2])
