"""Worked statistical examples (exact fixtures) and brute-force checks for the distribution statistics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayflow.operators import stats as ST
from assayflow.operators.summaries import percentiles


def test_kaplan_meier_worked_example(spark):
    rows = [(6.0, "="), (3.0, "="), (5.0, "<"), (10.0, "<"), (6.0, "="), (12.0, "="), (5.0, "="), (5.0, "<")]
    df = spark.createDataFrame([("g", v, m) for v, m in rows], "g string, value double, modifier string")
    tab, summ = ST.kaplan_meier(df, ["g"], "value", "modifier")
    t = [(r["value"], r["total"], r["exact"], r["f"]) for r in tab.orderBy("index").collect()]
    exp = [(12, 8, 1, 1.0), (6, 6, 2, 0.875), (5, 4, 1, 0.5833), (3, 1, 1, 0.4375)]
    for (v, n, e, f), (ev, en, ee, ef) in zip(t, exp):
        assert v == ev and n == en and e == ee and f == pytest.approx(ef, abs=1e-4)
    s = summ.first()
    assert s["mean"] == pytest.approx(5.292, abs=1e-3)
    assert s["variance"] == pytest.approx(9.236, abs=1e-3)


def test_percentile_n_plus_one(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    p = percentiles(df, ["g"], "v", [5.0, 50.0, 90.0], "n+1", ["a", "b", "c"]).first()
    s = sorted(vals)

    def ref(q):
        pos = q * (len(s) + 1) / 100
        if pos < 1:
            return s[0]
        if pos >= len(s):
            return s[-1]
        lo = int(math.floor(pos))
        return s[lo - 1] + (pos - lo) * (s[lo] - s[lo - 1])

    assert (p["a"], p["b"], p["c"]) == pytest.approx((ref(5), ref(50), ref(90)))


def test_kde_grid_matches_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, 300), rng.normal(4, 0.5, 200)])
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": v}))
    grid = ST.kde_grid(df, ["g"], "v").toPandas().sort_values("i")
    h = 1.06 * v.std(ddof=1) * len(v) ** -0.2
    xs = np.linspace(v.min(), v.max(), 100)
    dens = np.exp(-0.5 * ((xs[:, None] - v[None, :]) / h) ** 2).mean(axis=1) / (h * math.sqrt(2 * math.pi))
    assert np.allclose(grid["density"].values, dens, rtol=1e-9)
    cdf = np.array([np.mean([0.5 * (1 + math.erf((x - vi) / (h * math.sqrt(2)))) for vi in v]) for x in xs])
    assert np.allclose(grid["cdf"].values, cdf, atol=2e-7)  # polynomial erf, |error| <= 1.5e-7


def test_adaptive_kde_close_to_brute_force(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 1, 200), rng.normal(5, 1, 100)])
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": v}))
    got = ST.kde_adaptive_grid(df, ["g"], "v").toPandas().sort_values("i")
    n = len(v)
    h = 1.06 * v.std(ddof=1) * n ** -0.2
    pilot = np.exp(-0.5 * ((v[:, None] - v[None, :]) / h) ** 2).mean(axis=1) / (h * math.sqrt(2 * math.pi))
    b = h / (pilot * n)
    b = b * h / np.exp(np.log(b).mean())
    xs = np.linspace(v.min(), v.max(), 100)
    dens = (np.exp(-0.5 * ((xs[:, None] - v[None, :]) / b[None, :]) ** 2) / (b[None, :] * math.sqrt(2 * math.pi))).mean(axis=1)
    assert np.allclose(got["density"].values, dens, rtol=1e-3, atol=1e-6)


def test_adaptive_bandwidths_of_a_heavy_tailed_group_against_all_samples(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 15000), rng.normal(900, 40, 15), rng.normal(3000, 200, 5), [1e5]])
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": v}))
    got = ST.kde_adaptive_bandwidths(df, ["g"], "v").toPandas()
    n, v = len(v), got["v"].values
    h = 1.06 * v.std(ddof=1) * n ** -0.2
    assert (v.max() - v.min()) / 1023 > h / 2
    pilot = np.concatenate([np.exp(-0.5 * ((x[:, None] - v[None, :]) / h) ** 2).mean(axis=1) for x in np.array_split(v, 60)]) / (h * math.sqrt(2 * math.pi))
    b = h / (pilot * n)
    b = b * h / np.exp(np.log(b).mean())
    assert np.allclose(got["bandwidth"].values, b, rtol=5e-3)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([("g", float(x)) for x in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "g string, v double")
    h = ST.frequency(df, ["g"], "v", 10).orderBy("bin").toPandas()
    assert list(h["count"]) == [1.0] * 9 + [2.0]


def test_value_cdf_seed_point(spark):
    df = spark.createDataFrame([("g", 1, 2.0), ("g", 2, 4.0), ("g", 3, 6.0)], "g string, k int, v double")
    c = ST.value_cdf(df, ["g"], "v", "k").orderBy("point").toPandas()
    assert c["x"].tolist() == pytest.approx([-0.5, 0.0, 0.5, 1.0])
    assert c["y"].tolist() == pytest.approx([0.0, 2 / 12, 6 / 12, 1.0])


def test_kaplan_meier_right_censored_mirror(spark):
    rows = [(6.0, "="), (3.0, "="), (5.0, "<"), (10.0, "<"), (6.0, "="), (12.0, "="), (5.0, "="), (5.0, "<")]
    mirrored = [("g", -v, ">" if m == "<" else m) for v, m in rows]
    tab, summ = ST.kaplan_meier(spark.createDataFrame(mirrored, "g string, value double, modifier string"), ["g"], "value", "modifier")
    t = [(r["value"], r["total"], r["exact"], r["f"]) for r in tab.orderBy("index").collect()]
    exp = [(-12, 8, 1, 1.0), (-6, 6, 2, 0.875), (-5, 4, 1, 0.5833), (-3, 1, 1, 0.4375)]
    for (v, n, e, f), (ev, en, ee, ef) in zip(t, exp):
        assert v == ev and n == en and e == ee and f == pytest.approx(ef, abs=1e-4)
    s = summ.first()
    assert s["mean"] == pytest.approx(-5.292, abs=1e-3) and s["variance"] == pytest.approx(9.236, abs=1e-3)
