"""Censored Kendall tau-b: worked example and brute force over random censored data with ties, several blocks."""

import math

import numpy as np
import pandas as pd
import pytest

from assayflow.operators.kendall import kendall_tau_b


def _gt(a, ma, b, mb):
    return ma == "=" and (b < a or (b == a and mb == "<"))


def _brute(rows):
    s = tx = ty = 0
    n = len(rows)
    for i in range(n):
        for j in range(i + 1, n):
            xi, mxi, yi, myi = rows[i]
            xj, mxj, yj, myj = rows[j]
            dx = 1 if _gt(xi, mxi, xj, mxj) else (-1 if _gt(xj, mxj, xi, mxi) else 0)
            dy = 1 if _gt(yi, myi, yj, myj) else (-1 if _gt(yj, myj, yi, myi) else 0)
            tx += dx != 0
            ty += dy != 0
            s += dx * dy
    return s / math.sqrt(tx * ty)


def test_worked_example(spark):
    rows = [(5.0, "=", 1.0, "="), (4.0, "<", 2.0, "<"), (3.0, "<", 3.0, "="), (2.0, "=", 2.0, "="), (6.0, "=", 4.0, "<")]
    df = spark.createDataFrame([("g",) + r for r in rows], "g string, x double, mx string, y double, my string")
    r = kendall_tau_b(df, ["g"], "x", "mx", "y", "my").first()
    assert r["tau_b"] == pytest.approx(-0.338, abs=1e-3)


@pytest.mark.parametrize("bits", [1, 4])
def test_random_censored_against_brute_force(spark, bits):
    rng = np.random.default_rng(11)
    recs = []
    for g, n in (("hot", 300), ("cold", 40)):
        x = rng.integers(0, 25, n).astype(float)
        y = (x + rng.integers(-8, 8, n)).astype(float)
        mx = np.where(rng.random(n) < 0.2, "<", "=")
        my = np.where(rng.random(n) < 0.2, "<", "=")
        recs += [(g, float(a), str(b), float(c), str(d)) for a, b, c, d in zip(x, mx, y, my)]
    pdf = pd.DataFrame(recs, columns=["g", "x", "mx", "y", "my"])
    sdf = spark.createDataFrame(recs, "g string, x double, mx string, y double, my string")
    got = {r["g"]: r["tau_b"] for r in kendall_tau_b(sdf, ["g"], "x", "mx", "y", "my", digit_bits=bits).collect()}
    for g, sub in pdf.groupby("g"):
        assert got[g] == pytest.approx(_brute(list(sub[["x", "mx", "y", "my"]].itertuples(index=False))), abs=1e-12)


def test_right_censoring_by_negation(spark):
    rows = [(1.0, "=", 2.0, "="), (2.0, ">", 1.0, "="), (3.0, "=", 5.0, "="), (3.0, ">", 4.0, "=")]
    df = spark.createDataFrame([("g",) + r for r in rows], "g string, x double, mx string, y double, my string")
    neg = [(-x, "<" if m == ">" else m, y, my) for x, m, y, my in rows]
    r = kendall_tau_b(df, ["g"], "x", "mx", "y", "my").first()["tau_b"]
    assert r == pytest.approx(-_brute(neg))
