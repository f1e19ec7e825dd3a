"""What the plans promise: no row sorts, no shuffles of the rows for group statistics, ties that travel as one, proven copies."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayflow.functions import scalar as S
from assayflow.operators import ordered as O
from assayflow.operators import readouts as RD
from assayflow.operators import stats as ST
from assayflow.operators import summaries as SM
from assayflow.operators.kendall import kendall_tau_b
from assayflow.sources import tables as IO


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(n=4000, seed=5):
    """A hot group with two thirds of the rows, nine in ten of them one value; heavy tails, and a group of one row."""
    rng = random.Random(seed)
    out = [("hot", 7.0 if rng.random() < 0.9 else rng.gauss(0, 1) * 10 ** rng.randint(0, 6)) for _ in range(2 * n // 3)]
    return out + [("cold", float(rng.randint(0, 9))) for _ in range(n // 3)] + [("one", 3.5), ("same", 2.0), ("same", 2.0), ("none", None)]


@pytest.mark.parametrize("method", ["n+1", "n-1"])
@pytest.mark.parametrize("plain", [0, 20_000])
def test_percentiles_with_ties_and_tails(spark, monkeypatch, method, plain):
    monkeypatch.setattr(O, "PLAIN_ROWS", plain)
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    ps = [0.0, 5.0, 33.3, 50.0, 90.0, 99.9, 100.0]
    got = SM.percentiles(df, ["g"], "x", ps, method)
    assert "Python" not in physical(got) and "Checkpoint" not in physical(got)
    for r in got.collect():
        v = sorted(x for g, x in rows if g == r["g"] and x is not None)
        for p, have in zip(ps, r[1:]):
            t = p / 100 * (len(v) + 1) if method == "n+1" else 1 + p / 100 * (len(v) - 1)
            want = v[0] if t < 1 else v[-1] if t >= len(v) else v[int(t) - 1] + (t - int(t)) * (v[int(t)] - v[int(t) - 1])
            assert have == pytest.approx(want, rel=1e-12), (r["g"], p)


def test_percentiles_count_values_before_they_travel(spark):
    df = spark.createDataFrame(rows_of(), "g string, x double").repartition(5)
    got = SM.percentiles(df, [], "x", [50.0], names=["m"])
    assert got.first()["m"] == 7.0
    whole = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (float("-inf"),), (2.0,)], "x double")
    assert SM.percentiles(whole, [], "x", [50.0], "n-1", names=["m"]).first()["m"] == 2.0


def test_running_sums_have_one_shuffle_of_the_rows_and_no_checkpoint(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("g"), F.xxhash64("id").alias("v"))
    out = O.running_sums(df, ["g"], [O.Down("v"), "id"], ["id"], ["c"], num_partitions=16)
    assert plan_of(out).count("Window [") == 2 and "LogicalRDD" not in plan_of(out)  # the rows, and the bucket totals
    want = {}
    sums = {}
    for r in sorted(df.collect(), key=lambda r: (r["g"], -r["v"], r["id"])):
        sums[r["g"]] = sums.get(r["g"], 0) + r["id"]
        want[r["id"]] = sums[r["g"]]
    assert {r["id"]: r["c"] for r in out.collect()} == want


def test_columns_may_have_any_names(spark):
    names = ["__b", "__n", "__v0", "__k0", "__o0", "__loc0", "__before", "__row"]
    df = spark.createDataFrame([(i % 3, float(i * 7 % 50), *[i] * 8) for i in range(300)], "g long, x double, " + ", ".join(f"{n} long" for n in names))
    for parts in (None, 8):
        out = O.running_sums(df, ["g"], ["x", "__b"], ["__n", "__v0"], ["a", "b"], num_partitions=parts)
        assert out.columns == [*df.columns, "a", "b"] and out.filter("a <> b").isEmpty() and out.agg(F.max("a")).first()[0] == 15050


def test_order_keys_of_all_kinds(spark):
    rows = [(i, [None, "b", "a", "b"][i % 4], [1.5, None, float("nan"), -2.0, 0.0][i % 5], i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s string, d double, f boolean").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 11).cast("int"))).withColumn(
        "at", F.timestamp_micros(F.col("id") % 13 * 1_000_003))
    for order, keys in (
        ([O.Down("d"), "s", "id"], [F.col("d").desc_nulls_last(), F.col("s"), F.col("id")]),
        ([O.Down("s"), O.Down("id")], [F.col("s").desc_nulls_last(), F.col("id").desc()]),
        ([F.col("day").desc(), O.Down("f"), "id"], [F.col("day").desc(), F.col("f").desc(), F.col("id")]),
        ([O.Down("at"), F.col("d").asc_nulls_last(), "id"], [F.col("at").desc(), F.col("d").asc_nulls_last(), F.col("id")]),
    ):
        want = {r["id"]: k for k, r in enumerate(df.orderBy(*keys).collect())}
        for parts in (None, 9):
            assert {r["id"]: r["pos"] for r in O.add_position(df, order, num_partitions=parts).collect()} == want


def test_group_statistics_leave_the_rows_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, f"g{i % 5}", float(i % 17)) for i in range(500)], "id long, g string, x double")
        for out in (ST.normalize_range(df, ["g"], "x", "z"), O.average_rank(df, ["g"], "x", "r")):
            assert "Exchange hash" not in physical(out) and "BroadcastHashJoin" in physical(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_statistics_beyond_the_broadcast_bound_are_salted(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 50 == 0 else f"g{i % 5}", float(i % 17)) for i in range(500)], "id long, g string, x double")
    small = sorted(map(tuple, ST.normalize_range(df, ["g"], "x", "z").collect()), key=str)
    monkeypatch.setattr(O, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, ST.normalize_range(df, ["g"], "x", "z").collect()), key=str) == small


def test_tau_of_a_group_censored_at_one_value(spark):
    rng = random.Random(8)
    rows = [(1.0, "<") if rng.random() < 0.9 else (float(rng.randint(2, 30)), "=") for _ in range(400)]
    rows = [("g", x, mx, float(rng.randint(0, 5)), "=") for x, mx in rows]
    got = kendall_tau_b(spark.createDataFrame(rows, "g string, x double, mx string, y double, my string"), ["g"], "x", "mx", "y", "my")
    assert "Python" not in physical(got) and "Pandas" not in physical(got)
    over = lambda a, ma, b, mb: ma == "=" and (b < a or b == a and mb == "<")
    c = d = nx = ny = 0
    for i, (_, xi, mi, yi, ni) in enumerate(rows):
        for _, xj, mj, yj, nj in rows[:i]:
            sx, sy = over(xi, mi, xj, mj) - over(xj, mj, xi, mi), over(yi, ni, yj, nj) - over(yj, nj, yi, ni)
            c, d, nx, ny = c + (sx * sy > 0), d + (sx * sy < 0), nx + (sx != 0), ny + (sy != 0)
    r = got.first()
    assert (r["n"], r["concordant"], r["discordant"]) == (400, c, d) and r["tau_b"] == pytest.approx((c - d) / math.sqrt(nx * ny))


def test_only_proven_copies_of_splits_go(spark):
    members = spark.createDataFrame([(k, i) for k, ids in (("a", (1, 2)), ("b", (1, 2)), ("c", (3, 4)), ("d", (3, 4)), ("e", (1, 4))) for i in ids], "table_key string, row long")
    sig = spark.createDataFrame([("p", k, 2, 0, 0) for k in "abcde"], "protocol string, table_key string, __n long, __h1 long, __h2 long")  # all signatures clash
    assert sorted(r["table_key"] for r in RD._proven_copies(members, sig, "protocol", "row").collect()) == ["b", "d"]


@pytest.mark.parametrize("t, dof, p", [(0.0, 5, 1.0), (1.0, 1, 0.5), (2.0, 10, 0.07338803), (-2.0, 10, 0.07338803), (12.0, 30, 5.3e-13), (1.96, 100_000, 0.0499978), (0.01, 3, 0.9926494)])
def test_p_value_of_students_t(spark, t, dof, p):
    got = spark.range(1).select(S.t_two_sided(F.lit(t), F.lit(dof)).alias("p")).first()["p"]
    assert got == pytest.approx(p, rel=2e-5 if p > 1e-9 else 0.1)


def test_recipe_rows_count_for_their_own_file(spark):
    records = spark.createDataFrame([(1, {"a": "x", "b": "5"}, "one"), (2, {"a": "y", "b": "7"}, "two")], "key long, fields map<string,string>, file string")
    recipe = spark.createDataFrame([("one", "a", "categorical", None), ("two", "b", "continuous", "none")], "file string, response string, category string, transform string")
    assert sorted((r["key"], r["response"]) for r in IO.apply_recipe(records, "key", recipe).collect()) == [(1, "a"), (2, "b")]
    assert sorted((r["key"], r["response"]) for r in IO.apply_recipe(records.drop("file"), "key", recipe, "one").collect()) == [(1, "a"), (2, "a")]
    with pytest.raises(ValueError):
        IO.apply_recipe(records.drop("file"), "key", recipe)


def test_consensus_weights_come_from_rows_the_models_have_not_seen(spark, tmp_path):
    from assayflow.operators import cv as CV
    from assayflow.operators import models as MD
    from assayflow.operators.consensus import ConsensusClassifier, ConsensusModel
    from assayflow.operators.features import to_ml_vector

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    d = spark.createDataFrame([(i, a.tolist(), float(a[0] + 0.3 * rng.normal() > 0)) for i, a in enumerate(x)], "no long, a array<double>, label double")
    d = CV.add_folds(d.withColumn("features", to_ml_vector("a")), ["no"], 3)
    noise = MD.estimator("logistic", maxIter=10, regParam=1000.0, elasticNetParam=1.0)  # a constant: the worst model
    est = ConsensusClassifier({"good": MD.estimator("logistic", maxIter=10), "tree": MD.estimator("dt_class", maxDepth=3), "flat": noise}, 3)
    model = est.fit(d)
    assert sorted(model.names) == ["good", "tree"] and all(0.8 < w <= 1.0 for w in model.weights)
    model.write().overwrite().save(str(tmp_path / "c"))
    again = ConsensusModel.load(str(tmp_path / "c"))
    a, b = ({r["no"]: (r["probability"], r["prediction"]) for r in m.transform(d).collect()} for m in (model, again))
    assert a == b and again.cutoff == model.cutoff
    parts = [m.transform(d).select("no", MD.probability_of_positive().alias("p")).collect() for m in model.models]
    for rows in zip(*[sorted(p) for p in parts]):
        total = sum(w * r["p"] for w, r in zip(model.weights, rows))
        assert a[rows[0]["no"]] == (pytest.approx(total), float(total > model.cutoff))


def test_spearman_counts_both_columns_from_the_rows_as_they_came(spark, monkeypatch):
    from assayflow.operators import metrics as MT

    rows = [(f"g{i % 3}", float(i * 7 % 50), float(i * i % 31)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    plans, kept = [], O.materialize
    monkeypatch.setattr(O, "materialize", lambda frame: plans.append(frame._jdf.queryExecution().optimizedPlan().toString()) or kept(frame))
    got = {r["g"]: r["spearman"] for r in MT.spearman(df, ["g"], "y", "p").collect()}
    assert len(plans) == 4 and not any("Join" in p for p in plans)  # no ranks joined to the rows only to count them
    frame = pd.DataFrame(rows, columns=["g", "y", "p"])
    for g, part in frame.groupby("g"):
        assert abs(got[g] - part["y"].rank().corr(part["p"].rank())) < 1e-9
