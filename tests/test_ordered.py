"""Range-partitioned running sums, positions and average ranks against brute force, including a hot group."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from assayflow.operators.ordered import add_position, average_rank, neighbours, running_sums


def _frame(spark):
    rng = np.random.default_rng(7)
    n = 3000
    # one group holds two thirds of the rows (skew), values with ties
    g = np.where(rng.random(n) < 0.66, "hot", rng.choice(["a", "b", "c"], n))
    v = rng.integers(0, 200, n).astype(float)
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "w": rng.random(n)})
    return pdf, spark.createDataFrame(pdf)


def test_running_sums_match_pandas(spark):
    pdf, df = _frame(spark)
    out = running_sums(df, ["g"], ["v", "id"], ["w"], ["cw"], num_partitions=7).toPandas().set_index("id").sort_index()
    exp = pdf.sort_values(["g", "v", "id"]).groupby("g")["w"].cumsum().sort_index()
    assert np.allclose(out["cw"].values, exp.values)


def test_positions_dense_per_group(spark):
    pdf, df = _frame(spark)
    out = add_position(df, [F.col("v").desc(), F.col("id").asc()], ["g"], "pos", num_partitions=5).toPandas()
    exp = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True]).assign(pos=lambda d: d.groupby("g").cumcount())
    m = out.merge(exp[["id", "pos"]], on="id")
    assert (m.pos_x == m.pos_y).all()


def test_average_rank_ties(spark):
    pdf, df = _frame(spark)
    out = average_rank(df, ["g"], "v", "r").toPandas().set_index("id").sort_index()
    exp = pdf.groupby("g")["v"].rank(method="average").sort_index()
    assert np.allclose(out["r"].values, exp.values)


def test_neighbours_by_position(spark):
    df = spark.createDataFrame([(g, i, float(i * 10)) for g in "xy" for i in range(5)], "g string, pos long, x double")
    n = neighbours(df, ["g"], "pos", ["x"], offset=1).toPandas().sort_values(["g", "pos"])
    assert list(n["next_x"][:4]) == [10.0, 20.0, 30.0, 40.0]
    assert np.isnan(n["next_x"].iloc[4])
