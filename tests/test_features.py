"""Feature transformers: scaling forms, folding, hashing."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assayflow.operators import features as FT


def test_standard_scale_population_sd(spark):
    df = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(5)], "id int, a array<double>")
    out = FT.standard_scale(df, "a", "z", center=True).orderBy("id").toPandas()
    x = np.arange(5.0)
    exp = (x - x.mean()) / x.std(ddof=0)
    assert np.allclose([r[0] for r in out["z"]], exp)
    assert [r[1] for r in out["z"]] == [0.0] * 5  # constant position: sd 0 -> centred, not divided


def test_minmax_constant_maps_to_min(spark):
    df = spark.createDataFrame([(i, [float(i), 3.0]) for i in range(3)], "id int, a array<double>")
    out = FT.minmax_scale(df, "a", "z", lo=-1.0, hi=1.0).orderBy("id").toPandas()
    assert [r[1] for r in out["z"]] == [-1.0] * 3
    assert [r[0] for r in out["z"]] == [-1.0, 0.0, 1.0]


def test_fold_dense_and_positive_check(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "a array<double>")
    assert df.select(FT.fold_dense("a", 2)).first()[0] == [9.0, 6.0]
    neg = spark.createDataFrame([([1.0, -5.0],)], "a array<double>")
    with pytest.raises(Exception):
        neg.select(FT.fold_dense("a", 1)).collect()


def test_fingerprint_hash_matches_xxh64(spark):
    df = spark.createDataFrame([(1, "abcdab")], "id int, text string")
    fp = {r["idx"]: r["val"] for r in FT.fingerprint(df, "id", "text", n=2, size=64).collect()}
    exp = {}
    for i in range(5):
        h = xxhash.xxh64("abcdab"[i:i + 2].encode(), seed=42).intdigest()
        signed = h - (1 << 64) if h >= (1 << 63) else h
        exp[signed % 64] = exp.get(signed % 64, 0) + 1
    assert fp == exp


def test_drop_constant_positions(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, float(-i)]) for i in range(4)], "id int, a array<double>")
    out = FT.drop_constant(df, "a", "k").orderBy("id").toPandas()
    assert [list(r) for r in out["k"]] == [[0.0, 0.0], [1.0, -1.0], [2.0, -2.0], [3.0, -3.0]]


def test_drop_constant_sparse(spark):
    # index 0 varies, index 5 is 2.0 everywhere (constant), index 9 appears in one of three rows (varies via implicit zeros)
    rows = [(1, 0, 1.0), (1, 5, 2.0), (2, 0, 3.0), (2, 5, 2.0), (3, 5, 2.0), (3, 9, 4.0)]
    long = spark.createDataFrame(rows, "id int, idx int, val double")
    out = FT.drop_constant_sparse(long, "id", "idx", "val", F.lit(3)).orderBy("id", "idx").collect()
    assert [(r["id"], r["idx"], r["val"]) for r in out] == [(1, 0, 1.0), (2, 0, 3.0), (3, 1, 4.0)]


def test_standard_scaling_gives_zero_mean_unit_sd(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    z = FT.standard_scale(e, "a", "z", center=True)
    st = FT.vector_stats(z, "z").toPandas()
    assert np.allclose(st["mean"], 0.0, atol=1e-12) and np.allclose(st["sd"], 1.0, atol=1e-9)


def test_word_vectors_keep_every_word(spark):
    n = 270_000  # more than CountVectorizer keeps unless told otherwise
    docs = spark.range(300).select(F.col("id").alias("no"), F.expr(f"transform(sequence(id * {n // 300}, id * {n // 300} + {n // 300 - 1}), x -> concat('w', x))").alias("tokens"))
    docs = docs.union(spark.createDataFrame([(1000, ["w5", "w5", "w269999"]), (1001, []), (1002, None)], "no long, tokens array<string>"))
    got = {r["no"]: r["features"] for r in FT.word_vectors(docs, "no", "tokens").select("no", "features").collect()}
    assert len(got) == 303 and {v.size for v in got.values()} == {n}
    assert all(got[i].values.tolist() == [1.0] * (n // 300) for i in range(300))
    assert sorted(got[1000].values) == [1.0, 2.0] and got[1001].numNonzeros() == got[1002].numNonzeros() == 0
    assert len(set().union(*(got[i].indices.tolist() for i in range(300)))) == n


def test_base_table_fails_on_an_empty_field_whichever_columns_are_read(spark):
    long = spark.createDataFrame([(1, "t", "a", "x", 1.0), (1, "t", "b", None, None)], "key long, title string, response string, raw string, value double")
    assert FT.base_table(long, "key", "title", ["a"]).select("key", "a").collect() == [(1, "x")]
    with pytest.raises(Exception, match="recipe field b has no values"):
        FT.base_table(long, "key", "title", ["a", "b"]).select("key", "a").collect()
