"""What only larger tables bring up: rare combinations, tables without any model, one block too many."""

import duckdb
import pytest

import __spark_entry__ as E


def _oracle(name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con.sql(E.oracle_sql()[name])


def test_data_table_with_a_mixed_censored_molecule(spark, tmp_path):
    rows = [(i, i % 150, "view", 2.0 + i, '{"k": 7}') for i in range(1, 300) if i % 150]
    rows += [(900, 0, "view", 0.5, '{"k": 7}'), (901, 0, "view", 400.0, '{"k": 7}'), (902, 0, "view", 350.0, '{"k": 7}')]  # '<' and '>' only
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(150).selectExpr("id AS c_custkey", "double(id) AS c_acctbal", "int(id % 25) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("rd_data_table", "rd_all_tables", "rd_regression_table"):
        want = _oracle(name, tmp_path, ["events", "customer"])
        got = E.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
    mixed = [r for r in E.queries()["rd_data_table"](spark, str(tmp_path)).collect() if r["molecule"] == 0]
    assert [(r["modifier"], r["label"]) for r in mixed] == [(">", 400.0)]


def _documents(spark, folder, quality):
    """Tables (lang, source) whose documents have 10, 20, ... characters and the given qualities, in that order."""
    docs, labels = [], []
    for (lang, source), marks in quality.items():
        for i, q in enumerate(marks):
            docs.append((len(docs), "x" * (10 + 10 * i), lang, source, 10 + 10 * i))
            labels.append((len(labels), q, 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("good", [0, 1])
def test_chooser_with_hardly_any_table_above_the_cut(spark, tmp_path, good):
    tables = {("en", "a"): [1, 0, 0, 1], ("en", "b"): [1, 1, 0, 0]}  # AUC 0.5 and 0
    if good:
        tables["en", "c"] = [0, 0, 1, 1]
    _documents(spark, tmp_path, tables)
    bad = {r["source"]: r["category"] for r in E.queries()["lab_bad_category"](spark, str(tmp_path)).collect()}
    assert bad["a"] == bad["b"] == "Bad" and len(bad) == 2 + good and bad.get("c") != "Bad"
    chosen = E.queries()["rd_task_model"](spark, str(tmp_path))
    assert chosen.columns == ["id", "lang", "source", "p_rf", "p_svm", "prediction"]
    assert [r["id"] for r in chosen.collect()] == ["en/c"] * good


def test_language_model_learns_from_every_triple():
    pytest.importorskip("assayflow.llm.language_model")
    import numpy as np

    from assayflow.llm.language_model import train

    unigram = np.full(8, 1 / 8)
    codes, counts = np.array([(1 * 8 + 2) * 8 + 3, (5 * 8 + 6) * 8 + 7]), np.array([10**9, 1])  # a draw would miss the second
    before, after = train(codes, counts, unigram, steps=0), train(codes, counts, unigram)
    assert (np.abs(after["context"] - before["context"])[[1, 2, 5, 6]].max(1) > 1e-6).all()
    assert (after["context"][[0, 3, 4, 7]] == before["context"][[0, 3, 4, 7]]).all()


@pytest.mark.parametrize("name", ["join_profile", "join_nearest_sim"])
def test_words_of_a_bounded_text_in_a_task(spark, monkeypatch, name):
    from pyspark.sql import functions as F

    from assayflow.operators import joins as J
    from assayflow.operators.features import word_split

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(J, "TASK_CHARS", 50_000)
    parts = J.postings(docs, "doc_id", word_split(F.col("text")), chars=F.length("text")).rdd.getNumPartitions()
    assert parts == -(-docs.agg(F.sum(F.length("text"))).first()[0] // 50_000) > 20
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    want = con.sql(E.oracle_sql()[name])
    got = E.queries()[name](spark, "/root/testdata/sf0.01").select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
