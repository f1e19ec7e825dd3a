"""Sources/sinks round trips and the readout builder's replicate rules on small fixtures."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from assayflow.operators import readouts as RD
from assayflow.session import scratch_dir
from assayflow.sources import tables as IO


def test_typed_csv_round_trip_with_vectors(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.5, [1.0, 2.5], (10, [1, 3], [0.5, 2.0])), (2, None, None, [0.0], (10, [], []))],
        "no int, name string, v double, d array<double>, s struct<length:int,indices:array<int>,values:array<double>>",
    )
    path = scratch_dir(spark, "t-typed")
    IO.write_typed_csv(df, path, gzip=True)
    header = spark.read.text(path).first()[0]
    assert header == "no [Int],name [String],v [Double],d [DenseVector],s [SparseVector]"
    back = IO.read_typed_csv(spark, path).orderBy("no").collect()
    assert back[0]["d"] == [1.0, 2.5] and back[0]["s"]["indices"] == [1, 3] and back[0]["s"]["values"] == [0.5, 2.0]
    assert back[1]["name"] is None and back[1]["v"] is None and back[1]["s"]["indices"] == []


def test_unknown_header_type_is_an_error():
    with pytest.raises(ValueError):
        IO.parse_header("x [Matrix]")


def test_records_and_fields(spark):
    path = scratch_dir(spark, "t-rec")
    df = spark.createDataFrame([("m1", "3", "x"), ("m2", None, "4.5"), ("m3", "7", "y")], "title string, a string, b string")
    IO.write_records(df, path, "title", ["a", "b"])
    r = IO.read_records(spark, path)
    rows = {x["title"]: x["fields"] for x in r.collect()}
    assert rows["m1"] == {"a": "3", "b": "x"} and rows["m2"]["a"] is None
    f = {x["field"]: (x["present"], x["n_numeric"], x["numeric"]) for x in IO.record_fields(r).collect()}
    assert f["a"] == (2, 2, True) and f["b"] == (3, 1, True)


def test_smiles_lines_require_two_terms(spark):
    path = scratch_dir(spark, "t-smi")
    spark.createDataFrame([("CCO 1",), ("bad line here",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception):
        IO.read_smiles_lines(spark, path).collect()


def test_collapse_censored_rules(spark):
    rows = [("a", 2.0, "="), ("a", 8.0, "="), ("a", 100.0, ">"),  # exact readings win: mean 5, mean log10
            ("b", 3.0, ">"), ("b", 9.0, ">="),                       # only '>' -> max
            ("c", 4.0, "<"), ("c", 1.0, "<=")]                       # only '<' -> min
    df = spark.createDataFrame(rows, "k string, value double, modifier string")
    out = {r["k"]: r for r in RD.collapse_censored(df, ["k"]).collect()}
    assert out["a"]["modifier"] == "=" and out["a"]["value"] == 5.0
    assert out["a"]["log_value"] == pytest.approx((math.log10(2) + math.log10(8)) / 2)
    assert out["b"]["modifier"] == ">" and out["b"]["value"] == 9.0
    assert out["c"]["modifier"] == "<" and out["c"]["value"] == 1.0
    mixed = spark.createDataFrame([("d", 1.0, "<"), ("d", 2.0, ">")], "k string, value double, modifier string")
    with pytest.raises(Exception):
        RD.collapse_censored(mixed, ["k"]).collect()


def test_decode_readouts_rejects_unknown_keys(spark):
    ok = spark.createDataFrame([(1, '{"1": {"value": "2.5", "modifier": ">"}, "2": "kinase"}')], "row long, readouts string")
    d = {r["definition"]: r for r in RD.decode_readouts(ok).collect()}
    assert d["1"]["value_num"] == 2.5 and d["1"]["modifier"] == ">" and d["2"]["modifier"] == "="
    bad = spark.createDataFrame([(1, '{"1": {"value": "2.5", "colour": "red"}}')], "row long, readouts string")
    with pytest.raises(Exception):
        RD.decode_readouts(bad).collect()


def test_record_blocks_keep_all_their_lines(spark, tmp_path):
    rows = [("", "first\nsecond", None), ("t2", "one", "x"), ("t3", None, "a\r\nb")]
    path = str(tmp_path / "records")
    IO.write_records(spark.createDataFrame(rows, "title string, a string, b string"), path, "title", ["a", "b"])
    got = {r["title"]: r["fields"] for r in IO.read_records(spark, path).collect()}
    assert got == {"": {"a": "first\nsecond", "b": None}, "t2": {"a": "one", "b": "x"}, "t3": {"a": None, "b": "a\nb"}}


def test_a_text_field_is_refused_as_a_number(spark):
    from assayflow.sources import tables as IO

    r = spark.createDataFrame([(f"t{i}", {"size": str(i), "kind": "x"}) for i in range(30)], "title string, fields map<string,string>")
    assert r.select(IO.field_column(r, "size", numeric=True).alias("v")).agg({"v": "sum"}).first()[0] == 435.0
    try:
        r.select(IO.field_column(r, "kind", numeric=True).alias("v")).collect()
    except Exception as refused:  # noqa: BLE001
        assert "is not numeric" in str(refused)
    else:
        raise AssertionError("a text field was read as a number")


def test_quoted_text_with_line_breaks_comes_back(spark, tmp_path):
    from assayflow.sources import tables as IO

    rows = [(1, 'two\nlines, "quoted"', 0.5), (2, "back\\slash", None), (3, None, 1.0), (4, '"', 2.0)]
    df = spark.createDataFrame(rows, "id int, note string, x double")
    IO.write_typed_csv(df, str(tmp_path / "t"), gzip=True)
    assert sorted(map(tuple, IO.read_typed_csv(spark, str(tmp_path / "t")).collect())) == rows
    big = spark.range(5)
    IO.write_single_csv(big, str(tmp_path / "one"))


def test_a_large_table_is_no_single_file(spark, tmp_path, monkeypatch):
    import pytest

    from assayflow.sources import tables as IO

    monkeypatch.setattr(IO, "SINGLE_CSV_ROWS", 3)
    with pytest.raises(ValueError):
        IO.write_single_csv(spark.range(5), str(tmp_path / "many"))
