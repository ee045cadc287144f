"""Micro-frames for the row-level semantics."""

import datetime as dt

from pyspark.sql import functions as F

from visitgrid import columns as C
from visitgrid.functions import text as X
from visitgrid.functions.core import cut, floor_days, general_format
from visitgrid.operators import cleanse as K


def col(df, name):
    return [r[name] for r in df.select(name).collect()]


def test_status_filter_keeps_null(spark):
    df = spark.createDataFrame([("Cancelled",), ("Planned",), (None,)], "umr_status string")
    assert sorted(map(str, col(K.filter_not_status(df), "umr_status"))) == ["None", "Planned"]


def test_package_normalisation(spark):
    df = spark.createDataFrame([("B, A",), ("A,B",), ("A, A",), (None,)], "umr_art string")
    assert col(K.normalize_package(df), "umr_art") == ["A, B", "A, B", "A, A", None]


def test_blank_filter(spark):
    rows = [("A",), ("",), ("  ",), ("nan",), ("<NA>",), (None,)]
    df = spark.createDataFrame(rows, "umr_art string")
    assert col(K.filter_blank_package(df), "umr_art") == ["A"]
    both = K.normalize_package(K.filter_blank_package(df))
    other = K.filter_blank_package(K.normalize_package(df))
    assert both.collect() == other.collect()


def test_join_key_orders(spark):
    df = spark.createDataFrame(
        [("A1", "B1", "V1"), ("", "B2", "V2"), ("0", "0.0", "V3"), ("nan", None, "")],
        "at_nummer string, bt_nummer string, v_nummer string")
    assert col(K.coalesce_join_key(df), C.JOIN_KEY) == ["A1", "B2", "V3", None]
    effective = K.coalesce_join_key(df, C.KEY_CHAIN_EFFECTIVE)
    assert col(effective, C.JOIN_KEY) == ["V1", "V2", "V3", None]
    used = {r["key_column"]: r["n"] for r in K.join_key_usage(df).collect()}
    assert used == {"at_nummer": 1, "bt_nummer": 1, "v_nummer": 1, "none": 1}


def test_dates_and_floor_days(spark):
    df = spark.createDataFrame([("garbage",), (None,), ("2020-01-02 12:00:00",)], "d string")
    out = col(K.parse_dates(df, ["d"]), "d")
    assert out[:2] == [None, None] and out[2] == dt.datetime(2020, 1, 2, 12)
    two = spark.createDataFrame([("2020-01-01 12:00:00", "2020-01-02 00:00:00"),
                                 ("2020-01-02 12:00:00", "2020-01-01 00:00:00")], "a string, b string")
    two = two.select(F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    assert [r[0] for r in two.select(floor_days("a", "b")).collect()] == [-1, 1]


def test_cut_edges(spark):
    df = spark.createDataFrame([(-999.0,), (-998.0,), (0.0,), (3.0,), (24.0,), (999.0,), (1000.0,), (None,)], "v double")
    got = [r[0] for r in df.select(cut("v", K.READY_EDGES, K.READY_LABELS)).collect()]
    assert got == [None, "done", "done", "0-3m", "12-24m", "24m+", None, None]


def test_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([("x",)], "derivat string")
    for op in (K.age_buckets, K.recency_flags, K.category_cross, K.numeric_interactions, K.lead_time_bucket):
        assert op(df).columns == ["derivat"]
    assert K.deadline_features(df, "2020-01-01 00:00:00").columns == ["derivat"]


def test_general_format_matches_percent_g(spark):
    values = [0.0, 1.0, 12345.0, 1234.5, 0.05, 0.00001234, 99999.0, -3.25, 100.0, 1e10]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(general_format("v")).collect()]
    assert got == ["%.4g" % v for v in values]


def test_text_round_trip(spark):
    df = spark.createDataFrame([(1.5, "x", None, float("nan"))], "a double, b string, c double, d double")
    t = df.select(X.row_to_text(df, ["a", "b", "c", "d"]).alias("t"), X.row_to_lines(df, ["a", "b"]).alias("l"))
    row = t.withColumn("u", X.text_to_lines(F.col("t"))).first()
    assert row["t"] == "a=1.5; b=x; c=NA; d=NA"
    assert row["l"] == "  a = 1.5\n  b = x"
    assert row["u"].startswith("  a = 1.5\n  b = x\n  c = NA")


def test_answers(spark):
    rows = [('```json\n{"probability": 1.7, "prediction": 1}\n```',), ("oops",), ('{"probability": 0.2, "prediction": 0}',)]
    df = spark.createDataFrame(rows, "t string")
    c = X.parse_binary_answer(F.col("t"))
    got = [(r[0], r[1]) for r in df.select(c["probability"], c["prediction"]).collect()]
    assert got == [(1.0, 1), (0.5, 0), (0.2, 0)]
    nums = spark.createDataFrame([("[1, 2, 3, 4]",), ("see [1.5, 2e1] ok",), ("1 then 2 then 3",), ("1 only",)], "t string")
    assert [r[0] for r in nums.select(X.parse_number_list(F.col("t"), 2)).collect()] == [
        [1.0, 2.0], [1.5, 20.0], [1.0, 2.0], None]
    many = spark.createDataFrame([('{"predictions": {"a": 1, "b": 3}}',), ("x",)], "t string")
    assert [r[0] for r in many.select(X.parse_class_answer(F.col("t"), ["a", "b"])).collect()] == [[0.25, 0.75], [0.5, 0.5]]


def test_select_features(spark):
    df = spark.createDataFrame([("a", "a", 1, 2.0, "k")], "x string, x_clean string, y int, z double, at_nummer_clean string")
    assert K.select_features(df, "y") == (["x_clean"], ["z"])
