"""Conversion rules on edge values."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions import convert as cv
from keelson.functions import types as ty

S, D, L, I, B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
DAY0 = "0001-01-01"


def values(spark, inputs, dtype, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], T.StructType([T.StructField("i", I), T.StructField("c", dtype)]))
    return [r[0] for r in df.select(build(F.col("c")).alias("v"), "i").orderBy("i").select("v").collect()]


def check(spark, canonical, dtype, pairs, as_text=False):
    def build(c):
        out = cv.to_canonical(c, dtype, canonical)
        return out.cast("string") if as_text else out
    assert values(spark, [a for a, _ in pairs], dtype, build) == [b for _, b in pairs]


def test_boolean(spark):
    check(spark, ty.BOOLEAN, S, [("1", True), ("-1", True), ("true", True), ("YES", True), ("t", True), (".T.", True), ("0", False),
                                 ("y", False), ("on", False), (" true", False), ("", False), (None, None)])
    check(spark, ty.BOOLEAN, D, [(-1.0, True), (2.0, True), (0.5, True), (0.0, False), (None, None)])
    check(spark, ty.BOOLEAN, T.DateType(), [(datetime.date(2020, 1, 1), False), (None, None)])


def test_int32(spark):
    check(spark, ty.INT32, L, [(3000000000, 2147483647), (-3000000000, -2147483648), (7, 7), (None, None)])
    check(spark, ty.INT32, B, [(True, 1), (False, 0)])
    check(spark, ty.INT32, S, [
        ("x", 0), (" 12 ", 12), ("1,234", 1234), ("(5)", -5), ("5-", -5), ("1.0", 1), ("1e3", 1000), ("1.5", 0), ("99999999999", 0),
        ("-5-", 0), ("- 5", 0), ("(5 )", -5), ("5 -", -5), (".5", 0), ("5.", 5), (".", 0), ("1e", 0), ("(-5)", 0), ("+7", 7), ("", 0),
        ("¤5", 5), ("-¤5", -5), ("1e-3", 0), (None, None)])
    check(spark, ty.INT32, D, [(2.5, 2), (3.5, 4), (-2.5, -2), (3e9, None)])


def test_int64_double_decimal(spark):
    check(spark, ty.INT64, S, [("3000000000", 3000000000), ("x", 0), ("9223372036854775807", 2**63 - 1), ("1.00000000001", 0)])
    check(spark, ty.DOUBLE, S, [("1.5", 1.5), ("1,5", 15.0), ("1,234.5", 1234.5), ("x", 0.0), ("1d", 0.0), ("Infinity", float("inf"))])
    check(spark, ty.DECIMAL, S, [("1.5", Decimal("1.5")), ("1,5", Decimal(15)), ("x", Decimal(0)), ("9e28", Decimal(0)), ("7e28", None)])
    check(spark, ty.DECIMAL, D, [(0.1 + 0.2, Decimal("0.3")), (12345678.123456789, Decimal("12345678.1234568")), (1e27, Decimal(10) ** 27), (1e30, None)])


def test_decimal_comma_is_a_parameter(spark):
    build = lambda c: cv.to_canonical(c, S, ty.DOUBLE, decimal_comma=True)
    assert values(spark, ["1.234,5", "1,5", "1.5"], S, build) == [1234.5, 15.0, 1.5]


def test_text(spark):
    check(spark, ty.TEXT, B, [(True, "True"), (False, "False"), (None, None)])
    check(spark, ty.TEXT, D, [(100.0, "100"), (1234567890.5, "1234567890.5"), (1e16, "1E+16"), (1e-7, "1E-07"), (0.0, "0"), (-0.00012, "-0.00012")])


def test_date(spark):
    check(spark, ty.DATE, S, [
        ("2023-01-15", "2023-01-15"), ("15.01.2023", "2023-01-15"), ("5.1.2023", "2023-01-05"), ("11.1.1995", "1995-01-11"),
        ("15/01/2023", "2023-01-15"), ("12/25/2023", "2023-12-25"), ("2023.01.15", "2023-01-15"), ("03/04/2023", "2023-04-03"),
        ("15.01.2023 00:00:00", "2023-01-15"), ("", DAY0), ("junk", DAY0), ("31.02.2023", DAY0), ("0000-01-01", DAY0),
        ("2023-1-5", DAY0), ("2023-01-15\n", DAY0), ("2023-01-15 25:00:00", DAY0), (None, None)], as_text=True)
    check(spark, ty.DATE, D, [(45000.75, "2023-03-15"), (1e10, None)], as_text=True)
    check(spark, ty.DATE, I, [(20230115, DAY0), (None, None)], as_text=True)


def test_datetime(spark):
    check(spark, ty.DATETIME, S, [
        ("2023-01-15T10:20:30", "2023-01-15 10:20:30"), ("2023-01-15 10:20:30.123", "2023-01-15 10:20:30.123"),
        ("15.01.2023 10:20:30", "2023-01-15 10:20:30"), ("2023.01.15", DAY0 + " 00:00:00"), ("", DAY0 + " 00:00:00")], as_text=True)
    check(spark, ty.DATETIME, D, [(45000.75, "2023-03-15 18:00:00"), (-1.25, "1899-12-29 06:00:00"), (0.0, "1899-12-30 00:00:00")], as_text=True)
    check(spark, ty.DATETIME, T.DateType(), [(datetime.date(2020, 2, 3), "2020-02-03 00:00:00")], as_text=True)
    check(spark, ty.DATETIME, T.DayTimeIntervalType(), [(datetime.timedelta(hours=5), DAY0 + " 05:00:00")], as_text=True)


def test_warning_flags(spark):
    flag = lambda c: cv.was_defaulted(c, S, ty.DATE)
    assert values(spark, ["2023-01-15", "", "junk", "31.02.2023", None], S, flag) == [False, False, True, True, False]


def test_bytes_and_guid(spark):
    check(spark, ty.BYTES, S, [("abc", None)])
    good = "d3b07384-d9a0-4c9b-8f0e-0123456789ab"
    check(spark, ty.GUID, S, [
        (good.upper(), good), ("{" + good + "}", good), (good.replace("-", ""), good), (" (" + good + ") ", good),
        ("{0xd3b07384,0xd9a0,0x4c9b,{0x8f,0x0e,0x01,0x23,0x45,0x67,0x89,0xab}}", good), ("x", cv.ZERO_GUID), (None, None)])
    check(spark, ty.GUID, T.BinaryType(), [(bytes(range(16)), "03020100-0504-0706-0809-0a0b0c0d0e0f"), (bytes(15), cv.ZERO_GUID)])


@pytest.mark.parametrize("kind", [ty.INT32, ty.INT64, ty.DOUBLE, ty.DECIMAL, ty.BOOLEAN, ty.DATE, ty.DATETIME, ty.BYTES, ty.GUID, ty.TEXT])
def test_defaults_have_the_type_of_their_kind(spark, kind):
    row = spark.range(1).select(cv.default_value(kind, ty.spark_type(kind)).isNotNull().alias("v")).first()
    assert row.v


def test_nulls_are_replaced_in_every_column_of_a_chosen_row(spark):
    df = spark.createDataFrame([(None, None, True), (None, None, False)], "a int, b string, bad boolean")
    out = cv.default_nulls(df, {"A": ty.INT32, "b": ty.TEXT}, F.col("bad")).collect()
    assert [tuple(r) for r in out] == [(0, "", True), (None, None, False)]


def test_no_python_udf_and_one_pass(spark):
    df = spark.createDataFrame([("1",)], "a string")
    plan = cv.canonicalise(df, {"a": ty.INT64})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
