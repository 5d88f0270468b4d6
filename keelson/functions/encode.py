"""Sink encoders and fixed-width field texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions import types as ty
from keelson.functions.convert import clamp_int32, to_text


def encode_for(backend: str, c: Column, canonical: str) -> Column:
    """Canonical value in the form a backend stores it in."""
    if backend == "SQLite":
        if canonical == ty.BOOLEAN or canonical == ty.INT32:
            return c.cast("bigint")
        if canonical == ty.DATE:
            return F.date_format(c, "yyyy-MM-dd")
        if canonical == ty.DATETIME:
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif backend == "Access":
        if canonical == ty.INT64:
            return clamp_int32(c)
        if canonical == ty.DECIMAL:
            return c.cast("double")
        if canonical == ty.DATE:
            return c.cast("timestamp_ntz")
        if canonical == ty.UNKNOWN:
            return c.cast("string")
    elif backend in ("Firebird", "DB2", "Oracle"):
        if canonical == ty.BOOLEAN:
            return c.cast("int")
        if canonical == ty.DATE:
            return c.cast("timestamp_ntz")
    return c


def _as_number(c: Column, dtype: T.DataType) -> Column:
    """The value as a double, NULL where it is not a number."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        return c.try_cast("double")
    return F.lit(None).cast("double")


def _fixed_character(c: Column, dtype: T.DataType, length: int) -> Column:
    text = F.when(c, F.lit("T")).when(~c, F.lit("F")) if isinstance(dtype, T.BooleanType) else to_text(c, dtype)
    return F.rpad(F.coalesce(text, F.lit("")), length, " ")


def _number_digits(c: Column, dtype: T.DataType, decimals: int) -> Column:
    """Digits of a number, rounded away from zero at the half through an exact decimal."""
    if decimals > 0:
        exact = c if isinstance(dtype, (T.DecimalType, T.IntegralType)) else _as_number(c, dtype)
        text = F.round(exact.try_cast("decimal(38,15)"), decimals).try_cast(f"decimal(38,{decimals})").cast("string")
    elif isinstance(dtype, T.IntegralType):
        text = c.cast("string")
    else:
        exact = c if isinstance(dtype, T.DecimalType) else _as_number(c, dtype)
        text = F.bround(exact, 0).try_cast("bigint").cast("string")
    return F.coalesce(text, F.lit("0"))


def _fixed_number(c: Column, dtype: T.DataType, length: int, decimals: int) -> Column:
    digits = _number_digits(c, dtype, decimals)
    return F.when(c.isNull(), F.lit(" " * length)).otherwise(F.lpad(digits, length, " "))


def fixed_width_overflow(c: Column, dtype: T.DataType, kind: str, length: int, decimals: int = 0) -> Column:
    """True where a number has more digits than its field (such a row is to be rejected)."""
    if kind not in ("N", "F"):
        return F.lit(False)
    return c.isNotNull() & (F.length(_number_digits(c, dtype, decimals)) > length)


def _fixed_logical(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        true = c
    elif isinstance(dtype, (T.IntegerType, T.LongType)):
        true = c != 0
    elif isinstance(dtype, T.StringType):
        true = (c == "T") | (F.lower(c) == "true")
    else:
        true = F.lit(False)
    return F.when(F.coalesce(true, F.lit(False)), F.lit("T")).otherwise(F.lit("F"))


def _fixed_date(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyyMMdd")
    elif isinstance(dtype, T.StringType):
        text = c
    else:
        text = F.lit(None).cast("string")
    return F.rpad(F.coalesce(text, F.lit("")), 8, " ")


def fixed_width(c: Column, dtype: T.DataType, kind: str, length: int, decimals: int = 0) -> Column:
    """Text of one fixed-width field.

    ``C`` left-aligned text, ``N``/``F`` right-aligned number, ``L`` T or F, ``D`` yyyyMMdd;
    other kinds stay blank. A number too long for its field keeps its leading digits,
    see :func:`fixed_width_overflow`.
    """
    if kind == "C":
        return _fixed_character(c, dtype, length)
    if kind in ("N", "F"):
        return _fixed_number(c, dtype, length, decimals)
    if kind == "L":
        return F.rpad(_fixed_logical(c, dtype), length, " ")
    if kind == "D":
        return F.rpad(_fixed_date(c, dtype), length, " ")
    return F.lit(" " * length)
