"""Small helpers shared by the column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def as_col(value: Column | str) -> Column:
    """A column by name, or the column itself."""
    return F.col(value) if isinstance(value, str) else value


def as_value(value: Column | str | int | bool) -> Column:
    """A literal, or the column itself."""
    return value if isinstance(value, Column) else F.lit(value)


def strip(c: Column) -> Column:
    """The text without blanks at either end."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    """True for NULL, empty and blank-only text."""
    return F.coalesce(strip(c), F.lit("")) == ""


def is_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def key(c: Column | str) -> Column:
    """The form under which names are compared when case is ignored."""
    return F.lower(as_col(c))


def is_visible(hidden: Column | str) -> Column:
    """Soft delete rule: only an explicit true hides a row, NULL does not."""
    return ~as_col(hidden).eqNullSafe(F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def row_hash(df, columns: list[str] | None = None) -> Column:
    """A content hash, the same on every re-run of a task (safe for salting)."""
    return F.xxhash64(*[F.col(c) for c in (columns or df.columns)])
