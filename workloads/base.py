"""Derived inputs that read the same in Spark SQL and in ANSI SQL, and the query record."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from keelson.sources.stores import POSITION, FileStore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return FileStore(sf_dir).read(spark, name)


@dataclass(frozen=True)
class Recipe:
    """Columns derived from one table by expressions both dialects understand."""

    source: str
    columns: dict[str, str]
    where: str | None = None
    distinct: bool = False

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.source)
        rows = rows.filter(self.where) if self.where else rows
        rows = rows.selectExpr(*[f"{text} AS {name}" for name, text in self.columns.items()])
        return rows.distinct() if self.distinct else rows

    def placed(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The same rows with their place in the file."""
        store = FileStore(sf_dir)
        rows = store.placed(spark, self.source, store.schema(spark, self.source).names)
        return rows.selectExpr(*[f"{text} AS {name}" for name, text in self.columns.items()], POSITION)

    @property
    def placed_sql(self) -> str:
        """The same with ``_row``: the rows in the order of the file."""
        names = ", ".join(f"{text} AS {name}" for name, text in self.columns.items())
        return f"SELECT {names}, _row FROM (SELECT *, row_number() OVER () AS _row FROM {self.source})"

    @property
    def sql(self) -> str:
        names = ", ".join(f"{text} AS {name}" for name, text in self.columns.items())
        where = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {'DISTINCT ' if self.distinct else ''}{names} FROM {self.source}{where}"


@dataclass(frozen=True)
class Query:
    """``sql`` is None where no SQL engine can express the result."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def case_of(selector: str, values: list[str | None]) -> str:
    """CASE that picks one of the expressions by number; None is NULL."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None)
    return f"CASE {selector} {arms} END"


def text(value: str) -> str:
    """SQL text literal."""
    return "'" + value.replace("'", "''") + "'"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A CTE of literal rows."""
    cell = lambda v: "NULL" if v is None else text(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def div(a: str, b: int) -> str:
    """Whole-number division in both dialects."""
    return f"CAST(floor({a} / {b}) AS BIGINT)"
