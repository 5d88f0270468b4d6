"""Checks on migrated data: keys, orphans, column rules, row counts, identity seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.scale import salted_join


def check_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row; counted before the shuffle, so hot keys are cheap."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def check_orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Key values of child rows that no parent has, with their row counts. NULL keys are fine.

    Both sides shrink to distinct keys first, whatever the share of one key.
    """
    used = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    return used.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def orphan_rows(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, spread: Column) -> DataFrame:
    """The child rows themselves; ``spread`` is a row value that divides hot keys."""
    bad = check_orphans(child, child_key, parent, parent_key).select(F.col("key").alias(child_key))
    return salted_join(child, bad, [child_key], "left_semi", spread)


def check_columns(df: DataFrame, not_null: list[str], max_length: dict[str, int]) -> DataFrame:
    """Violations per column in one pass: one row per (column, rule) with the number of rows."""
    rules = [(name, "not_null", F.col(name).isNull()) for name in not_null]
    rules += [(name, "max_length", F.length(F.col(name).cast("string")) > n) for name, n in max_length.items()]
    counted = df.agg(*[F.count_if(bad).alias(f"r{i}") for i, (_, _, bad) in enumerate(rules)])
    pairs = ", ".join(f"'{name}', '{rule}', r{i}" for i, (name, rule, _) in enumerate(rules))
    return counted.selectExpr(f"stack({len(rules)}, {pairs}) AS (column_name, rule, n_rows)")


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ])


def reconcile_counts(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """Rows per table on both sides; a table missing on one side has NULL there."""
    left = count_rows(source).withColumnRenamed("n_rows", "source_rows")
    right = count_rows(target).withColumnRenamed("n_rows", "target_rows")
    return left.join(right, "table_name", "full_outer").withColumn(
        "matches", F.col("source_rows").eqNullSafe(F.col("target_rows")))


def reseed_values(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Next identity value of each auto-number column: largest value + 1, 1 when empty."""
    parts = []
    for name, (df, columns) in tables.items():
        tops = df.agg(*[F.max(c).cast("bigint").alias(c) for c in columns])
        pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
        parts.append(tops.selectExpr(f"'{name}' AS table_name", f"stack({len(columns)}, {pairs}) AS (column_name, top)"))
    return reduce(DataFrame.unionByName, parts).select(
        "table_name", "column_name", F.coalesce(F.col("top") + 1, F.lit(1).cast("bigint")).alias("next_value"))
