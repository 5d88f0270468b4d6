"""One report over all checks after a migration."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableChecks:
    """What is expected of a table; foreign keys are (column, parent table, parent column)."""

    keys: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    max_length: dict[str, int] = field(default_factory=dict)
    foreign_keys: list[tuple[str, str, str]] = field(default_factory=list)
    identity: list[str] = field(default_factory=list)


def _facts(df: DataFrame, table: str, rule: TableChecks) -> DataFrame:
    """Row count, violations per column and next identities of a table, from one pass."""
    values = [("row_count", "", F.count(F.lit(1)))]
    values += [("not_null", name, F.count_if(F.col(name).isNull())) for name in rule.not_null]
    values += [("max_length", name, F.count_if(F.length(F.col(name).cast("string")) > n)) for name, n in rule.max_length.items()]
    values += [("next_identity", name, F.coalesce(F.max(name).cast("bigint") + 1, F.lit(1).cast("bigint"))) for name in rule.identity]
    found = df.agg(*[value.cast("bigint").alias(f"v{i}") for i, (_, _, value) in enumerate(values)])
    facts = F.array(*[F.struct(F.lit(check).alias("check"), F.lit(column).alias("column_name"), F.col(f"v{i}").alias("value"))
                      for i, (check, column, _) in enumerate(values)])
    return found.select(F.explode(facts).alias("f")).select(F.lit(table).alias("table_name"), "f.*")


def _uses(df: DataFrame, table: str, rules: dict[str, TableChecks], target: dict[str, DataFrame]) -> DataFrame | None:
    """``(table_name, check, column_name, key, own, referred)``: the table's own keys, the keys it refers to and those
    that others find in it, each with its number of rows, from one pass."""
    uses = []

    def use(owner: str, check: str, column: str, key: Column, own: int) -> None:
        uses.append(F.struct(F.lit(owner).alias("table_name"), F.lit(check).alias("check"), F.lit(column).alias("column_name"),
                             key.alias("key"), F.lit(own).alias("own")))

    rule = rules.get(table, TableChecks())
    if rule.keys:
        use(table, "duplicate_keys", ",".join(rule.keys), F.to_json(F.struct(*[F.col(k) for k in rule.keys])), 1)
    for column, _, _ in rule.foreign_keys:
        use(table, "orphan_rows", column, F.col(column).cast("string"), 1)
    for child, other in rules.items():
        for column, parent, parent_column in other.foreign_keys:
            if parent == table:
                kind = target[child].schema[column].dataType
                use(child, "orphan_rows", column, F.col(parent_column).try_cast(kind).cast("string"), 0)
    if not uses:
        return None
    rows = df.select(F.explode(F.array(*uses)).alias("u")).select("u.*").filter(F.col("key").isNotNull())
    names = ["table_name", "check", "column_name", "key"]
    return rows.groupBy(*names).agg(F.sum("own").alias("own"), F.sum(1 - F.col("own")).alias("referred"))


def post_check(source: dict[str, DataFrame], target: dict[str, DataFrame], rules: dict[str, TableChecks]) -> DataFrame:
    """(table_name, check, column_name, value) for every check of every table.

    Values: difference in rows, duplicate key values, orphan rows, violating rows, next
    identity value. A target is read twice: once for all that is counted, once for all
    keys. Keys are counted within the tasks, then meet in a single shuffle.
    """
    facts = reduce(DataFrame.unionByName, [_facts(df, name, rules.get(name, TableChecks())) for name, df in target.items()])
    before = reduce(DataFrame.unionByName, [_facts(df, name, TableChecks()) for name, df in source.items()])
    counts = facts.filter(F.col("check") == "row_count").unionByName(before.withColumn("value", -F.col("value"))).groupBy("table_name").agg(
        F.sum("value").alias("value")).select("table_name", F.lit("row_difference").alias("check"), F.lit("").alias("column_name"), "value")
    parts = [counts, facts.filter(F.col("check") != "row_count")]
    used = [u for u in (_uses(df, name, rules, target) for name, df in target.items()) if u is not None]
    if used:
        names = ["table_name", "check", "column_name"]
        keys = reduce(DataFrame.unionByName, used).groupBy(*names, "key").agg(F.sum("own").alias("own"), F.sum("referred").alias("referred"))
        wrong = F.when(F.col("check") == "duplicate_keys", (F.col("own") > 1).cast("bigint")).when(F.col("referred") == 0, F.col("own")).otherwise(0)
        expected = [(t, "duplicate_keys", ",".join(r.keys)) for t, r in rules.items() if r.keys]
        expected += [(t, "orphan_rows", column) for t, r in rules.items() for column, _, _ in r.foreign_keys]
        # A check without any key, as of an empty table, still has its line.
        zero = keys.sparkSession.createDataFrame(expected, "table_name string, check string, column_name string").withColumn("value", F.lit(0).cast("bigint"))
        parts.append(keys.select(*names, wrong.cast("bigint").alias("value")).unionByName(zero).groupBy(*names).agg(F.sum("value").alias("value")))
    return reduce(DataFrame.unionByName, parts).select("table_name", "check", "column_name", F.col("value").cast("bigint").alias("value"))
