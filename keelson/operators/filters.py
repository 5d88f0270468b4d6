"""Row filters, projections and renames on metadata and data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import types as ty
from keelson.functions.names import is_empty, is_visible, key, strip
from keelson.operators.scale import salted_join

# Fixed value: name prefix of system tables.
SYSTEM_PREFIX = "msys"


def visible(df: DataFrame, hidden: str = "hidden") -> DataFrame:
    return df.filter(is_visible(hidden))


def without_system_tables(df: DataFrame, *columns: str, include: bool = False) -> DataFrame:
    """Drop rows naming a system table in any of the columns; ``include`` keeps all."""
    if include:
        return df
    for name in columns or ("table_name",):
        df = df.filter(~F.coalesce(key(name).startswith(SYSTEM_PREFIX), F.lit(False)))
    return df


def complete_relations(relations: DataFrame) -> DataFrame:
    """Relations whose child, field and parent are all given."""
    return relations.filter(~is_empty(F.col("child_table")) & ~is_empty(F.col("field"))
                            & ~is_empty(F.col("parent_table")))


def program_tables(tables: DataFrame, program_ids: DataFrame) -> DataFrame:
    """Visible tables of the given programs, by name."""
    chosen = visible(tables).join(program_ids.select("program_id").distinct(), "program_id", "left_semi")
    return chosen.orderBy("program_id", "table_name", "table_id")


def sorted_relations(relations: DataFrame) -> DataFrame:
    return relations.orderBy("parent_table", "child_table")


def common_columns(source: list[str], target: list[str]) -> list[tuple[str, str]]:
    """(source name, target name) of columns on both sides, ignoring case, in source order."""
    spelled = {name.lower(): name for name in target}
    return [(name, spelled[name.lower()]) for name in source if name.lower() in spelled]


def project_common(df: DataFrame, target: list[str]) -> DataFrame:
    """Shared columns of a table under the target's spelling."""
    return df.select(*[F.col(f"`{s}`").alias(t) for s, t in common_columns(df.columns, target)])


def match_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """The same match for whole catalogs: one row per shared (table, column).

    Both catalogs hold ``db, table_name, position, column_name``.
    """
    right = target.select(
        "db", key("table_name").alias("_t"), key("column_name").alias("_c"),
        F.col("column_name").alias("target_column")).dropDuplicates(["db", "_t", "_c"])
    left = source.select(
        "db", "table_name", "position", F.col("column_name").alias("source_column"),
        key("table_name").alias("_t"), key("column_name").alias("_c"))
    return left.join(right, ["db", "_t", "_c"]).drop("_t", "_c")


def tables_without_match(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables that share no column with their counterpart: a transfer skips them."""
    matched = match_columns(source, target).select("db", key("table_name").alias("_t")).distinct()
    tables = source.select("db", "table_name", key("table_name").alias("_t")).distinct()
    return tables.join(matched, ["db", "_t"], "left_anti").drop("_t")


def registry_visible(df: DataFrame, hidden: str | None, address: str) -> DataFrame:
    """Entries with an address whose hidden flag is absent, NULL, false, 0 or prints as ``0``."""
    kept = df.filter(F.coalesce(strip(F.col(address).cast("string")), F.lit("")) != "")
    if hidden is None:
        return kept
    flag = F.col(hidden)
    dtype = df.schema[hidden].dataType
    shown = flag.isNull() | (flag.cast("string") == "0")
    if dtype.typeName() == "boolean":
        shown = shown | (~flag)
    return kept.filter(shown)


def conform(df: DataFrame, declared: list[tuple[str, str]], drop_surplus: bool = False) -> DataFrame:
    """Rows under a declared schema given as (column, canonical type).

    Present columns keep their order and type, missing ones are added as typed NULLs
    at the end, surplus ones stay unless ``drop_surplus``.
    """
    wanted = {name.lower() for name, _ in declared}
    present = {name.lower() for name in df.columns}
    kept = [F.col(f"`{c}`") for c in df.columns if not drop_surplus or c.lower() in wanted]
    added = [
        F.lit(None).cast(ty.spark_type(kind) or "string").alias(name)
        for name, kind in declared if name.lower() not in present
    ]
    return df.select(*kept, *added)


def save_rename(register: DataFrame, changes: DataFrame) -> DataFrame:
    """Rename register after an upsert: entries match by ``id``; names are trimmed, blanks refused."""
    columns = ["id", "program_id", "old_name", "new_name", "version"]
    good = changes.select(
        "id", "program_id", strip(F.col("old_name")).alias("old_name"),
        strip(F.col("new_name")).alias("new_name"), strip(F.col("version")).alias("version"),
    ).filter(~is_empty(F.col("old_name")) & ~is_empty(F.col("new_name")))
    return register.select(*columns).join(good.select("id"), "id", "left_anti").unionByName(good).select(*columns)


def apply_renames(catalog: DataFrame, renames: DataFrame) -> DataFrame:
    """Catalog with old table names replaced, per program, ignoring case.

    Of several entries for one old name the highest id counts.
    """
    latest = renames.groupBy("program_id", key("old_name").alias("_t")).agg(
        F.max_by("new_name", "id").alias("_new"))
    joined = salted_join(catalog.withColumn("_t", key("table_name")), latest, ["program_id", "_t"], "left",
                         F.col("column_name"))
    return joined.withColumn("table_name", F.coalesce("_new", "table_name")).select(*catalog.columns)
