"""Live catalogs as DataFrames: tables, columns, keys, and the tenant registry.

The raw inputs are catalog views of any number of databases, one row per table,
column or key part, read over JDBC with ``catalog_query`` or taken from Spark schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions import types as ty
from keelson.functions.names import key
from keelson.functions.text import detect_backend, registry_label, resolve_address
from keelson.operators.filters import registry_visible
from keelson.operators.scale import salted_join

CATALOG = (
    "db STRING, table_name STRING, position INT, column_name STRING, sql_type STRING, "
    "not_null BOOLEAN, primary_key BOOLEAN, max_length INT"
)

# Names under which the tenant registry is looked for, and its columns.
REGISTRY_TABLES = ["firmeadrese", "firmaadresa"]
REGISTRY_ADDRESS = ["adresa"]
REGISTRY_COMPANY = ["firma", "nazivfirme"]
REGISTRY_HIDDEN = ["skriven"]


def user_tables(raw: DataFrame) -> DataFrame:
    """Tables a user made, from raw ``(db, backend, table_name, kind, system)`` rows.

    ``kind`` is the catalog's own word for the object, ``system`` its system flag.
    """
    backend, name = F.col("backend"), F.col("table_name")
    kind = F.upper(F.coalesce("kind", F.lit("")))
    shown = (
        F.when(backend == "SQLite", (kind == "TABLE") & ~key("table_name").rlike("^sqlite."))
        .when(backend == "Access", (kind == "TABLE") & ~key("table_name").startswith("msys"))
        .when(backend.isin("SqlServer", "PostgreSQL"), kind == "BASE TABLE")
        .when(backend == "DB2", kind == "T")
        .when(backend == "Firebird", ~F.coalesce("system", F.lit(False)) & (kind != "VIEW"))
        .otherwise(F.lit(True))
    )
    stripped = F.when((backend == "DBase") & key("table_name").endswith(".dbf"),
                      F.expr("left(table_name, length(table_name) - 4)"))
    trimmed = F.when(backend.isin("DB2", "Firebird"), F.rtrim(name))
    return raw.filter(shown).select("db", "backend", F.coalesce(stripped, trimmed, name).alias("table_name"))


def is_identity(backend: Column, type_name: Column, marker: Column, primary_key: Column) -> Column:
    """Identity rule of each dialect; ``marker`` is the catalog's own identity text."""
    mark = F.lower(F.coalesce(marker, F.lit("")))
    return (
        F.when(backend == "SQLite", primary_key & (F.upper(ty.split_type(type_name)[0]) == "INTEGER"))
        .when(backend == "Access", primary_key & (mark == "3"))
        .when(backend.isin("MySQL", "MariaDB"), mark.contains("auto_increment"))
        .when(backend == "SqlServer", mark.isin("1", "true", "yes"))
        .when(backend == "PostgreSQL", (mark == "yes") | mark.startswith("nextval("))
        .when(backend == "Firebird", mark != "")
        .when(backend == "DB2", mark.isin("y", "d"))
        .when(backend == "Oracle", mark.isin("yes", "y", "1"))
        .otherwise(F.lit(False))
    )


def _catalog_type(backend: Column, type_name: Column) -> Column:
    """Canonical type of a catalog's type text; two dialects give ``code`` or ``code:subtype`` numbers."""
    code = F.regexp_extract(type_name, r"^(\d+)(?::(\d+))?$", 1).try_cast("int")
    subtype = F.regexp_extract(type_name, r"^(\d+)(?::(\d+))?$", 2).try_cast("int")
    return (
        F.when((backend == "Firebird") & code.isNotNull(), ty.code_to_canonical("firebird", code, subtype))
        .when((backend == "Access") & code.isNotNull(), ty.code_to_canonical("oledb", code))
        .otherwise(ty.resolve(backend, type_name))
    )


def column_catalog(raw: DataFrame, keys: DataFrame) -> DataFrame:
    """Catalog rows in neutral words, with the canonical type kept beside.

    ``raw``: db, backend, table_name, position, column_name, type_name, length,
    not_null, identity. ``keys``: db, table_name, column_name of primary keys.
    """
    marked = salted_join(raw, keys.select("db", "table_name", "column_name").distinct().withColumn("_pk", F.lit(True)),
                         ["db", "table_name", "column_name"], "left", F.col("position"))
    primary = F.coalesce("_pk", F.lit(False))
    base, written = ty.split_type(F.col("type_name"))
    sqlite = F.col("backend") == "SQLite"
    length = F.when(sqlite, written).otherwise(ty.clamp_length(F.coalesce("length", F.lit(0))))
    canonical = _catalog_type(F.col("backend"), F.when(sqlite, base).otherwise(F.col("type_name")))
    identity = is_identity(F.col("backend"), F.col("type_name"), F.col("identity"), primary)
    return marked.select(
        "db", "table_name", "position", "column_name",
        F.when(identity, F.lit("AutoNumber")).otherwise(ty.to_vocabulary(canonical, length)).alias("sql_type"),
        "not_null", primary.alias("primary_key"), length.alias("max_length"),
        canonical.alias("canonical"))


def column_types(catalog: DataFrame, legacy_int_clamp: bool = False) -> DataFrame:
    """Catalog with the canonical type of each column.

    A catalog in neutral words has lost 64-bit integers; its ``canonical`` column keeps
    them. ``legacy_int_clamp`` reads the words instead, so that such values clamp.
    """
    from_words = ty.resolve_any(F.col("sql_type"))
    if legacy_int_clamp or "canonical" not in catalog.columns:
        return catalog.withColumn("canonical", from_words)
    return catalog.withColumn("canonical", F.coalesce("canonical", from_words))


def primary_keys(key_usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Primary-key columns: key usage of the constraints of that kind.

    ``key_usage``: db, constraint_name, table_name, column_name, ordinal.
    ``constraints``: db, constraint_name, table_name, kind.
    """
    wanted = constraints.filter(F.upper("kind").isin("PRIMARY KEY", "P")).select("db", "constraint_name", "table_name")
    return key_usage.join(wanted, ["db", "constraint_name", "table_name"], "left_semi").select(
        "db", "table_name", "column_name", "ordinal")


def foreign_keys(references: DataFrame, key_usage: DataFrame) -> DataFrame:
    """One row per column pair of each foreign key, paired by the place in the key.

    ``references``: db, constraint_name, referenced_constraint.
    """
    child = key_usage.select("db", "constraint_name", F.col("table_name").alias("child_table"),
                             F.col("column_name").alias("child_column"), "ordinal")
    parent = key_usage.select("db", F.col("constraint_name").alias("referenced_constraint"),
                              F.col("table_name").alias("parent_table"),
                              F.col("column_name").alias("parent_column"), "ordinal")
    return references.join(child, ["db", "constraint_name"]).join(
        parent, ["db", "referenced_constraint", "ordinal"]).select(
        "db", "constraint_name", "child_table", "child_column", "parent_table", "parent_column", "ordinal")


def catalog_from_schema(spark: SparkSession, db: str, tables: dict[str, T.StructType]) -> DataFrame:
    """Catalog of tables whose Spark schemas are known."""
    rows = []
    for table, schema in tables.items():
        for position, field in enumerate(schema, 1):
            length = getattr(field.dataType, "length", 0) or 0
            rows.append((db, table, position, field.name, field.dataType.simpleString(), not field.nullable,
                         False, length, ty.spark_to_canonical(field.dataType)))
    return spark.createDataFrame(rows, CATALOG + ", canonical STRING")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables of the Spark catalog, temporary views excluded."""
    rows = [(database or t.namespace[0] if t.namespace else "", t.name)
            for t in spark.catalog.listTables(database) if not t.isTemporary]
    return spark.createDataFrame(rows, "db STRING, table_name STRING")


def find_registry(tables: DataFrame) -> DataFrame:
    """Tables that are the tenant registry of their database."""
    return tables.filter(key("table_name").isin(REGISTRY_TABLES))


def _find_column(columns: list[str], names: list[str]) -> str | None:
    return next((c for c in columns if c.lower() in names), None)


def read_registry(df: DataFrame) -> DataFrame:
    """Registry rows as (label, backend, address, reason).

    Hidden and blank entries are dropped. An address whose backend is not recognised
    stays, with NULL backend and a reason. Without an address column nothing is listed.
    """
    address = _find_column(df.columns, REGISTRY_ADDRESS)
    company = _find_column(df.columns, REGISTRY_COMPANY)
    hidden = _find_column(df.columns, REGISTRY_HIDDEN)
    if address is None:
        return df.sparkSession.createDataFrame([], "label STRING, backend STRING, address STRING, reason STRING")
    rows = registry_visible(df, hidden, address)
    path = resolve_address(F.col(address).cast("string"))
    name = F.col(company).cast("string") if company else F.lit(None).cast("string")
    found = detect_backend(path)
    return rows.select(
        registry_label(name, path).alias("label"), found.alias("backend"), path.alias("address"),
        F.when(found.isNull(), F.concat(F.lit("backend not recognised: "), path)).alias("reason"))
