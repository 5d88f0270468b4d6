"""Metadata ingest: dump merge with id remap, schema import, type register, surplus register.

Stores are dictionaries of DataFrames: ``programs(program_id, name, version, hidden)``,
``tables(table_id, program_id, table_name, version, hidden)``, ``columns(column_id,
table_id, column_name, type, default_value, field_size, allow_null, indexed, is_key,
hidden)``, ``relations(...)``, ``types(type)``. Merging matches names with case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.names import is_empty, key
from keelson.functions.types import normalise_type
from keelson.operators.filters import visible, without_system_tables
from keelson.operators.relations import clear_programs
from keelson.operators.scale import cut_lineage, first_per_key, heavy_join, number_rows, salted_join

COLUMN_VALUES = ["type", "default_value", "field_size", "allow_null", "indexed", "is_key"]


def _next_id(df: DataFrame, column: str) -> int:
    return (df.agg(F.max(column)).first()[0] or 0) + 1


def register_types(known: DataFrame, seen: DataFrame, order: str | None = None) -> DataFrame:
    """Types of ``seen`` that are not known yet, ignoring case; the first spelling wins.

    First means lowest ``order`` column, or alphabetically first without one.
    """
    picked = F.min_by("type", order) if order else F.min("type")
    fresh = seen.filter(~is_empty(F.col("type"))).groupBy(key("type").alias("_k")).agg(picked.alias("type"))
    return fresh.join(known.select(key("type").alias("_k")), "_k", "left_anti").select("type")


def drop_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent id was loaded."""
    ids = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return salted_join(child, ids, [child_key], "left_semi", F.col("id"))


def _find(rows: DataFrame, store: DataFrame, keys: list[str], store_id: str) -> DataFrame:
    """Rows with the lowest id of the visible stored row of the same key, or NULL."""
    stored = visible(store).groupBy(*keys).agg(F.min(store_id).alias("_found"))
    return heavy_join(rows, stored, keys, "left", F.col("id"))


def _merge_parents(rows: DataFrame, store: DataFrame, keys: list[str], store_id: str) -> tuple[DataFrame, DataFrame]:
    """(new rows with their new ids, map old id -> new id); repeats of a key share one row."""
    found = cut_lineage(_find(rows, store, keys, store_id))
    fresh = first_per_key(found.filter(F.col("_found").isNull()).drop("_found"), keys, ["id"])
    fresh = number_rows(fresh, ["id"], "_new", _next_id(store, store_id))
    made = fresh.select(*keys, "_new")
    mapped = heavy_join(found, made, keys, "left", F.col("id"))
    id_map = mapped.groupBy("id").agg(F.max(F.coalesce("_found", "_new")).alias("new_id"))
    return fresh, cut_lineage(id_map)


def ingest_dump(store: dict[str, DataFrame], programs: DataFrame, tables: DataFrame, columns: DataFrame,
                overwrite: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Merge a metadata dump into a store; returns (store, counts per kind).

    Found programs and tables are kept; ``overwrite`` replaces the version of found
    programs and every attribute of found columns, never those of tables. Orphans are
    dropped. Repeats of a name within the dump count once: the lowest id is inserted,
    the highest one overwrites.
    """
    new_programs, program_map = _merge_parents(programs, store["programs"], ["name"], "program_id")
    merged_programs = store["programs"].select("program_id", "name", "version", "hidden").unionByName(
        new_programs.select(F.col("_new").alias("program_id"), "name", "version", F.lit(False).alias("hidden")))
    if overwrite:
        last = programs.groupBy("name").agg(F.max_by("version", "id").alias("_v"), F.lit(True).alias("_hit"))
        shown = ~F.col("hidden").eqNullSafe(F.lit(True))
        merged_programs = merged_programs.join(last, "name", "left").withColumn(
            "version", F.when(F.col("_hit") & shown, F.col("_v")).otherwise(F.col("version"))
        ).select("program_id", "name", "version", "hidden")

    kept_tables = salted_join(tables, program_map.withColumnRenamed("id", "program_id"), ["program_id"], "inner",
                              F.col("id")).drop("program_id").withColumnRenamed("new_id", "program_id")
    new_tables, table_map = _merge_parents(kept_tables, store["tables"], ["program_id", "table_name"], "table_id")
    merged_tables = store["tables"].select("table_id", "program_id", "table_name", "version", "hidden").unionByName(
        new_tables.select(F.col("_new").alias("table_id"), "program_id", "table_name", "version",
                          F.lit(False).alias("hidden")))

    kept_columns = salted_join(columns, table_map.withColumnRenamed("id", "table_id"), ["table_id"], "inner",
                               F.col("id")).drop("table_id").withColumnRenamed("new_id", "table_id")
    name = ["table_id", "column_name"]
    found = cut_lineage(_find(kept_columns, store["columns"], name, "column_id"))
    fresh = first_per_key(found.filter(F.col("_found").isNull()).drop("_found"), name, ["id"])
    fresh = number_rows(fresh, ["id"], "column_id", _next_id(store["columns"], "column_id"))
    layout = ["column_id", *name, *COLUMN_VALUES, "hidden"]
    stored = store["columns"].select(*layout)
    if overwrite:
        last = found.filter(F.col("_found").isNotNull()).groupBy(F.col("_found").alias("column_id")).agg(
            F.max_by(F.struct(*COLUMN_VALUES), "id").alias("_v"))
        stored = stored.join(last, "column_id", "left").withColumns({
            c: F.when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(c)) for c in COLUMN_VALUES
        }).select(*layout)
    merged_columns = stored.unionByName(fresh.withColumn("hidden", F.lit(False)).select(*layout))

    new_types = register_types(store["types"], fresh, "id")
    merged = {**store, "programs": merged_programs, "tables": merged_tables, "columns": merged_columns,
              "types": store["types"].unionByName(new_types)}
    counts = _counts("programs", programs, new_programs).unionByName(
        _counts("tables", kept_tables, new_tables)).unionByName(_counts("columns", kept_columns, fresh))
    return merged, counts


def _counts(kind: str, rows: DataFrame, added: DataFrame) -> DataFrame:
    tagged = rows.select(F.lit(0).alias("a")).unionByName(added.select(F.lit(1).alias("a")))
    n_added = F.count_if(F.col("a") == 1)
    return tagged.agg(n_added.alias("n_added"), (F.count_if(F.col("a") == 0) - n_added).alias("n_skipped")).select(
        F.lit(kind).alias("kind"), "n_added", "n_skipped")


def import_schema(store: dict[str, DataFrame], catalog: DataFrame, fks: DataFrame | None = None,
                  clear: bool = False, system_tables: bool = False, raw_types: bool = False
                  ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Insert-only merge of live catalogs into a store; returns (store, counts per kind).

    ``catalog`` holds program_id, table_name, position, column_name, sql_type, not_null,
    primary_key, max_length; ``fks`` program_id, constraint_name, child_table,
    child_column, parent_table. ``clear`` removes the programs' schema first.
    """
    if clear:
        store = clear_programs(store, catalog, with_surplus=False)
    catalog = without_system_tables(catalog, "table_name", include=system_tables)
    live_tables = catalog.select("program_id", "table_name").distinct()
    stored_tables = visible(store["tables"]).groupBy("program_id", "table_name").agg(F.min("table_id").alias("table_id"))
    new_tables = live_tables.join(stored_tables, ["program_id", "table_name"], "left_anti")
    new_tables = number_rows(new_tables, ["program_id", "table_name"], "table_id", _next_id(store["tables"], "table_id"))
    new_tables = new_tables.select("table_id", "program_id", "table_name", F.lit(None).cast("string").alias("version"),
                                   F.lit(False).alias("hidden"))
    layout = new_tables.columns
    tables = store["tables"].select(*layout).unionByName(new_tables)

    ids = stored_tables.select("program_id", "table_name", "table_id").unionByName(
        new_tables.select("program_id", "table_name", "table_id"))
    word = F.upper(F.trim("sql_type")) if raw_types else normalise_type(F.col("sql_type"), F.col("max_length"))
    rows = salted_join(catalog, ids, ["program_id", "table_name"], "inner", F.col("column_name")).select(
        "table_id", "position", "column_name", word.alias("type"), F.lit(None).cast("string").alias("default_value"),
        F.when(F.col("max_length") > 0, F.col("max_length").cast("string")).alias("field_size"),
        F.when(F.col("not_null"), F.lit("No")).otherwise(F.lit("YES")).alias("allow_null"),
        F.lit(None).cast("string").alias("indexed"), F.col("primary_key").alias("is_key"))
    name = ["table_id", "column_name"]
    rows = first_per_key(rows, name, ["position"])
    new_columns = rows.join(visible(store["columns"]).select(*name), name, "left_anti")
    new_columns = number_rows(new_columns, ["table_id", "position", "column_name"], "column_id",
                              _next_id(store["columns"], "column_id"))
    new_columns = new_columns.withColumn("hidden", F.lit(False)).select(
        "column_id", *name, *COLUMN_VALUES, "hidden")
    merged = {**store, "tables": tables,
              "columns": store["columns"].select(*new_columns.columns).unionByName(new_columns),
              "types": store["types"].unionByName(register_types(store["types"], rows))}
    counts = _one_count("tables", new_tables).unionByName(_one_count("columns", new_columns))
    if fks is not None:
        fresh = import_relations(store["relations"], fks, system_tables)
        merged["relations"] = store["relations"].unionByName(fresh, allowMissingColumns=True)
        counts = counts.unionByName(_one_count("relations", fresh))
    return merged, counts


def import_relations(relations: DataFrame, fks: DataFrame, system_tables: bool = False) -> DataFrame:
    """Live foreign keys as new relations: one per program, child table and field not stored yet."""
    fks = without_system_tables(fks, "parent_table", "child_table", include=system_tables)
    match = ["program_id", "child_table", "field"]
    rows = fks.withColumnRenamed("child_column", "field")
    fresh = rows.join(visible(relations).select(*match).distinct(), match, "left_anti")
    fresh = first_per_key(fresh, match, ["constraint_name"])
    fresh = number_rows(fresh, [*match], "relation_id", _next_id(relations, "relation_id"))
    return fresh.select("relation_id", "program_id", "parent_table", "child_table", "field",
                        F.col("constraint_name").alias("name"), F.lit(False).alias("cascade"),
                        F.lit(False).alias("hidden"))


def _one_count(kind: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_added")).select(F.lit(kind).alias("kind"), "n_added")


def refresh_surplus(old: DataFrame, new: DataFrame, programs: DataFrame) -> DataFrame:
    """Surplus register after an analysis: the entries of the analysed programs are replaced."""
    analysed = programs.select("program_id").distinct()
    return old.join(analysed, "program_id", "left_anti").unionByName(new)


def drop_surplus(surplus: DataFrame, dropped: DataFrame) -> DataFrame:
    """Register without dropped entries: (table, column), or a whole table where the column is NULL.

    A table entry goes with its last column, since entries are kept per column.
    """
    scope = [c for c in ("program_id", "db") if c in surplus.columns]
    tables = dropped.filter(F.col("column_name").isNull()).select(*scope, "table_name").distinct()
    columns = dropped.filter(F.col("column_name").isNotNull()).select(*scope, "table_name", "column_name").distinct()
    return surplus.join(tables, [*scope, "table_name"], "left_anti").join(
        columns, [*scope, "table_name", "column_name"], "left_anti")


def batch_list(entries: DataFrame, order: Column | str) -> DataFrame:
    """Databases to run over: a path listed twice (ignoring case) counts once, the first one."""
    ordered = entries.withColumn("_o", F.col(order) if isinstance(order, str) else order).withColumn(
        "_k", key("address"))
    return first_per_key(ordered, ["_k"], ["_o"]).drop("_o", "_k")
