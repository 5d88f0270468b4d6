"""Relations between tables: delete guards, renames, naming, program clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.names import is_empty, key
from keelson.operators.filters import visible
from keelson.operators.scale import salted_join


def referenced_tables(relations: DataFrame) -> DataFrame:
    """(program_id, table_name) of tables named by a visible relation at either end."""
    ends = F.explode(F.array("parent_table", "child_table"))
    return visible(relations).select("program_id", ends.alias("table_name")).filter(
        F.col("table_name").isNotNull()).distinct()


def guarded_tables(tables: DataFrame, relations: DataFrame) -> DataFrame:
    """Tables that may not be deleted because a visible relation names them."""
    return tables.join(referenced_tables(relations), ["program_id", "table_name"], "left_semi")


def field_references(relations: DataFrame) -> DataFrame:
    """Number of visible relations per program and field."""
    return visible(relations).filter(F.col("field").isNotNull()).groupBy("program_id", "field").agg(
        F.count(F.lit(1)).alias("n_relations"))


def guarded_columns(columns: DataFrame, relations: DataFrame) -> DataFrame:
    """Columns that may not be deleted, with the number of relations on their name."""
    used = field_references(relations).withColumnRenamed("field", "column_name")
    return salted_join(columns, used, ["program_id", "column_name"], "inner", F.col("table_name"))


def propagate_rename(relations: DataFrame, renames: DataFrame) -> DataFrame:
    """Relations with the fields of renamed columns, whatever their table.

    ``renames`` holds program_id, old_name, new_name. A change of case only is no
    rename; hidden relations keep their field. Of several renames of one column the
    alphabetically last new name counts.
    """
    real = renames.filter(key("old_name") != key("new_name")).groupBy("program_id", "old_name").agg(
        F.max("new_name").alias("_new")).withColumnRenamed("old_name", "field")
    shown = ~F.col("hidden").eqNullSafe(F.lit(True))
    joined = salted_join(relations, real, ["program_id", "field"], "left", F.col("relation_id"))
    return joined.withColumn(
        "field", F.when(shown & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("field"))
    ).select(*relations.columns)


def auto_name(relations: DataFrame) -> DataFrame:
    """Relations renamed to parent followed by child, where both are given."""
    both = ~is_empty(F.col("parent_table")) & ~is_empty(F.col("child_table"))
    name = F.when(both, F.concat("parent_table", "child_table")).otherwise(F.col("name"))
    return relations.withColumn("name", name)


def child_counts(parents: DataFrame, children: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Parents with the number of their children (0 when there are none)."""
    counts = children.groupBy(parent_key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, parent_key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def clear_programs(store: dict[str, DataFrame], program_ids: DataFrame, with_surplus: bool = True) -> dict[str, DataFrame]:
    """Store without the tables, columns, relations and surplus entries of some programs.

    Programs themselves stay. ``store`` may hold tables, columns, relations, surplus.
    """
    gone = program_ids.select("program_id").distinct()
    kept = dict(store)
    for name in ("tables", "relations", *(["surplus"] if with_surplus else [])):
        if name in store:
            kept[name] = store[name].join(gone, "program_id", "left_anti")
    if "columns" in store:
        gone_tables = store["tables"].join(gone, "program_id", "left_semi").select("table_id")
        kept["columns"] = store["columns"].join(gone_tables, "table_id", "left_anti")
    return kept


def soft_delete(df: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows marked hidden where their id is listed."""
    marked = ids.select(id_column).distinct().withColumn("_gone", F.lit(True))
    joined = df.join(marked, id_column, "left")
    return joined.withColumn("hidden", F.when(F.col("_gone"), F.lit(True)).otherwise(F.col("hidden"))).select(*df.columns)
