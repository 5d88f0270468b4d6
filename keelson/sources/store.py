"""The declared schema as stored metadata, and its flat form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import to_int_or_zero
from keelson.operators.filters import complete_relations, visible
from keelson.operators.scale import salted_join

PROGRAMS = "program_id BIGINT, name STRING, version STRING, hidden BOOLEAN"
TABLES = "table_id BIGINT, program_id BIGINT, table_name STRING, version STRING, hidden BOOLEAN"
COLUMNS = (
    "column_id BIGINT, table_id BIGINT, column_name STRING, type STRING, default_value STRING, "
    "field_size STRING, allow_null STRING, indexed STRING, is_key BOOLEAN, hidden BOOLEAN"
)
RELATIONS = (
    "relation_id BIGINT, program_id BIGINT, parent_table STRING, child_table STRING, field STRING, "
    "name STRING, cascade BOOLEAN, hidden BOOLEAN"
)
SURPLUS = "program_id BIGINT, db STRING, table_name STRING, column_name STRING, whole_table BOOLEAN"
RENAMES = "id BIGINT, program_id BIGINT, old_name STRING, new_name STRING, version STRING"
TYPES = "type STRING"
DICTIONARY = "entry_id BIGINT, lang_id STRING, original STRING, translation STRING, hidden BOOLEAN"


def declared_schema(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Visible tables and columns of all programs, one row per column.

    Nullability is the exact text ``No``; an unreadable field size is 0.
    """
    names = visible(tables).select("program_id", "table_id", "table_name")
    rows = visible(columns).select(
        "table_id", "column_id", "column_name", F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce(F.col("allow_null") == "No", F.lit(False)).alias("not_null"),
        F.coalesce("is_key", F.lit(False)).alias("is_key"),
        to_int_or_zero(F.col("field_size")).alias("field_size"))
    return salted_join(rows, names, ["table_id"], "inner", F.col("column_id")).drop("table_id")


def declared_relations(relations: DataFrame) -> DataFrame:
    return complete_relations(visible(relations))
