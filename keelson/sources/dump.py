"""Tab-separated metadata dumps: three files, each with one header line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.names import is_blank, strip
from keelson.functions.text import allow_null_text, key_flag, null_if_empty, type_or_variant

# File names of a dump.
DUMP_FILES = {"programs": "Programi.txt", "tables": "Tabele.txt", "columns": "Kolone.txt"}
# A separator that no line holds, so that each line is one value and the reader drops the header.
NO_SEPARATOR = "\x01"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file without its first one, as ``value``."""
    return (
        spark.read.schema("value STRING").option("header", True).option("enforceSchema", True)
        .option("sep", NO_SEPARATOR).option("quote", "").csv(path)
    )


def _fields(lines: DataFrame, least: int) -> DataFrame:
    parts = F.split(F.col("value"), "\t", -1)
    return lines.filter(~is_blank(F.col("value"))).select(parts.alias("_f")).filter(F.size("_f") >= least)


def _field(n: int) -> Column:
    """Trimmed field, NULL when the line is too short."""
    return strip(F.get("_f", F.lit(n)))


def _id(n: int) -> Column:
    text = _field(n)
    return F.when(text.rlike(r"^[+-]?\d+$"), text).try_cast("bigint")


def parse_programs(lines: DataFrame) -> DataFrame:
    return _fields(lines, 1).select(
        _id(0).alias("id"), F.coalesce(_field(1), F.lit("")).alias("name"), _field(2).alias("version"),
    ).filter(F.col("id").isNotNull())


def parse_tables(lines: DataFrame) -> DataFrame:
    return _fields(lines, 2).select(
        _id(0).alias("id"), _id(1).alias("program_id"), F.coalesce(_field(2), F.lit("")).alias("table_name"),
        _field(3).alias("version"),
    ).filter(F.col("id").isNotNull() & F.col("program_id").isNotNull())


def parse_columns(lines: DataFrame) -> DataFrame:
    return _fields(lines, 2).select(
        _id(0).alias("id"), _id(1).alias("table_id"), F.coalesce(_field(2), F.lit("")).alias("column_name"),
        type_or_variant(_field(3)).alias("type"), null_if_empty(_field(4)).alias("default_value"),
        null_if_empty(_field(5)).alias("field_size"), allow_null_text(_field(6)).alias("allow_null"),
        null_if_empty(_field(7)).alias("indexed"), key_flag(_field(8)).alias("is_key"),
    ).filter(F.col("id").isNotNull() & F.col("table_id").isNotNull())


def read_dump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Programs, tables and columns of a dump folder."""
    lines = {kind: read_lines(spark, f"{folder.rstrip('/')}/{name}") for kind, name in DUMP_FILES.items()}
    return parse_programs(lines["programs"]), parse_tables(lines["tables"]), parse_columns(lines["columns"])
