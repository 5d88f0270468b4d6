"""DDL text for whole fleets of tables, from catalog DataFrames.

Scripts are kept as lines, one row each, with columns that give their order, so a
schema of any number of tables is never gathered in one task; the writer sorts the
lines by range. The columns of one table meet in one row: that is the statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.names import as_value
from keelson.functions.text import fit_identifier, quote, quote_script, script_fk_name
from keelson.functions.types import fallback_ddl, is_auto_number, to_ddl
from keelson.operators.filters import complete_relations, visible
from keelson.operators.scale import number_within

CASCADE_BOTH = ("MySQL", "MariaDB", "SqlServer", "PostgreSQL", "Firebird")
CASCADE_DELETE = ("DB2", "Oracle")
# Targets whose exported script holds foreign keys.
SCRIPT_FK = ("MySQL", "MariaDB", "PostgreSQL", "SqlServer", "Oracle", "Firebird", "DB2")
HEADER, TABLES, KEYS = 0, 1, 2


def _is_key(df: DataFrame) -> Column:
    return F.coalesce(F.col("is_key"), F.lit(False)) | is_auto_number(F.col("type"))


def _table_lines(declared: DataFrame, target: str, scope: list[str]) -> DataFrame:
    """``scope``, table_name and ``lines``: the CREATE TABLE statement as structs of section, column_id and line.

    The columns of a table meet once, sorted; header, columns, key clause and end all follow from that list.
    """
    table = [*scope, "table_name"]
    kind = declared.schema["column_id"].dataType
    cols = declared.select(
        *table, F.struct(
            F.col("column_id").alias("id"), quote_script(target, F.col("column_name")).alias("name"),
            to_ddl(target, F.col("type"), F.col("field_size")).alias("type"),
            (F.coalesce("not_null", F.lit(False)) | _is_key(declared)).alias("required"), _is_key(declared).alias("key")).alias("_c"))
    tables = cols.groupBy(*table).agg(F.array_sort(F.collect_list("_c")).alias("_cols"))
    keys = F.filter("_cols", lambda c: c["key"])
    clause = F.lit(target != "SQLite") & (F.size(keys) > 0)

    def line(section: int, text: Column, column: Column | None = None) -> Column:
        own = F.lit(None).cast(kind) if column is None else column
        return F.struct(F.lit(section).alias("section"), own.alias("column_id"), text.alias("line"))

    def column_line(c: Column, i: Column) -> Column:
        comma = F.when((i + 1 == F.size("_cols")) & ~clause, F.lit("")).otherwise(F.lit(","))
        null = F.when(c["required"], F.lit(" NOT NULL")).otherwise(F.lit(""))
        return line(1, F.concat(F.lit("    "), c["name"], F.lit(" "), c["type"], null, comma), c["id"])

    key_line = line(2, F.concat(F.lit("    PRIMARY KEY ("), F.array_join(F.transform(keys, lambda c: c["name"]), ", "), F.lit(")")))
    suffix = " ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;" if target in ("MySQL", "MariaDB") else ";"
    head = line(0, F.concat(F.lit("CREATE TABLE "), quote_script(target, F.col("table_name")), F.lit(" (")))
    return tables.select(*table, F.concat(
        F.array(head), F.transform("_cols", column_line), F.filter(F.array(key_line), lambda _: clause),
        F.array(line(3, F.lit(")" + suffix)))).alias("lines"))


def create_lines(declared: DataFrame, target: str, scope: list[str]) -> DataFrame:
    """CREATE TABLE lines: ``scope``, table_name, section, column_id, line.

    ``declared`` holds the scope columns, table_name, column_id, column_name, type,
    not_null, is_key, field_size; column_id orders the columns of a table.
    """
    table = [*scope, "table_name"]
    return _table_lines(declared, target, scope).select(*table, F.explode("lines").alias("_l")).select(
        *table, "_l.section", "_l.column_id", "_l.line")


def create_statements(declared: DataFrame, target: str, scope: list[str]) -> DataFrame:
    """One CREATE TABLE text per table, as (scope, table_name, piece, text); a text is one piece at every width."""
    table = [*scope, "table_name"]
    return _table_lines(declared, target, scope).select(
        *table, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), F.lit(0).cast("bigint").alias("piece"))


def add_column_sql(target: str, table: Column, column: Column, type_text: Column, size: Column | int = 0) -> Column:
    """ALTER TABLE ... ADD for one column; an added column always allows NULL."""
    declared = fallback_ddl(target, type_text, size)
    t, c = (quote(target, fit_identifier(target, n)) if target == "Firebird" else quote(target, n)
            for n in (table, column))
    if target in ("MySQL", "MariaDB"):
        return F.concat(F.lit("ALTER TABLE "), t, F.lit(" ADD COLUMN "), c, F.lit(" "), declared, F.lit(" NULL"))
    if target == "SqlServer":
        return F.concat(F.lit("ALTER TABLE "), t, F.lit(" ADD "), c, F.lit(" "), declared, F.lit(" NULL"))
    if target == "PostgreSQL":
        return F.concat(F.lit("ALTER TABLE "), t, F.lit(" ADD COLUMN IF NOT EXISTS "), c, F.lit(" "), declared)
    if target == "Oracle":
        return F.concat(F.lit("ALTER TABLE "), t, F.lit(" ADD ("), c, F.lit(" "), declared, F.lit(")"))
    if target in ("Firebird", "DBase"):
        return F.concat(F.lit("ALTER TABLE "), t, F.lit(" ADD "), c, F.lit(" "), declared)
    return F.concat(F.lit("ALTER TABLE "), t, F.lit(" ADD COLUMN "), c, F.lit(" "), declared)


# Drop statements; names go in between the quotes as they are.
DROP_TABLE = {
    "Access": "DROP TABLE [{t}]",
    "SQLite": 'DROP TABLE IF EXISTS "{t}"',
    "MySQL": "DROP TABLE `{t}`",
    "MariaDB": "DROP TABLE `{t}`",
    "SqlServer": "IF OBJECT_ID(N'[dbo].[{t}]', 'U') IS NOT NULL\n    DROP TABLE [dbo].[{t}]",
    "PostgreSQL": 'DROP TABLE IF EXISTS "{t}"',
    "Firebird": 'DROP TABLE "{t}"',
    "DB2": 'DROP TABLE "{t}"',
    "Oracle": 'DROP TABLE "{t}"',
    "DBase": "DROP TABLE {t}",
}
DROP_COLUMN = {
    "Access": "ALTER TABLE [{t}] DROP COLUMN [{c}]",
    "SQLite": 'ALTER TABLE "{t}" DROP COLUMN "{c}"',
    "MySQL": "ALTER TABLE `{t}` DROP COLUMN `{c}`",
    "MariaDB": "ALTER TABLE `{t}` DROP COLUMN `{c}`",
    "SqlServer": "ALTER TABLE [dbo].[{t}] DROP COLUMN [{c}]",
    "PostgreSQL": 'ALTER TABLE "{t}" DROP COLUMN "{c}"',
    "Firebird": 'ALTER TABLE "{t}" DROP "{c}"',
    "DB2": 'ALTER TABLE "{t}" DROP COLUMN "{c}"',
    "Oracle": 'ALTER TABLE "{t}" DROP COLUMN "{c}"',
    "DBase": "ALTER TABLE {t} DROP COLUMN {c}",
}


def _filled(pattern: str, **names: Column) -> Column:
    """Text with ``{x}`` places filled from columns."""
    parts: list[Column] = []
    rest = pattern
    while rest:
        places = [(rest.index("{%s}" % n), n) for n in names if "{%s}" % n in rest]
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = min(places)
        parts += [F.lit(rest[:at]), names[name]]
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts)


def drop_table_sql(target: str, table: Column) -> Column:
    return _filled(DROP_TABLE[target], t=table)


def drop_column_sql(target: str, table: Column, column: Column) -> Column:
    return _filled(DROP_COLUMN[target], t=table, c=column)


def add_fk_sql(target: str, name: Column, child: Column, column: Column, parent: Column, parent_column: Column,
               cascade: Column) -> Column:
    """ALTER TABLE ... ADD CONSTRAINT ... FOREIGN KEY, with the cascade clause the target knows."""
    q = lambda c: quote(target, fit_identifier(target, c) if target == "Firebird" else c)
    clause = ""
    if target in CASCADE_BOTH:
        clause = " ON DELETE CASCADE ON UPDATE CASCADE"
    elif target in CASCADE_DELETE:
        clause = " ON DELETE CASCADE"
    return F.concat(
        F.lit("ALTER TABLE "), q(child), F.lit(" ADD CONSTRAINT "), q(name), F.lit(" FOREIGN KEY ("), q(column),
        F.lit(") REFERENCES "), q(parent), F.lit("("), q(parent_column), F.lit(")"),
        F.when(F.coalesce(cascade, F.lit(False)), F.lit(clause)).otherwise(F.lit("")))


def ddl_add(actions: DataFrame, target: str) -> DataFrame:
    """Statement per missing column of a diff."""
    sql = add_column_sql(target, F.col("table_name"), F.col("column_name"), F.col("type"), F.col("field_size"))
    return actions.filter(F.col("action") == "add_column").select("db", "table_name", "column_name", sql.alias("sql"))


def ddl_fk(relations: DataFrame, target: str) -> DataFrame:
    """Statement per relation; the parent column is ``parent_column`` or, without one, the field."""
    parent_column = F.coalesce("parent_column", "field") if "parent_column" in relations.columns else F.col("field")
    sql = add_fk_sql(target, F.col("fk_name"), F.col("child_table"), F.col("field"), F.col("parent_table"),
                     parent_column, F.col("cascade"))
    return relations.withColumn("sql", sql)


def cleanup_script(surplus: DataFrame, target: str) -> DataFrame:
    """Statement per surplus entry: a column drop, or one table drop for a wholly surplus table."""
    scope = [c for c in ("program_id", "db") if c in surplus.columns]
    columns = surplus.filter(~F.col("whole_table")).select(
        *scope, "table_name", "column_name",
        F.concat(drop_column_sql(target, F.col("table_name"), F.col("column_name")), F.lit(";")).alias("sql"))
    tables = surplus.filter(F.col("whole_table")).select(*scope, "table_name").distinct().select(
        *scope, "table_name", F.lit(None).cast("string").alias("column_name"),
        F.concat(drop_table_sql(target, F.col("table_name")), F.lit(";")).alias("sql"))
    return columns.unionByName(tables)


def script_lines(programs: DataFrame, declared: DataFrame, relations: DataFrame, target: str,
                 generated: Column | str) -> DataFrame:
    """Whole export script of each program as ordered lines.

    Sort by program_id, part, table_name, section, number: header, tables by name, then
    the foreign keys where the target has them, numbered in relation order.
    """
    stamp = as_value(generated)
    header = F.array(
        F.lit("-- Schema export"), F.concat(F.lit("-- Program : "), F.coalesce("name", F.lit(""))),
        F.lit(f"-- Backend : {target}"), F.concat(F.lit("-- Generated: "), stamp), F.lit(""))
    columns = ["program_id", "part", "table_name", "section", "number", "line"]
    none = F.lit(None).cast("bigint")
    head = programs.select("program_id", F.posexplode(header).alias("section", "line")).select(
        "program_id", F.lit(HEADER).alias("part"), F.lit("").alias("table_name"), "section", none.alias("number"), "line")
    lines = create_lines(declared, target, ["program_id"])
    blank = lines.filter(F.col("section") == 3).withColumns({"section": F.lit(4), "line": F.lit("")})
    body = lines.unionByName(blank).select(
        "program_id", F.lit(TABLES).alias("part"), "table_name", "section",
        F.col("column_id").cast("bigint").alias("number"), "line")
    script = head.unionByName(body)
    if target in SCRIPT_FK:
        relations = visible(relations)
        given = relations.select("program_id").distinct()
        title = given.select("program_id", F.posexplode(F.array(
            F.lit("-- Foreign key constraints"), F.lit(""))).alias("section", "line")).select(
            "program_id", F.lit(KEYS).alias("part"), F.lit("").alias("table_name"), "section",
            F.lit(0).cast("bigint").alias("number"), "line")
        numbered = number_within(complete_relations(relations), ["program_id"], ["relation_id"], "number")
        q = lambda c: quote_script(target, F.col(c))
        texts = F.array(
            F.concat(F.lit("ALTER TABLE "), q("child_table")),
            F.concat(F.lit("    ADD CONSTRAINT "),
                     script_fk_name(F.col("child_table"), F.col("field"), F.col("number"))),
            F.concat(F.lit("    FOREIGN KEY ("), q("field"), F.lit(") REFERENCES "), q("parent_table"),
                     F.lit(" ("), q("field"), F.lit(");")),
            F.lit(""))
        keys = numbered.select("program_id", "number", F.posexplode(texts).alias("section", "line")).select(
            "program_id", F.lit(KEYS).alias("part"), F.lit("").alias("table_name"), "section", "number", "line")
        script = script.unionByName(title).unionByName(keys)
    return script.select(*columns)


SCRIPT_ORDER = ["program_id", "part", "table_name", "number_group", "section", "number"]


def ordered_script(lines: DataFrame) -> DataFrame:
    """Script lines in reading order: key statements stay together by number, column lines by section."""
    by_number = F.when(F.col("part") == KEYS, F.col("number")).otherwise(F.lit(0))
    return lines.withColumn("number_group", by_number).orderBy(*SCRIPT_ORDER).drop("number_group")


def write_script(lines: DataFrame, path: str) -> None:
    """Text files whose names, read in order, give the script."""
    ordered_script(lines).select("line").write.mode("overwrite").text(path)


