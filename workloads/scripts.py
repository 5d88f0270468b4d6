"""DDL text for catalogs derived from part."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import ddl
from workloads import drift
from workloads.base import Query, Recipe, case_of, div, text
from workloads.typing_rules import ANY, BASE, DDL, IDENTITY, TO_DDL, _known, _ranked

QUERIES: dict[str, Query] = {}

TYPES = ["'AutoNumber'", "'adLong'", "'adWChar'", "'adDate'", "'varchar(30)'", "'adBoolean'", "'numeric(10,2)'", "'bigint'", "''", "'mystery'"]
TABLES = Recipe("part", {
    "db": drift.DB, "table_name": f"{drift.TABLE} || CASE WHEN p_size % 4 = 1 THEN ' `x` \"y\"' ELSE '' END", "column_id": "p_partkey",
    "column_name": f"{drift.COLUMN} || '_' || CAST(p_partkey AS STRING)", "type": case_of("p_partkey % 10", TYPES),
    "not_null": "p_size % 3 = 0", "is_key": "p_partkey % 11 = 0", "field_size": "CAST(p_size * 10 - 10 AS INT)",
})

QUOTE = {"MySQL": "'`' || replace({}, '`', '``') || '`'", "SQLite": "'\"' || replace({}, '\"', '\"\"') || '\"'"}
QUOTE |= {"Oracle": QUOTE["SQLite"], "PostgreSQL": QUOTE["SQLite"]}
AUTO = drift.AUTO.format(c="type")


def typed(recipe_sql: str, target: str) -> str:
    """CTEs ending in d: the recipe's rows with the declared type on the target."""
    return (f"{_known()}, {_ranked()}, {ANY}, {DDL}, {IDENTITY}, x AS (SELECT *, {BASE} AS base FROM "
            f"(SELECT *, type AS type_text, field_size AS size, '{target}' AS backend FROM ({recipe_sql}))), {TO_DDL}")


def create_sql(recipe_sql: str, target: str, scope: str) -> str:
    """CTEs ending in parts: (scope, table_name, section, column_id, line)."""
    q = QUOTE[target]
    suffix = " ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;" if target == "MySQL" else ";"
    clause = "FALSE" if target == "SQLite" else "bool_or(is_pk)"
    return f"""{typed(recipe_sql, target)},
    k AS (SELECT *, COALESCE(is_key, FALSE) OR {AUTO} AS is_pk FROM d),
    s AS (SELECT {scope}, table_name, max(column_id) AS last_id, {clause} AS has_clause,
                 string_agg({q.format('column_name')}, ', ' ORDER BY column_id) FILTER (WHERE is_pk) AS pk FROM k GROUP BY {scope}, table_name),
    parts AS (
        SELECT {scope}, table_name, 0 AS section, CAST(NULL AS BIGINT) AS column_id, 'CREATE TABLE ' || {q.format('table_name')} || ' (' AS line FROM s
        UNION ALL SELECT {scope}, table_name, 1, column_id, '    ' || {q.format('column_name')} || ' ' || declared
            || CASE WHEN not_null OR is_pk THEN ' NOT NULL' ELSE '' END || CASE WHEN column_id = last_id AND NOT has_clause THEN '' ELSE ',' END
            FROM k JOIN s USING ({scope}, table_name)
        UNION ALL SELECT {scope}, table_name, 2, NULL, '    PRIMARY KEY (' || pk || ')' FROM s WHERE has_clause
        UNION ALL SELECT {scope}, table_name, 3, NULL, '){suffix}' FROM s)"""


def _create(target):
    return lambda spark, sf: ddl.create_statements(TABLES.df(spark, sf), target, ["db"])


for _target in ("MySQL", "SQLite", "Oracle"):
    QUERIES[f"ddl_create_{_target.lower()}"] = Query(_create(_target), f"""
        WITH {create_sql(TABLES.sql, _target, 'db')}
        SELECT db, table_name, CAST(0 AS BIGINT) AS piece, string_agg(line, chr(10) ORDER BY section, column_id) AS text
        FROM parts GROUP BY db, table_name""")
QUERIES["ddl_create_lines"] = Query(
    lambda spark, sf: ddl.create_lines(TABLES.df(spark, sf), "PostgreSQL", ["db"]),
    f"WITH {create_sql(TABLES.sql, 'PostgreSQL', 'db')} SELECT * FROM parts")

# ---- one statement per change ----

TARGETS = ("SQLite", "Access", "MySQL", "SqlServer", "PostgreSQL", "Oracle", "Firebird", "DB2")


def _add(spark, sf):
    df = TABLES.df(spark, sf)
    return df.select("db", "column_id", *[
        ddl.add_column_sql(t, F.col("table_name"), F.col("column_name"), F.lit("adWChar"), F.col("field_size")).alias(f"on_{t.lower()}")
        for t in TARGETS])


def _sized(word, unsized, limit=None):
    size = f"least(field_size, {limit})" if limit else "field_size"
    return f"CASE WHEN field_size > 0 THEN '{word}(' || {size} || ')' ELSE '{unsized}' END"


DOUBLE, BACK = QUOTE["SQLite"], QUOTE["MySQL"]
SQUARE = "'[' || replace({}, ']', ']]') || ']'"
QUERIES["ddl_add"] = Query(_add, f"""
    WITH x AS ({TABLES.sql})
    SELECT db, column_id,
        'ALTER TABLE ' || {DOUBLE.format('table_name')} || ' ADD COLUMN ' || {DOUBLE.format('column_name')} || ' TEXT' AS on_sqlite,
        'ALTER TABLE [' || table_name || '] ADD COLUMN [' || column_name || '] ' || CASE WHEN field_size BETWEEN 1 AND 255
            THEN 'VARCHAR(' || field_size || ')' ELSE 'LONGTEXT' END AS on_access,
        'ALTER TABLE ' || {BACK.format('table_name')} || ' ADD COLUMN ' || {BACK.format('column_name')} || ' ' || {_sized('VARCHAR', 'LONGTEXT')} || ' NULL' AS on_mysql,
        'ALTER TABLE ' || {SQUARE.format('table_name')} || ' ADD ' || {SQUARE.format('column_name')} || ' ' || {_sized('NVARCHAR', 'NVARCHAR(MAX)')} || ' NULL' AS on_sqlserver,
        'ALTER TABLE ' || {DOUBLE.format('table_name')} || ' ADD COLUMN IF NOT EXISTS ' || {DOUBLE.format('column_name')} || ' ' || {_sized('VARCHAR', 'TEXT')} AS on_postgresql,
        'ALTER TABLE ' || {DOUBLE.format('upper(table_name)')} || ' ADD (' || {DOUBLE.format('upper(column_name)')} || ' ' || {_sized('VARCHAR2', 'CLOB', 4000)} || ')' AS on_oracle,
        'ALTER TABLE ' || {DOUBLE.format('rtrim(left(table_name, 31))')} || ' ADD ' || {DOUBLE.format('rtrim(left(column_name, 31))')} || ' ' || {_sized('VARCHAR', 'BLOB SUB_TYPE TEXT', 32765)} AS on_firebird,
        'ALTER TABLE ' || {DOUBLE.format('table_name')} || ' ADD COLUMN ' || {DOUBLE.format('column_name')} || ' ' || {_sized('VARCHAR', 'CLOB(1M)', 32672)} AS on_db2
    FROM x""")
QUERIES["ddl_add_fleet"] = Query(
    lambda spark, sf: ddl.ddl_add(drift.fleet(spark, sf, drift.SHARED_PROGRAM).actions, "PostgreSQL"),
    f"""WITH {drift.SHARED_BASE}
    SELECT db, table_name, column_name, 'ALTER TABLE "' || table_name || '" ADD COLUMN IF NOT EXISTS "' || column_name || '" ' || CASE
        WHEN type IN ('AutoNumber', 'INT IDENTITY(1,1)') THEN 'SERIAL' WHEN type = 'adLong' THEN 'INTEGER' WHEN type = 'adWChar'
        THEN 'VARCHAR(' || field_size || ')' WHEN type = 'adDate' THEN 'TIMESTAMP' ELSE 'BOOLEAN' END AS sql FROM missing_columns""")


def _drop(spark, sf):
    t, c = F.col("table_name"), F.col("column_name")
    return TABLES.df(spark, sf).select(
        "db", "column_id", *[ddl.drop_table_sql(b, t).alias(f"table_{b.lower()}") for b in ddl.DROP_TABLE],
        *[ddl.drop_column_sql(b, t, c).alias(f"column_{b.lower()}") for b in ddl.DROP_COLUMN])


def _drop_sql():
    cols = []
    for kind, patterns in (("table", ddl.DROP_TABLE), ("column", ddl.DROP_COLUMN)):
        for b, pattern in patterns.items():
            cols.append(f"replace(replace({text(pattern)}, '{{c}}', column_name), '{{t}}', table_name) AS {kind}_{b.lower()}")
    return f"WITH x AS ({TABLES.sql}) SELECT db, column_id, {', '.join(cols)} FROM x"


QUERIES["ddl_drop"] = Query(_drop, _drop_sql())


def _fk(spark, sf):
    from keelson.operators.filters import complete_relations
    rel = complete_relations(drift.DECLARED_FKS.df(spark, sf)).withColumn("fk_name", F.concat(F.lit("fk "), F.col("relation_id").cast("string")))
    return rel.select("relation_id", *[
        ddl.add_fk_sql(t, F.col("fk_name"), F.col("child_table"), F.col("field"), F.col("parent_table"), F.col("field"), F.col("cascade")).alias(f"on_{t.lower()}")
        for t in ("MySQL", "PostgreSQL", "SqlServer", "DB2", "Oracle", "Access")])


def _fk_sql(open_, close, up, cascade):
    name = lambda c: f"'{open_}' || {'upper(' + c + ')' if up else c} || '{close}'"
    return (f"'ALTER TABLE ' || {name('child_table')} || ' ADD CONSTRAINT ' || {name('fk')} || ' FOREIGN KEY (' || {name('field')} || ') REFERENCES '"
            f" || {name('parent_table')} || '(' || {name('field')} || ')' || CASE WHEN cascade THEN '{cascade}' ELSE '' END")


BOTH, ONE = " ON DELETE CASCADE ON UPDATE CASCADE", " ON DELETE CASCADE"
QUERIES["ddl_fk"] = Query(_fk, f"""
    WITH r AS (SELECT *, 'fk ' || relation_id AS fk FROM ({drift.DECLARED_FKS.sql}) WHERE COALESCE(child_table, '') <> ''
               AND COALESCE(field, '') <> '' AND COALESCE(parent_table, '') <> '')
    SELECT relation_id, {_fk_sql('`', '`', False, BOTH)} AS on_mysql, {_fk_sql('"', '"', False, BOTH)} AS on_postgresql,
           {_fk_sql('[', ']', False, BOTH)} AS on_sqlserver, {_fk_sql('"', '"', False, ONE)} AS on_db2,
           {_fk_sql('"', '"', True, ONE)} AS on_oracle, {_fk_sql('[', ']', False, '')} AS on_access FROM r""")

# ---- whole scripts ----

PROGRAMS = Recipe("part", {"program_id": drift.PROGRAM, "name": f"'program ' || CAST({drift.PROGRAM} AS STRING)"}, distinct=True)
PROGRAM_TABLES = Recipe("part", {
    **TABLES.columns, "program_id": drift.PROGRAM, "table_name": f"{drift.TABLE} || '_' || CAST({div('p_partkey', 200)} AS STRING)"})
RELATIONS = Recipe("part", {**drift.DECLARED_FKS.columns, "hidden": case_of("p_partkey % 5", ["TRUE", "FALSE", "FALSE", "FALSE", None])})
STAMP = "2024-01-01 00:00:00"
HEADER = ["-- Schema export", "'-- Program : ' || name", "-- Backend : MySQL", f"-- Generated: {STAMP}", ""]
QUERIES["ddl_script"] = Query(
    lambda spark, sf: ddl.script_lines(PROGRAMS.df(spark, sf), PROGRAM_TABLES.df(spark, sf).drop("db"), RELATIONS.df(spark, sf), "MySQL", STAMP),
    f"""WITH {create_sql(PROGRAM_TABLES.sql, 'MySQL', 'program_id')},
    rel AS (SELECT * FROM ({RELATIONS.sql}) WHERE hidden IS DISTINCT FROM TRUE),
    n AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY relation_id) AS number FROM rel
          WHERE COALESCE(child_table, '') <> '' AND COALESCE(field, '') <> '' AND COALESCE(parent_table, '') <> ''),
    p AS ({PROGRAMS.sql})
    {' UNION ALL '.join(f"SELECT program_id, 0 AS part, '' AS table_name, {i} AS section, CAST(NULL AS BIGINT) AS number, {h if h.startswith(chr(39)) else text(h)} AS line FROM p" for i, h in enumerate(HEADER))}
    UNION ALL SELECT program_id, 1, table_name, section, column_id, line FROM parts
    UNION ALL SELECT program_id, 1, table_name, 4, NULL, '' FROM s
    UNION ALL SELECT DISTINCT program_id, 2, '', 0, 0, '-- Foreign key constraints' FROM rel
    UNION ALL SELECT DISTINCT program_id, 2, '', 1, 0, '' FROM rel
    UNION ALL SELECT program_id, 2, '', 0, number, 'ALTER TABLE `' || child_table || '`' FROM n
    UNION ALL SELECT program_id, 2, '', 1, number, '    ADD CONSTRAINT fk_' || child_table || '_' || field || '_' || number FROM n
    UNION ALL SELECT program_id, 2, '', 2, number, '    FOREIGN KEY (`' || field || '`) REFERENCES `' || parent_table || '` (`' || field || '`);' FROM n
    UNION ALL SELECT program_id, 2, '', 3, number, '' FROM n""")
QUERIES["ddl_cleanup"] = Query(
    lambda spark, sf: ddl.cleanup_script(drift.fleet(spark, sf).surplus(), "Firebird").drop("column_name").distinct(),
    f"""WITH {drift.BASE}
    SELECT DISTINCT program_id, db, table_name, 'ALTER TABLE "' || table_name || '" DROP "' || column_name || '";' AS sql FROM surplus_columns
    UNION ALL SELECT DISTINCT s.program_id, s.db, l.table_name, 'DROP TABLE "' || l.table_name || '";'
    FROM l JOIN surplus_tables s ON s.db = l.db AND s.t = l.t""")
