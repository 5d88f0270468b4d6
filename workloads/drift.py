"""Schema drift of a fleet: live catalogs derived from part, against the schema of their program.

Every brand is a program, split into databases of a bounded number of parts, so that the number
of databases grows with the data. Drift comes from names that differ; all rows count. Where the columns
that databases lack are asked for, five programs share the brands: a database lacks what its
program declares for the parts of all its brands.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from keelson.operators import diff, filters
from keelson.operators.diff import FleetDiff
from keelson.plans import sync
from workloads.base import Query, Recipe, case_of, div, text

QUERIES: dict[str, Query] = {}

BRAND = "CAST(substring(p_brand, 7) AS BIGINT)"
DB = f"lower(p_brand) || '_' || CAST({div('p_partkey', 2000)} AS STRING)"
PROGRAM = BRAND
SHARED_PROGRAM = f"{BRAND} % 5 + 1"
BACKENDS = ["SQLite", "MySQL", "PostgreSQL", "Oracle", "DBase", "SqlServer"]
BACKEND = case_of(f"{BRAND} % 6", [text(b) for b in BACKENDS])
TABLE = "p_type || '_' || CAST(p_size % 4 AS STRING)"
COLUMN = "replace(p_name, ' ', '_')"

DATABASES = Recipe("part", {
    "db": DB, "program_id": PROGRAM, "backend": BACKEND,
    "error": f"CASE WHEN {BRAND} % 12 = 7 THEN 'no connection to ' || p_brand END",
}, distinct=True)
DECLARED = Recipe("part", {
    "program_id": PROGRAM, "table_name": TABLE, "column_id": "p_partkey",
    "column_name": f"CASE WHEN p_partkey % 3 = 0 THEN upper({COLUMN}) ELSE {COLUMN} END",
    "type": case_of("p_partkey % 6", ["'AutoNumber'", "'adLong'", "'adWChar'", "'adDate'", "'INT IDENTITY(1,1)'", "'adBoolean'"]),
    "not_null": "p_size % 2 = 0", "is_key": "p_partkey % 7 = 0", "field_size": "CAST(p_size * 10 AS INT)",
})
LIVE = Recipe("part", {
    "db": DB,
    "table_name": f"CASE WHEN p_size > 46 THEN 'old_' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN upper({TABLE}) ELSE lower({TABLE}) END",
    "position": "CAST(p_partkey % 2000 + 1 AS INT)",
    "column_name": f"CASE WHEN p_partkey % 4 = 0 THEN upper({COLUMN}) ELSE {COLUMN} END || CASE WHEN p_size BETWEEN 41 AND 46 THEN '_old' ELSE '' END",
    "sql_type": case_of("p_partkey % 4", ["'AutoNumber'", "'adLong'", "'adWChar'", None]),
    "not_null": "p_size % 2 = 0", "primary_key": "p_partkey % 9 = 0", "max_length": "p_size",
})
TYPES_OF_PART = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]
DECLARED_FKS = Recipe("part", {
    "relation_id": "p_partkey", "program_id": PROGRAM,
    "parent_table": case_of("p_partkey % 8", [*[f"'{t}_' || CAST(p_size % 4 AS STRING)" for t in TYPES_OF_PART], "'nowhere'", "''"]),
    "child_table": f"CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN lower({TABLE}) ELSE {TABLE} END",
    "field": f"CASE WHEN p_partkey % 13 = 0 THEN 'no_' ELSE '' END || {COLUMN}",
    "name": case_of("p_partkey % 3", ["''", f"'fk_' || {COLUMN}", None]),
    "cascade": "p_partkey % 2 = 0",
})
LIVE_FKS = Recipe("part", {
    "db": DB, "constraint_name": "'c' || CAST(p_partkey AS STRING)",
    "child_table": f"upper({TABLE})", "child_column": f"upper({COLUMN})",
    "parent_table": "CASE WHEN p_size > 20 THEN 'moved_' ELSE '' END || "
                    + case_of("p_partkey % 8", [*[f"'{t}_' || CAST(p_size % 4 AS STRING)" for t in TYPES_OF_PART], "'nowhere'", "''"]),
    "parent_column": "'id'",
})


def of_program(recipe: Recipe, program: str) -> Recipe:
    return replace(recipe, columns={**recipe.columns, "program_id": program})


def fleet(spark, sf, program: str = PROGRAM) -> FleetDiff:
    databases, declared, fks = (of_program(r, program).df(spark, sf) for r in (DATABASES, DECLARED, DECLARED_FKS))
    return FleetDiff(databases, declared, LIVE.df(spark, sf), fks, LIVE_FKS.df(spark, sf))


# ---- the same in SQL ----

AUTO = ("({c} IS NOT NULL AND (lower({c}) IN ('autonumber', 'autoincrement', 'autoinc', 'serial') OR lower({c}) LIKE '%identity%'"
        " OR lower({c}) LIKE '%generated%' OR lower({c}) LIKE '%auto#_increment%' ESCAPE '#'))")
BASE = f"""
    db AS ({DATABASES.sql}),
    d AS (SELECT program_id, lower(table_name) AS t, lower(column_name) AS c, min(column_id) AS column_id,
                 arg_min(table_name, column_id) AS table_name, arg_min(column_name, column_id) AS column_name,
                 arg_min(type, column_id) AS type, arg_min(not_null, column_id) AS not_null,
                 arg_min(is_key, column_id) AS is_key, arg_min(field_size, column_id) AS field_size
          FROM ({DECLARED.sql}) GROUP BY program_id, lower(table_name), lower(column_name)),
    dt AS (SELECT program_id, t, min(table_name) AS table_name, count(*) AS n_columns FROM d GROUP BY program_id, t),
    l AS (SELECT x.*, lower(table_name) AS t, lower(column_name) AS c, program_id FROM ({LIVE.sql}) x JOIN db USING (db)),
    lt AS (SELECT db, program_id, t, min(table_name) AS live_table FROM l GROUP BY db, program_id, t),
    missing_tables AS (SELECT db.db, program_id, dt.t, dt.table_name, n_columns FROM db JOIN dt USING (program_id)
        WHERE NOT EXISTS (SELECT 1 FROM lt WHERE lt.db = db.db AND lt.t = dt.t)),
    missing_columns AS (SELECT lt.db, program_id, d.* EXCLUDE (program_id) FROM lt JOIN d USING (program_id, t)
        WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.db = lt.db AND l.t = d.t AND l.c = d.c)),
    surplus_columns AS (SELECT l.db, program_id, dt.table_name, l.column_name, l.position FROM l JOIN dt USING (program_id, t)
        WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.program_id = l.program_id AND d.t = l.t AND d.c = l.c)),
    surplus_tables AS (SELECT db, program_id, t, live_table AS table_name FROM lt
        WHERE NOT EXISTS (SELECT 1 FROM dt WHERE dt.program_id = lt.program_id AND dt.t = lt.t)),
    mismatches AS (SELECT l.db, program_id, d.table_name, d.column_name, d.type, l.sql_type AS live_type
        FROM l JOIN d USING (program_id, t, c) WHERE {AUTO.format(c='d.type')} AND NOT {AUTO.format(c='l.sql_type')}),
    rel AS (SELECT * FROM ({DECLARED_FKS.sql}) WHERE COALESCE(child_table, '') <> '' AND COALESCE(field, '') <> ''
            AND COALESCE(parent_table, '') <> ''),
    lf AS (SELECT db, lower(child_table) AS ct, lower(child_column) AS cf, lower(parent_table) AS pt FROM ({LIVE_FKS.sql})),
    missing_fks AS (SELECT db.db, program_id, rel.* EXCLUDE (program_id) FROM db JOIN rel USING (program_id)
        WHERE backend NOT IN ('SQLite', 'DBase') AND NOT EXISTS (SELECT 1 FROM lf WHERE lf.db = db.db
            AND ct = lower(child_table) AND cf = lower(field) AND pt = lower(parent_table))),
    has_t AS (SELECT db, t FROM lt UNION SELECT db, t FROM db JOIN dt USING (program_id)),
    has_c AS (SELECT db, t, c FROM l UNION SELECT db, t, c FROM db JOIN d USING (program_id)),
    fks AS (SELECT m.db, program_id, child_table, field, parent_table,
                CASE WHEN trim(COALESCE(name, '')) = '' THEN 'FK_' || child_table || '_' || parent_table ELSE name END AS fk_name,
                cascade, CASE
                WHEN NOT EXISTS (SELECT 1 FROM has_t h WHERE h.db = m.db AND h.t = lower(child_table))
                  OR NOT EXISTS (SELECT 1 FROM has_t h WHERE h.db = m.db AND h.t = lower(parent_table)) THEN 'table not found'
                WHEN NOT EXISTS (SELECT 1 FROM has_c h WHERE h.db = m.db AND h.t = lower(child_table) AND h.c = lower(field))
                THEN 'column not found' END AS reason
            FROM missing_fks m),
    actions AS (
        SELECT db, 'create_table' AS action, table_name, NULL AS column_name, NULL AS type, NULL AS not_null, NULL AS is_key,
               NULL AS field_size, NULL AS position, n_columns, NULL AS parent_table, NULL AS fk_name, NULL AS cascade, NULL AS reason
        FROM missing_tables
        UNION ALL SELECT db, 'add_column', table_name, column_name, type, not_null, is_key, field_size, column_id, NULL, NULL, NULL, NULL, NULL
        FROM missing_columns
        UNION ALL SELECT db, 'surplus_column', table_name, column_name, NULL, NULL, NULL, NULL, position, NULL, NULL, NULL, NULL, NULL
        FROM surplus_columns
        UNION ALL SELECT db, 'surplus_table', table_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM surplus_tables
        UNION ALL SELECT db, 'identity_mismatch', table_name, column_name, type, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
               'live type ' || COALESCE(live_type, '') FROM mismatches
        UNION ALL SELECT db, CASE WHEN reason IS NULL THEN 'add_fk' ELSE 'skip_fk' END, child_table, field, NULL, NULL, NULL, NULL, NULL,
               NULL, parent_table, fk_name, cascade, reason FROM fks)"""


SHARED_BASE = BASE
for _recipe in (DATABASES, DECLARED, DECLARED_FKS):
    SHARED_BASE = SHARED_BASE.replace(f"({_recipe.sql})", f"({of_program(_recipe, SHARED_PROGRAM).sql})")


def _sql(select: str) -> str:
    return f"WITH {BASE} {select}"


QUERIES["fleet_missing_tables"] = Query(
    lambda spark, sf: fleet(spark, sf).missing_tables.drop("_t"),
    _sql("SELECT db, program_id, table_name, n_columns FROM missing_tables"))
QUERIES["fleet_missing_columns"] = Query(
    lambda spark, sf: fleet(spark, sf, SHARED_PROGRAM).missing_columns.drop("_t", "_c"),
    f"WITH {SHARED_BASE} SELECT * EXCLUDE (t, c) FROM missing_columns")
QUERIES["fleet_surplus_columns"] = Query(
    lambda spark, sf: fleet(spark, sf).surplus_columns, _sql("SELECT * FROM surplus_columns"))
QUERIES["fleet_surplus_tables"] = Query(
    lambda spark, sf: fleet(spark, sf).surplus_table_columns,
    _sql("SELECT l.db, l.program_id, l.table_name, column_name, position FROM l JOIN surplus_tables s ON s.db = l.db AND s.t = l.t"))
QUERIES["fleet_surplus_register"] = Query(
    lambda spark, sf: fleet(spark, sf).surplus(),
    _sql("""SELECT program_id, db, table_name, column_name, FALSE AS whole_table FROM surplus_columns
    UNION ALL SELECT l.program_id, l.db, l.table_name, column_name, TRUE FROM l JOIN surplus_tables s ON s.db = l.db AND s.t = l.t"""))
QUERIES["identity_mismatch"] = Query(
    lambda spark, sf: fleet(spark, sf).identity_mismatches, _sql("SELECT * FROM mismatches"))
QUERIES["fleet_missing_fks"] = Query(
    lambda spark, sf: fleet(spark, sf).missing_fks.select(
        "db", "program_id", "child_table", "field", "parent_table", "name", "cascade"),
    _sql("SELECT db, program_id, child_table, field, parent_table, name, cascade FROM missing_fks"))
QUERIES["fk_applicability"] = Query(lambda spark, sf: fleet(spark, sf).fks_to_apply, _sql("SELECT * FROM fks"))
QUERIES["fleet_diff_all"] = Query(lambda spark, sf: fleet(spark, sf).actions, _sql("SELECT * FROM actions"))

OK_DB = BASE.replace(f"db AS ({DATABASES.sql})",
                     f"all_db AS ({DATABASES.sql}), db AS (SELECT * FROM all_db WHERE error IS NULL)", 1)
REPORT = """
    n AS (SELECT db, count(*) FILTER (WHERE action = 'create_table') AS tables_created,
                 count(*) FILTER (WHERE action = 'add_column') AS columns_added, count(*) FILTER (WHERE action = 'add_fk') AS fks_added,
                 count(*) FILTER (WHERE action = 'surplus_table') AS tables_dropped,
                 count(*) FILTER (WHERE action = 'surplus_column') AS columns_dropped FROM actions GROUP BY db),
    report AS (SELECT db, backend, error, COALESCE(tables_created, 0) AS tables_created, COALESCE(columns_added, 0) AS columns_added,
                 COALESCE(fks_added, 0) AS fks_added, {drop_t} AS tables_dropped, {drop_c} AS columns_dropped
               FROM all_db LEFT JOIN n USING (db)),
    final AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'Error: ' || error ELSE
                 '+' || tables_created || 't  +' || columns_added || 'c  +' || fks_added || 'fk' || CASE WHEN tables_dropped + columns_dropped > 0
                 THEN '  -' || tables_dropped || 't  -' || columns_dropped || 'c' ELSE '' END END AS status FROM report)"""
KEEP = REPORT.format(drop_t="0", drop_c="0")
DROP = REPORT.format(drop_t="COALESCE(tables_dropped, 0)", drop_c="COALESCE(columns_dropped, 0)")


def _report(delete_redundant):
    def run(spark, sf):
        return sync.fleet_sync(DATABASES.df(spark, sf), DECLARED.df(spark, sf), LIVE.df(spark, sf),
                               DECLARED_FKS.df(spark, sf), LIVE_FKS.df(spark, sf), delete_redundant)[1]
    return run


QUERIES["fleet_summary"] = Query(_report(False), f"WITH {OK_DB}, {KEEP} SELECT * FROM final")
QUERIES["fleet_summary_with_drops"] = Query(_report(True), f"WITH {OK_DB}, {DROP} SELECT * FROM final")
QUERIES["fleet_totals"] = Query(
    lambda spark, sf: diff.totals(_report(False)(spark, sf)),
    f"WITH {OK_DB}, {KEEP} SELECT count(*) FILTER (WHERE error IS NULL) AS n_ok, count(*) FILTER (WHERE error IS NOT NULL) AS n_failed FROM final")
QUERIES["apply_order"] = Query(
    lambda spark, sf: sync.apply_plan(fleet(spark, sf).actions, delete_redundant=True),
    _sql("""SELECT db, CASE action WHEN 'create_table' THEN 1 WHEN 'add_column' THEN 2 WHEN 'surplus_column' THEN 3
        WHEN 'surplus_table' THEN 4 WHEN 'add_fk' THEN 5 ELSE 6 END AS step, action, table_name, column_name, position, reason
    FROM actions WHERE action <> 'identity_mismatch'"""))


# ---- tables without columns, declared and live ----

EMPTY_DECLARED = Recipe("part", {
    "program_id": PROGRAM, "table_name": f"CASE WHEN p_size > 48 THEN 'OLD_' || {TABLE} WHEN p_size < 5 THEN 'bare_' || p_type ELSE {TABLE} END"}, distinct=True)
EMPTY_LIVE = Recipe("part", {
    "db": DB, "table_name": f"CASE WHEN p_size = 3 THEN 'Bare_' || p_type WHEN p_size = 7 THEN 'stray_' || p_type ELSE lower({TABLE}) END"}, distinct=True)


def _empty_tables(spark, sf):
    found = FleetDiff(DATABASES.df(spark, sf), DECLARED.df(spark, sf), LIVE.df(spark, sf), tables=EMPTY_DECLARED.df(spark, sf),
                      live_tables=EMPTY_LIVE.df(spark, sf)).settled()
    missing = found.missing_tables.select(F.lit("missing").alias("kind"), "db", "program_id", "_t", "n_columns")
    return missing.unionByName(found.surplus_tables.select(F.lit("surplus").alias("kind"), "db", "program_id", "_t", F.lit(0).cast("long").alias("n_columns"))
                               ).withColumnRenamed("_t", "table_name")


QUERIES["fleet_empty_tables"] = Query(_empty_tables, f"""
    WITH db AS ({DATABASES.sql}),
    d AS (SELECT program_id, lower(table_name) AS t, count(DISTINCT lower(column_name)) AS n FROM ({DECLARED.sql}) GROUP BY ALL),
    dt AS (SELECT program_id, t, max(n) AS n_columns FROM (SELECT * FROM d UNION ALL SELECT program_id, lower(table_name), 0 FROM ({EMPTY_DECLARED.sql})) GROUP BY ALL),
    lt AS (SELECT DISTINCT db, program_id, t FROM (SELECT db, lower(table_name) AS t FROM ({LIVE.sql}) UNION ALL SELECT db, lower(table_name) FROM ({EMPTY_LIVE.sql}))
           JOIN db USING (db))
    SELECT 'missing' AS kind, db.db, program_id, t AS table_name, n_columns FROM db JOIN dt USING (program_id)
    WHERE NOT EXISTS (SELECT 1 FROM lt WHERE lt.db = db.db AND lt.t = dt.t)
    UNION ALL SELECT 'surplus', db, program_id, t, 0 FROM lt WHERE NOT EXISTS (SELECT 1 FROM dt WHERE dt.program_id = lt.program_id AND dt.t = lt.t)""")

# ---- names on both sides ----

def _status(spark, sf):
    live = LIVE.df(spark, sf).join(DATABASES.df(spark, sf), "db")
    return diff.name_status(DECLARED.df(spark, sf), live, ["program_id"], "table_name")


QUERIES["name_status"] = Query(_status, f"""
    WITH a AS (SELECT program_id, lower(table_name) AS k, min(table_name) AS n FROM ({DECLARED.sql}) GROUP BY ALL),
    b AS (SELECT program_id, lower(table_name) AS k, min(table_name) AS n FROM ({LIVE.sql}) JOIN ({DATABASES.sql}) USING (db) GROUP BY ALL)
    SELECT program_id, COALESCE(a.n, b.n) AS table_name,
           CASE WHEN b.n IS NULL THEN 'create' WHEN a.n IS NULL THEN 'surplus' ELSE 'shared' END AS status
    FROM a FULL JOIN b USING (program_id, k)""")

OTHER = Recipe("part", {
    "db": DB, "table_name": f"CASE WHEN p_size % 4 = 3 THEN {TABLE} ELSE upper({TABLE}) END", "position": "CAST(p_partkey % 2000 + 1 AS INT)",
    "column_name": f"CASE WHEN p_size % 4 = 3 OR p_size > 40 THEN 'other_' ELSE '' END || upper({COLUMN})",
})
QUERIES["common_columns"] = Query(
    lambda spark, sf: filters.match_columns(LIVE.df(spark, sf), OTHER.df(spark, sf)).select(
        "db", "table_name", "position", "source_column", F.upper("target_column").alias("target_column")),
    f"""WITH o AS (SELECT DISTINCT db, lower(table_name) AS t, upper(column_name) AS c FROM ({OTHER.sql}))
    SELECT l.db, l.table_name, position, column_name AS source_column, o.c AS target_column
    FROM ({LIVE.sql}) l JOIN o ON o.db = l.db AND o.t = lower(l.table_name) AND o.c = upper(l.column_name)""")
QUERIES["skipped_tables"] = Query(
    lambda spark, sf: filters.tables_without_match(LIVE.df(spark, sf), OTHER.df(spark, sf)),
    f"""WITH o AS (SELECT DISTINCT db, lower(table_name) AS t, upper(column_name) AS c FROM ({OTHER.sql})), l AS ({LIVE.sql})
    SELECT DISTINCT db, table_name FROM l WHERE NOT EXISTS (
        SELECT 1 FROM l l2 JOIN o ON o.db = l2.db AND o.t = lower(l2.table_name) AND o.c = upper(l2.column_name)
        WHERE l2.db = l.db AND lower(l2.table_name) = lower(l.table_name))""")
