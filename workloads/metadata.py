"""Stored schema metadata: filters, guards, renames, merges, registers, dictionary.

The stores and the dump lines are derived from part, supplier and documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import dictionary, filters, ingest, relations
from keelson.sources import dump
from keelson.sources.store import declared_schema
from workloads import drift
from workloads.base import Query, Recipe, case_of, div

QUERIES: dict[str, Query] = {}

HIDDEN = case_of("p_partkey % 7", ["TRUE", "FALSE", "FALSE", "FALSE", "FALSE", "FALSE", None])
COLUMN = "replace(p_name, ' ', '_')"
STORE_PROGRAMS = Recipe("supplier", {
    "program_id": "s_suppkey + 1", "name": "'prog ' || CAST(s_suppkey % 60 AS STRING)", "version": "'v' || CAST(s_nationkey AS STRING)",
    "hidden": case_of("s_suppkey % 6", ["TRUE", "FALSE", "FALSE", "FALSE", "FALSE", None])})
STORE_TABLES = Recipe("part", {
    "table_id": "p_partkey + 1", "program_id": "p_partkey % 50 + 1",
    "table_name": "CASE p_partkey % 13 WHEN 0 THEN 'MSys' WHEN 1 THEN 'msYS' ELSE '' END || p_type || '_' || CAST(p_size AS STRING)",
    "version": "CAST(p_size AS STRING)", "hidden": HIDDEN})
STORE_COLUMNS = Recipe("part", {
    "column_id": "p_partkey + 1", "table_id": f"{div('p_partkey', 2)} + 1", "column_name": COLUMN,
    "type": case_of("p_partkey % 5", ["'adLong'", "'adWChar'", "'AutoNumber'", "'adDate'", None]), "default_value": "CAST(NULL AS STRING)",
    "field_size": case_of("p_size % 4", ["'20'", "' 30 '", "'x'", None]), "allow_null": case_of("p_size % 3", ["'No'", "'YES'", "'NO'"]),
    "indexed": "CAST(NULL AS STRING)", "is_key": "CASE WHEN p_partkey % 3 = 0 THEN TRUE WHEN p_partkey % 3 = 1 THEN FALSE END", "hidden": HIDDEN})
RELATIONS = Recipe("part", {
    "relation_id": "p_partkey", "program_id": "p_partkey % 50 + 1",
    "parent_table": case_of("p_partkey % 6", ["p_type || '_' || CAST(p_size AS STRING)", "p_type || '_1'", "p_type || '_2'", "p_type || '_3'", "''", None]),
    "child_table": "p_type || '_' || CAST(p_size % 9 AS STRING)", "field": f"CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 19 = 1 THEN '' ELSE {COLUMN} END",
    "name": "'r' || CAST(p_partkey AS STRING)", "cascade": "p_partkey % 2 = 0", "hidden": HIDDEN})
TYPES = Recipe("nation", {"type": case_of("n_nationkey % 4", ["'adLong'", "'ADWCHAR'", "'autonumber'", "'adGUID'"])}, distinct=True)
CHOSEN = Recipe("supplier", {"program_id": "s_nationkey + 1"}, distinct=True)
SHOWN = "hidden IS DISTINCT FROM TRUE"

# ---- filters ----

QUERIES["visible_rows"] = Query(
    lambda spark, sf: filters.without_system_tables(filters.visible(STORE_TABLES.df(spark, sf))),
    f"SELECT * FROM ({STORE_TABLES.sql}) WHERE {SHOWN} AND table_name NOT ILIKE 'msys%'")
QUERIES["complete_relations"] = Query(
    lambda spark, sf: filters.complete_relations(filters.visible(RELATIONS.df(spark, sf))),
    f"SELECT * FROM ({RELATIONS.sql}) WHERE {SHOWN} AND COALESCE(parent_table, '') <> '' AND COALESCE(child_table, '') <> '' AND COALESCE(field, '') <> ''")
QUERIES["program_tables"] = Query(
    lambda spark, sf: filters.program_tables(STORE_TABLES.df(spark, sf), CHOSEN.df(spark, sf)),
    f"SELECT * FROM ({STORE_TABLES.sql}) WHERE {SHOWN} AND program_id IN (SELECT program_id FROM ({CHOSEN.sql}))")
QUERIES["declared_schema"] = Query(
    lambda spark, sf: declared_schema(STORE_TABLES.df(spark, sf), STORE_COLUMNS.df(spark, sf)),
    f"""SELECT program_id, table_name, column_id, column_name, COALESCE(type, '') AS type, COALESCE(allow_null = 'No', FALSE) AS not_null,
           COALESCE(is_key, FALSE) AS is_key, CASE WHEN regexp_full_match(trim(field_size), '[+-]?[0-9]+') THEN CAST(trim(field_size) AS INTEGER) ELSE 0 END AS field_size
    FROM (SELECT * FROM ({STORE_COLUMNS.sql}) WHERE {SHOWN}) c JOIN (SELECT * FROM ({STORE_TABLES.sql}) WHERE {SHOWN}) t USING (table_id)""")

# ---- counts, guards, renames ----

QUERIES["child_counts"] = Query(
    lambda spark, sf: relations.child_counts(
        STORE_PROGRAMS.df(spark, sf).select("program_id", "name"), STORE_TABLES.df(spark, sf), "program_id", "n_tables"),
    f"""SELECT program_id, name, (SELECT count(*) FROM ({STORE_TABLES.sql}) t WHERE t.program_id = p.program_id) AS n_tables FROM ({STORE_PROGRAMS.sql}) p""")
QUERIES["field_ref_counts"] = Query(
    lambda spark, sf: relations.field_references(RELATIONS.df(spark, sf)),
    f"SELECT program_id, field, count(*) AS n_relations FROM ({RELATIONS.sql}) WHERE {SHOWN} AND field IS NOT NULL GROUP BY ALL")
QUERIES["delete_guard"] = Query(
    lambda spark, sf: relations.guarded_tables(STORE_TABLES.df(spark, sf), RELATIONS.df(spark, sf)),
    f"""WITH r AS (SELECT * FROM ({RELATIONS.sql}) WHERE {SHOWN}) SELECT * FROM ({STORE_TABLES.sql}) t
    WHERE EXISTS (SELECT 1 FROM r WHERE r.program_id = t.program_id AND (parent_table = table_name OR child_table = table_name))""")


def _guarded(spark, sf):
    columns = declared_schema(STORE_TABLES.df(spark, sf), STORE_COLUMNS.df(spark, sf)).select("program_id", "table_name", "column_name", "column_id")
    return relations.guarded_columns(columns, RELATIONS.df(spark, sf))


QUERIES["column_guard"] = Query(_guarded, f"""
    WITH c AS (SELECT program_id, table_name, column_name, column_id FROM (SELECT * FROM ({STORE_COLUMNS.sql}) WHERE {SHOWN})
               JOIN (SELECT * FROM ({STORE_TABLES.sql}) WHERE {SHOWN}) USING (table_id)),
    r AS (SELECT program_id, field, count(*) AS n_relations FROM ({RELATIONS.sql}) WHERE {SHOWN} GROUP BY ALL)
    SELECT c.*, n_relations FROM c JOIN r ON r.program_id = c.program_id AND field = column_name""")

FIELD_RENAMES = Recipe("part", {
    "program_id": "p_partkey % 50 + 1", "old_name": COLUMN,
    "new_name": f"CASE WHEN p_partkey % 4 = 0 OR p_size <= 35 THEN upper({COLUMN}) ELSE {COLUMN} || '_new' || CAST(p_partkey AS STRING) END"})
QUERIES["rename_propagate"] = Query(
    lambda spark, sf: relations.propagate_rename(RELATIONS.df(spark, sf), FIELD_RENAMES.df(spark, sf)),
    f"""WITH n AS (SELECT program_id, old_name, max(new_name) AS new_name FROM ({FIELD_RENAMES.sql}) WHERE lower(old_name) <> lower(new_name) GROUP BY ALL)
    SELECT r.* REPLACE (CASE WHEN {SHOWN} THEN COALESCE(new_name, field) ELSE field END AS field)
    FROM ({RELATIONS.sql}) r LEFT JOIN n ON n.program_id = r.program_id AND old_name = field""")
QUERIES["relation_autoname"] = Query(
    lambda spark, sf: relations.auto_name(RELATIONS.df(spark, sf)),
    f"""SELECT * REPLACE (CASE WHEN COALESCE(parent_table, '') <> '' AND COALESCE(child_table, '') <> '' THEN parent_table || child_table ELSE name END AS name)
    FROM ({RELATIONS.sql})""")
QUERIES["relation_sort"] = Query(
    lambda spark, sf: filters.sorted_relations(RELATIONS.df(spark, sf)), f"SELECT * FROM ({RELATIONS.sql}) ORDER BY parent_table, child_table")

# ---- program clean-up ----


def _cleared(part):
    def run(spark, sf):
        store = {"tables": STORE_TABLES.df(spark, sf), "columns": STORE_COLUMNS.df(spark, sf), "relations": RELATIONS.df(spark, sf)}
        return relations.clear_programs(store, CHOSEN.df(spark, sf))[part]
    return run


GONE = f"(SELECT program_id FROM ({CHOSEN.sql}))"
QUERIES["program_clear_columns"] = Query(_cleared("columns"), f"""SELECT * FROM ({STORE_COLUMNS.sql})
    WHERE table_id NOT IN (SELECT table_id FROM ({STORE_TABLES.sql}) WHERE program_id IN {GONE})""")
QUERIES["program_clear_relations"] = Query(_cleared("relations"), f"SELECT * FROM ({RELATIONS.sql}) WHERE program_id NOT IN {GONE}")
QUERIES["program_clear_tables"] = Query(_cleared("tables"), f"SELECT * FROM ({STORE_TABLES.sql}) WHERE program_id NOT IN {GONE}")
QUERIES["soft_delete"] = Query(
    lambda spark, sf: relations.soft_delete(STORE_TABLES.df(spark, sf), CHOSEN.df(spark, sf), "program_id"),
    f"SELECT * REPLACE (CASE WHEN program_id IN {GONE} THEN TRUE ELSE hidden END AS hidden) FROM ({STORE_TABLES.sql})")

# ---- dump ingest ----

TAB = "chr(9)"
PROGRAM_LINES = Recipe("part", {"value": case_of("p_partkey % 12", [
    "'  '", f"'x' || CAST(p_partkey AS STRING) || {TAB} || 'bad'",
    *[f"' ' || CAST(p_partkey AS STRING) || {TAB} || ' prog ' || CAST(p_partkey % 97 AS STRING) || ' '" for _ in range(4)],
    *[f"CAST(p_partkey AS STRING) || {TAB} || 'prog ' || CAST(p_partkey % 97 AS STRING) || {TAB} || ' n' || CAST(p_partkey AS STRING) || ' '" for _ in range(6)]])})
TABLE_LINES = Recipe("part", {"value": "CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 29 = 1 THEN CAST(p_partkey AS STRING) ELSE "
    f"CAST(p_partkey AS STRING) || {TAB} || CAST(CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 100000000000 ELSE p_partkey END AS STRING) || {TAB}"
    f" || p_type || '_' || CAST(p_size % 10 AS STRING) || {TAB} || CAST(p_size AS STRING) END"})
COLUMN_LINES = Recipe("part", {"value": "CASE WHEN p_partkey % 31 = 0 THEN 'junk' ELSE "
    f"CAST(p_partkey AS STRING) || {TAB} || CAST(CASE WHEN p_partkey % 7 = 0 THEN p_partkey * 1000 + 1 ELSE p_partkey END AS STRING) || {TAB} || {COLUMN} || {TAB} || "
    + case_of("p_size % 4", ["'adLong'", "''", "'NewType' || CAST(p_size AS STRING)", "'newtype' || CAST(p_size AS STRING)"])
    + f" || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE {TAB} || ' ' || {TAB} || CAST(p_size AS STRING) || {TAB} || "
    + case_of("p_size % 3", ["'yes'", "'No'", "''"]) + f" || {TAB} || 'idx' || {TAB} || "
    + case_of("p_size % 2", ["'TRUE'", "'False'"]) + " END END"})


def _dump(spark, sf):
    return (dump.parse_programs(PROGRAM_LINES.df(spark, sf)), dump.parse_tables(TABLE_LINES.df(spark, sf)),
            dump.parse_columns(COLUMN_LINES.df(spark, sf)))


def field(n: int) -> str:
    return f"trim(split_part(value, chr(9), {n}))"


PARSED = f"""
    dp AS (SELECT TRY_CAST({field(1)} AS BIGINT) AS id, {field(2)} AS name,
                  CASE WHEN len(string_split(value, chr(9))) > 2 THEN {field(3)} END AS version FROM ({PROGRAM_LINES.sql})
           WHERE regexp_full_match({field(1)}, '[0-9]+')),
    dt AS (SELECT TRY_CAST({field(1)} AS BIGINT) AS id, TRY_CAST({field(2)} AS BIGINT) AS program_id, {field(3)} AS table_name, {field(4)} AS version
           FROM ({TABLE_LINES.sql}) WHERE len(string_split(value, chr(9))) >= 2 AND TRY_CAST({field(2)} AS BIGINT) IS NOT NULL),
    dc AS (SELECT TRY_CAST({field(1)} AS BIGINT) AS id, TRY_CAST({field(2)} AS BIGINT) AS table_id, {field(3)} AS column_name,
                  CASE WHEN {field(4)} = '' THEN 'adVariant' ELSE {field(4)} END AS type, NULLIF({field(5)}, '') AS default_value,
                  NULLIF({field(6)}, '') AS field_size, CASE WHEN lower({field(7)}) IN ('', 'yes') THEN 'YES' ELSE {field(7)} END AS allow_null,
                  NULLIF({field(8)}, '') AS indexed, lower({field(9)}) = 'true' AS is_key
           FROM ({COLUMN_LINES.sql}) WHERE len(string_split(value, chr(9))) >= 2)"""
QUERIES["tsv_programs"] = Query(lambda spark, sf: _dump(spark, sf)[0], f"WITH {PARSED} SELECT CAST(id AS BIGINT) AS id, name, version FROM dp")
QUERIES["tsv_tables"] = Query(lambda spark, sf: _dump(spark, sf)[1],
                              f"WITH {PARSED} SELECT CAST(id AS BIGINT) AS id, CAST(program_id AS BIGINT) AS program_id, table_name, version FROM dt")
QUERIES["tsv_columns"] = Query(lambda spark, sf: _dump(spark, sf)[2],
                               f"WITH {PARSED} SELECT * REPLACE (CAST(id AS BIGINT) AS id, CAST(table_id AS BIGINT) AS table_id) FROM dc")


def _store(spark, sf):
    return {"programs": STORE_PROGRAMS.df(spark, sf), "tables": STORE_TABLES.df(spark, sf), "columns": STORE_COLUMNS.df(spark, sf),
            "relations": RELATIONS.df(spark, sf), "types": TYPES.df(spark, sf)}


def _ingested(kind, overwrite):
    def run(spark, sf):
        merged, counts = ingest.ingest_dump(_store(spark, sf), *_dump(spark, sf), overwrite=overwrite)
        return counts if kind == "counts" else merged[kind]
    return run


INGEST = f"""{PARSED},
    sp AS ({STORE_PROGRAMS.sql}), st AS ({STORE_TABLES.sql}), sc AS ({STORE_COLUMNS.sql}),
    pf AS (SELECT dp.*, f.found FROM dp LEFT JOIN (SELECT name, min(program_id) AS found FROM sp WHERE {SHOWN} GROUP BY name) f USING (name)),
    pn AS (SELECT name, arg_min(version, id) AS version, min(id) AS first_id FROM pf WHERE found IS NULL GROUP BY name),
    pnew AS (SELECT (SELECT max(program_id) FROM sp) + row_number() OVER (ORDER BY first_id) AS program_id, name, version FROM pn),
    pmap AS (SELECT id, COALESCE(found, program_id) AS new_id FROM pf LEFT JOIN pnew USING (name)),
    tk AS (SELECT dt.id, pmap.new_id AS program_id, table_name, version FROM dt JOIN pmap ON pmap.id = dt.program_id),
    tf AS (SELECT tk.*, f.found FROM tk LEFT JOIN (SELECT program_id, table_name, min(table_id) AS found FROM st WHERE {SHOWN} GROUP BY ALL) f USING (program_id, table_name)),
    tn AS (SELECT program_id, table_name, arg_min(version, id) AS version, min(id) AS first_id FROM tf WHERE found IS NULL GROUP BY ALL),
    tnew AS (SELECT (SELECT max(table_id) FROM st) + row_number() OVER (ORDER BY first_id) AS table_id, program_id, table_name, version FROM tn),
    tmap AS (SELECT id, COALESCE(found, table_id) AS new_id FROM tf LEFT JOIN tnew USING (program_id, table_name)),
    ck AS (SELECT dc.* REPLACE (tmap.new_id AS table_id) FROM dc JOIN tmap ON tmap.id = dc.table_id),
    cf AS (SELECT ck.*, f.found FROM ck LEFT JOIN (SELECT table_id, column_name, min(column_id) AS found FROM sc WHERE {SHOWN} GROUP BY ALL) f USING (table_id, column_name)),
    cn AS (SELECT * FROM cf WHERE found IS NULL QUALIFY row_number() OVER (PARTITION BY table_id, column_name ORDER BY id) = 1),
    cnew AS (SELECT (SELECT max(column_id) FROM sc) + row_number() OVER (ORDER BY id) AS column_id, * EXCLUDE (id, found), FALSE AS hidden FROM cn),
    cover AS (SELECT * FROM cf WHERE found IS NOT NULL QUALIFY row_number() OVER (PARTITION BY found ORDER BY id DESC) = 1)"""
LAYOUT = "column_id, table_id, column_name, type, default_value, field_size, allow_null, indexed, is_key, hidden"
QUERIES["tsv_ingest_skip"] = Query(_ingested("columns", False), f"WITH {INGEST} SELECT {LAYOUT} FROM sc UNION ALL SELECT {LAYOUT} FROM cnew")
QUERIES["tsv_ingest_overwrite"] = Query(_ingested("columns", True), f"""WITH {INGEST}
    SELECT column_id, sc.table_id, sc.column_name, {', '.join(f"CASE WHEN found IS NOT NULL THEN cover.{c} ELSE sc.{c} END AS {c}" for c in ingest.COLUMN_VALUES)}, sc.hidden
    FROM sc LEFT JOIN cover ON found = column_id UNION ALL SELECT {LAYOUT} FROM cnew""")
QUERIES["tsv_ingest_programs"] = Query(_ingested("programs", True), f"""WITH {INGEST},
    everything AS (SELECT program_id, name, version, hidden FROM sp UNION ALL SELECT program_id, name, version, FALSE FROM pnew),
    last AS (SELECT name, arg_max(COALESCE(version, '?'), id) AS version FROM dp GROUP BY name)
    SELECT program_id, name, CASE WHEN {SHOWN} AND last.version IS NOT NULL THEN NULLIF(last.version, '?') ELSE e.version END AS version, hidden
    FROM everything e LEFT JOIN last USING (name)""")
QUERIES["tsv_ingest_tables"] = Query(_ingested("tables", False), f"""WITH {INGEST}
    SELECT * FROM st UNION ALL SELECT table_id, program_id, table_name, version, FALSE FROM tnew""")
QUERIES["tsv_ingest_counts"] = Query(_ingested("counts", False), f"""WITH {INGEST}
    SELECT 'programs' AS kind, (SELECT count(*) FROM pnew) AS n_added, (SELECT count(*) FROM dp) - (SELECT count(*) FROM pnew) AS n_skipped
    UNION ALL SELECT 'tables', (SELECT count(*) FROM tnew), (SELECT count(*) FROM tk) - (SELECT count(*) FROM tnew)
    UNION ALL SELECT 'columns', (SELECT count(*) FROM cnew), (SELECT count(*) FROM ck) - (SELECT count(*) FROM cnew)""")
QUERIES["tsv_orphans"] = Query(
    lambda spark, sf: ingest.drop_orphans(_dump(spark, sf)[2], _dump(spark, sf)[1], "table_id", "id").select("id", "table_id", "column_name"),
    f"WITH {PARSED} SELECT CAST(id AS BIGINT) AS id, CAST(table_id AS BIGINT) AS table_id, column_name FROM dc WHERE table_id IN (SELECT id FROM dt)")

# ---- schema import ----

CATALOG = Recipe("part", {
    "program_id": "p_partkey % 50 + 1", "table_name": "CASE WHEN p_partkey % 17 = 0 THEN 'MSys' ELSE '' END || p_type || '_' || CAST(p_size AS STRING)",
    "position": "CAST(p_partkey AS INT)", "column_name": f"CASE WHEN p_partkey % 2 = 0 THEN {COLUMN} ELSE upper({COLUMN}) END",
    "sql_type": case_of("p_partkey % 6", ["'varchar(20)'", "'bigint'", "'INT IDENTITY(1,1)'", "'uuid'", "'timestamp'", "'text'"]),
    "not_null": "p_size % 2 = 0", "primary_key": "p_partkey % 8 = 0", "max_length": "CAST(p_size * 10 - 10 AS INT)"})
LIVE_FKS = Recipe("part", {
    "program_id": "p_partkey % 50 + 1", "constraint_name": "'c' || lpad(CAST(p_partkey AS STRING), 12, '0')",
    "child_table": "CASE WHEN p_partkey % 17 = 0 THEN 'MSys' ELSE '' END || p_type || '_' || CAST(p_size % 9 AS STRING)", "child_column": COLUMN,
    "parent_table": "CASE WHEN p_partkey % 23 = 0 THEN 'msys' ELSE '' END || p_type || '_1'"})


def _imported(kind, clear=False):
    def run(spark, sf):
        merged, counts = ingest.import_schema(_store(spark, sf), CATALOG.df(spark, sf), LIVE_FKS.df(spark, sf), clear=clear)
        return counts if kind == "counts" else merged[kind]
    return run


WORD = """CASE WHEN sql_type = 'varchar(20)' OR sql_type = 'text' THEN CASE WHEN max_length BETWEEN 1 AND 255 THEN 'adWChar' ELSE 'adMemo' END
    WHEN sql_type = 'bigint' THEN 'adLong' WHEN sql_type = 'uuid' THEN 'adGUID' WHEN sql_type = 'timestamp' THEN 'adDate' ELSE 'AutoNumber' END"""


def _import_sql(clear):
    gone = f"WHERE program_id NOT IN (SELECT program_id FROM ({CATALOG.sql}))" if clear else ""
    return f"""
    cat AS (SELECT * FROM ({CATALOG.sql}) WHERE table_name NOT ILIKE 'msys%'),
    st AS (SELECT * FROM ({STORE_TABLES.sql}) {gone}),
    sc AS (SELECT * FROM ({STORE_COLUMNS.sql}) {'WHERE table_id NOT IN (SELECT table_id FROM (' + STORE_TABLES.sql + ') WHERE program_id IN (SELECT program_id FROM (' + CATALOG.sql + ')))' if clear else ''}),
    sr AS (SELECT * FROM ({RELATIONS.sql}) {gone}),
    known AS (SELECT program_id, table_name, min(table_id) AS table_id FROM st WHERE {SHOWN} GROUP BY ALL),
    nt AS (SELECT DISTINCT program_id, table_name FROM cat ANTI JOIN known USING (program_id, table_name)),
    tnew AS (SELECT COALESCE((SELECT max(table_id) FROM st), 0) + row_number() OVER (ORDER BY program_id, table_name) AS table_id, program_id, table_name FROM nt),
    ids AS (SELECT program_id, table_name, table_id FROM known UNION ALL SELECT program_id, table_name, table_id FROM tnew),
    rows_ AS (SELECT table_id, position, column_name, {WORD} AS type, CAST(NULL AS VARCHAR) AS default_value,
                     CASE WHEN max_length > 0 THEN CAST(max_length AS VARCHAR) END AS field_size, CASE WHEN not_null THEN 'No' ELSE 'YES' END AS allow_null,
                     CAST(NULL AS VARCHAR) AS indexed, primary_key AS is_key FROM cat JOIN ids USING (program_id, table_name)
              QUALIFY row_number() OVER (PARTITION BY table_id, column_name ORDER BY position) = 1),
    nc AS (SELECT * FROM rows_ ANTI JOIN (SELECT * FROM sc WHERE {SHOWN}) v USING (table_id, column_name)),
    cnew AS (SELECT COALESCE((SELECT max(column_id) FROM sc), 0) + row_number() OVER (ORDER BY table_id, position, column_name) AS column_id, * EXCLUDE (position), FALSE AS hidden FROM nc),
    fk AS (SELECT program_id, child_table, child_column AS field, parent_table, constraint_name FROM ({LIVE_FKS.sql})
           WHERE parent_table NOT ILIKE 'msys%' AND child_table NOT ILIKE 'msys%'),
    nr AS (SELECT * FROM fk ANTI JOIN (SELECT * FROM sr WHERE {SHOWN}) v USING (program_id, child_table, field)
           QUALIFY row_number() OVER (PARTITION BY program_id, child_table, field ORDER BY constraint_name) = 1),
    rnew AS (SELECT COALESCE((SELECT max(relation_id) FROM sr), 0) + row_number() OVER (ORDER BY program_id, child_table, field) AS relation_id, * FROM nr)"""


QUERIES["import_merge"] = Query(_imported("columns"), f"WITH {_import_sql(False)} SELECT {LAYOUT} FROM sc UNION ALL SELECT {LAYOUT} FROM cnew")
QUERIES["import_again"] = Query(_imported("columns", True), f"WITH {_import_sql(True)} SELECT {LAYOUT} FROM sc UNION ALL SELECT {LAYOUT} FROM cnew")
QUERIES["import_relations"] = Query(_imported("relations"), f"""WITH {_import_sql(False)} SELECT * FROM sr
    UNION ALL SELECT relation_id, program_id, parent_table, child_table, field, constraint_name, FALSE, FALSE FROM rnew""")
QUERIES["import_counts"] = Query(_imported("counts"), f"""WITH {_import_sql(False)}
    SELECT 'tables' AS kind, count(*) AS n_added FROM tnew UNION ALL SELECT 'columns', count(*) FROM cnew UNION ALL SELECT 'relations', count(*) FROM rnew""")
SEEN = Recipe("part", {"p_partkey": "p_partkey", "type": case_of("p_partkey % 9", ["'adLong'", "'ADLONG'", "'Geometry'", "'GEOMETRY'", "'adWChar'", "''", "'hstore'", "'Hstore'", None])})
QUERIES["type_register"] = Query(
    lambda spark, sf: ingest.register_types(TYPES.df(spark, sf), SEEN.df(spark, sf), "p_partkey"),
    f"""SELECT arg_min(type, p_partkey) AS type FROM ({SEEN.sql}) WHERE COALESCE(type, '') <> ''
    AND lower(type) NOT IN (SELECT lower(type) FROM ({TYPES.sql})) GROUP BY lower(type)""")

# ---- surplus register ----

OLD_SURPLUS = Recipe("part", {
    "program_id": f"{drift.PROGRAM} + 3", "db": "'old'", "table_name": "p_type", "column_name": f"{COLUMN} || CAST(p_partkey AS STRING)", "whole_table": "p_size % 2 = 0"})
QUERIES["surplus_refresh"] = Query(
    lambda spark, sf: ingest.refresh_surplus(OLD_SURPLUS.df(spark, sf), drift.fleet(spark, sf).surplus(), drift.DATABASES.df(spark, sf)),
    f"""WITH {drift.BASE}
    SELECT * FROM ({OLD_SURPLUS.sql}) WHERE program_id NOT IN (SELECT program_id FROM db)
    UNION ALL SELECT program_id, db, table_name, column_name, FALSE FROM surplus_columns
    UNION ALL SELECT l.program_id, l.db, l.table_name, column_name, TRUE FROM l JOIN surplus_tables s ON s.db = l.db AND s.t = l.t""")
DROPPED = Recipe("part", {
    "program_id": f"{drift.PROGRAM} + 3", "db": "'old'", "table_name": "p_type",
    "column_name": f"CASE WHEN p_type = 'PROMO' THEN NULL ELSE {COLUMN} || CAST(p_partkey AS STRING) || CASE WHEN p_size < 25 THEN '' ELSE '_kept' END END"})
QUERIES["surplus_drop"] = Query(
    lambda spark, sf: ingest.drop_surplus(OLD_SURPLUS.df(spark, sf), DROPPED.df(spark, sf)),
    f"""WITH d AS ({DROPPED.sql}) SELECT * FROM ({OLD_SURPLUS.sql}) s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.program_id = s.program_id AND d.db = s.db
        AND d.table_name = s.table_name AND (d.column_name IS NULL OR d.column_name = s.column_name))""")

# ---- dictionary ----

ENTRIES = Recipe("documents", {
    "entry_id": "doc_id * 3 + 5", "lang_id": "lang", "original": "CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 < 3 THEN ' common ' WHEN doc_id % 10 = 3 THEN 'COMMON' ELSE text END",
    "translation": "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE 'tr ' || CAST(n_chars AS STRING) END",
    "hidden": "CASE WHEN doc_id % 9 = 0 THEN TRUE WHEN doc_id % 9 = 1 THEN FALSE END"})
PHRASES = Recipe("documents", {
    "doc_id": "doc_id", "lang": "lang", "phrase": "CASE WHEN doc_id % 3 = 0 THEN 'COMMON' WHEN doc_id % 50 = 1 THEN '  ' ELSE text || ' ' END",
    "fallback": "CASE WHEN doc_id % 2 = 0 THEN 'fallback ' || source ELSE '' END"})
# Keys are trimmed of every kind of blank, line ends included.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
QUERIES["dict_lookup"] = Query(
    lambda spark, sf: dictionary.lookup(PHRASES.df(spark, sf), ENTRIES.df(spark, sf), "phrase", "lang", F.col("fallback")),
    f"""WITH e AS (SELECT lang_id, lower(trim(original, {BLANKS})) AS k, arg_min(COALESCE(translation, original), entry_id) AS t FROM ({ENTRIES.sql})
           WHERE {SHOWN} AND COALESCE(original, '') <> '' GROUP BY ALL)
    SELECT p.*, CASE WHEN trim(phrase, {BLANKS}) = '' THEN fallback WHEN e.t IS NOT NULL THEN e.t WHEN fallback <> '' THEN fallback ELSE phrase END AS translated
    FROM ({PHRASES.sql}) p LEFT JOIN e ON lang_id = lang AND k = lower(trim(phrase, {BLANKS}))""")
QUERIES["dict_deduplicate"] = Query(
    lambda spark, sf: dictionary.without_duplicates(ENTRIES.df(spark, sf)),
    f"SELECT * FROM ({ENTRIES.sql}) QUALIFY row_number() OVER (PARTITION BY lang_id, original ORDER BY entry_id) = 1")
WANTED = Recipe("documents", {
    "entry_no": "doc_id", "original": "CASE WHEN doc_id % 8 = 0 THEN 'Common' WHEN doc_id % 4 = 0 THEN text ELSE text || ' new' END",
    "translation": "'new ' || CAST(doc_id AS STRING)"})
UPDATES = Recipe("documents", {"original": "CASE WHEN n_chars % 5 = 0 THEN text ELSE text || ' unknown' END", "translation": "'forced ' || CAST(n_chars AS STRING)"})
QUERIES["dict_sync"] = Query(
    lambda spark, sf: dictionary.sync(ENTRIES.df(spark, sf), "en", WANTED.df(spark, sf), UPDATES.df(spark, sf)),
    f"""WITH clean AS (SELECT * FROM ({ENTRIES.sql}) QUALIFY row_number() OVER (PARTITION BY lang_id, original ORDER BY entry_id) = 1),
    w AS (SELECT *, lower(original) AS k FROM ({WANTED.sql}) QUALIFY row_number() OVER (PARTITION BY lower(original) ORDER BY entry_no) = 1),
    fresh AS (SELECT * FROM w WHERE k NOT IN (SELECT lower(original) FROM clean WHERE lang_id = 'en')),
    merged AS (SELECT entry_id, lang_id, original, translation, hidden FROM clean UNION ALL
        SELECT (SELECT max(entry_id) FROM ({ENTRIES.sql})) + row_number() OVER (ORDER BY entry_no), 'en', original, translation, FALSE FROM fresh),
    f AS (SELECT original, max(translation) AS forced FROM ({UPDATES.sql}) GROUP BY original)
    SELECT entry_id, lang_id, original, CASE WHEN lang_id = 'en' THEN COALESCE(forced, translation) ELSE translation END AS translation, hidden
    FROM merged LEFT JOIN f USING (original)""")
