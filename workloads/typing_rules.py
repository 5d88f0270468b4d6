"""Type mapping. Each part stands for one catalog entry: a dialect and a type text."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import types as ty
from keelson.sources import catalog
from workloads.base import Query, Recipe, case_of, div, text, values

QUERIES: dict[str, Query] = {}

TYPE_TEXTS = [
    "varchar(20)", "VARCHAR", " nvarchar (40) ", "char(36)", "text", "NTEXT", "character varying", "longtext", "memo", "CLOB",
    "string", "json", "xml", "enum('a','b')", "time", "long varchar", "blob sub_type text", "VARCHAR2(30)", "long", "xmltype",
    "boolean", "bool", "bit", "yesno", "LOGICAL", "integer", "INT", "int2", "int8", "tinyint(1)",
    "smallint", "mediumint", "bigint", "unsigned big int", "year", "byte", "autoinc", "real", "float", "float8",
    "double", "double precision", "single", "decfloat", "binary_double", "numeric(10,2)", "DECIMAL", "number(10,0)", "money", "currency",
    "date", "DateTime", "timestamp", "timestamp with time zone", "datetime2", "datetimeoffset", "blob", "binary(8)", "bytea", "image",
    "rowversion", "raw(16)", "long raw", "uuid", "uniqueidentifier", "guid", "adBoolean", "adLong", "adBigInt", "adWChar",
    "adMemo", "adOLE", "adVariant", "adDBDate", "AutoNumber", "autonumber", "INT IDENTITY(1,1)", "serial", "int generated always as identity",
    "INT AUTO_INCREMENT", "timestamptz", "jsonb", "geometry", "(weird)", "", "   ",
]
ENTRY = Recipe("part", {
    "p_partkey": "p_partkey",
    "backend": case_of("p_partkey % 10", [text(b) for b in ty.BACKENDS]),
    "type_text": case_of(f"{div('p_partkey', 10)} % {len(TYPE_TEXTS) + 1}", [text(t) for t in TYPE_TEXTS]),
    "size": "CAST(p_size * 10 - 10 AS INT)",
    "code": f"CAST({div('p_partkey', 3)} % 210 AS INT)",
    "subtype": "CAST(p_partkey % 3 AS INT)",
})
BASE = "lower(CASE WHEN instr(trim(type_text), '(') > 1 THEN rtrim(split_part(trim(type_text), '(', 1)) ELSE trim(type_text) END)"
AUTO = ("(COALESCE(lower(trim(type_text)), '') IN ('autonumber', 'autoincrement', 'autoinc', 'serial')"
        " OR COALESCE(lower(type_text), '') LIKE '%identity%' OR COALESCE(lower(type_text), '') LIKE '%generated%'"
        " OR COALESCE(lower(type_text), '') LIKE '%auto#_increment%' ESCAPE '#')")
BLANK = "(type_text IS NULL OR trim(type_text) = '')"


def _known(dialects=None) -> str:
    rows = [(d, n, c) for d, names in ty.TYPE_NAMES.items() for n, c in names.items() if dialects is None or d in dialects]
    return values("known", ["dialect", "name", "canonical"], rows)


def _ranked() -> str:
    return values("ranked", ["dialect", "rank"], [(d, i) for i, d in enumerate(ty.ANY_ORDER)])


ANY = "any_of AS (SELECT name, arg_min(canonical, rank) AS canonical FROM known JOIN ranked USING (dialect) GROUP BY name)"
DDL = values("ddl", ["dialect", "canonical", "declared"], [(d, c, t) for d, row in ty.DDL_NAMES.items() for c, t in row.items()])
X = f"x AS (SELECT *, {BASE} AS base FROM ({ENTRY.sql}))"

# ---- resolve ----

QUERIES["type_resolve"] = Query(
    lambda spark, sf: ENTRY.df(spark, sf).select(
        "p_partkey", "backend", "type_text", ty.resolve(F.col("backend"), F.col("type_text")).alias("canonical")),
    f"""WITH {_known()}, {X}
    SELECT p_partkey, backend, type_text, COALESCE(canonical, 'Unknown') AS canonical
    FROM x LEFT JOIN known ON dialect = backend AND name = base""")
QUERIES["type_resolve_any"] = Query(
    lambda spark, sf: ENTRY.df(spark, sf).select(
        "p_partkey", "type_text", ty.resolve_any(F.col("type_text")).alias("canonical")),
    f"""WITH {_known()}, {_ranked()}, {ANY}, {X}
    SELECT p_partkey, type_text, COALESCE(canonical, 'Unknown') AS canonical FROM x LEFT JOIN any_of ON name = base""")

# ---- declared types ----

SIZED = """CASE WHEN canonical = 'Text' AND size > 0 THEN CASE
    WHEN target IN ('PostgreSQL', 'MySQL', 'MariaDB') THEN 'VARCHAR(' || size || ')'
    WHEN target = 'SqlServer' THEN 'NVARCHAR(' || size || ')'
    WHEN target = 'Firebird' THEN 'VARCHAR(' || least(size, 32765) || ')'
    WHEN target = 'Access' AND size <= 255 THEN 'VARCHAR(' || size || ')'
    WHEN target = 'Oracle' THEN 'VARCHAR2(' || least(size, 4000) || ')'
    WHEN target = 'DB2' THEN 'VARCHAR(' || least(size, 32672) || ')'
    WHEN target = 'DBase' THEN 'CHARACTER(' || least(size, 254) || ')' END END"""
IDENTITY = values("ident", ["dialect", "declared"], [*ty.IDENTITY_DDL.items(), ("MariaDB", ty.IDENTITY_DDL["MySQL"])])
TO_DDL = f"""
    r AS (SELECT x.*, x.backend AS target, CASE WHEN {BLANK} THEN 'Text' ELSE COALESCE(canonical, 'Unknown') END AS canonical
          FROM x LEFT JOIN any_of ON name = base),
    d AS (SELECT r.*, CASE WHEN {AUTO} THEN ident.declared ELSE COALESCE({SIZED.replace('canonical =', 'r.canonical =')}, ddl.declared) END AS declared
          FROM r JOIN ddl ON ddl.dialect = target AND ddl.canonical = r.canonical JOIN ident ON ident.dialect = target)"""
HEAD = f"{_known()}, {_ranked()}, {ANY}, {X}, {DDL}, {IDENTITY}"
QUERIES["type_to_ddl"] = Query(
    lambda spark, sf: ENTRY.df(spark, sf).select(
        "p_partkey", "backend", "type_text", "size",
        ty.to_ddl(F.col("backend"), F.col("type_text"), F.col("size")).alias("declared")),
    f"WITH {HEAD}, {TO_DDL.replace('SELECT r.*', 'SELECT r.p_partkey, r.backend, r.type_text, r.size')} SELECT * FROM d")


def _canonical_ddl(spark, sf):
    entry = ENTRY.df(spark, sf)
    canonical = ty.resolve_any(F.col("type_text"))
    return entry.select("p_partkey", *[
        ty.ddl_type(b, canonical, F.col("size")).alias(f"on_{b.lower()}") for b in ("SQLite", "Access", "Oracle", "MariaDB")])


QUERIES["type_ddl_canonical"] = Query(_canonical_ddl, f"""
    WITH {HEAD}, r AS (SELECT x.*, COALESCE(canonical, 'Unknown') AS canonical FROM x LEFT JOIN any_of ON name = base),
    b AS (SELECT r.*, t.target FROM r, (VALUES ('SQLite'), ('Access'), ('Oracle'), ('MariaDB')) AS t(target)),
    d AS (SELECT b.p_partkey, b.target, COALESCE({SIZED.replace('canonical =', 'b.canonical =')}, ddl.declared) AS declared
          FROM b JOIN ddl ON ddl.dialect = target AND ddl.canonical = b.canonical)
    SELECT p_partkey, max(declared) FILTER (WHERE target = 'SQLite') AS on_sqlite,
           max(declared) FILTER (WHERE target = 'Access') AS on_access,
           max(declared) FILTER (WHERE target = 'Oracle') AS on_oracle,
           max(declared) FILTER (WHERE target = 'MariaDB') AS on_mariadb
    FROM d GROUP BY p_partkey""")

# ---- neutral words ----

WORDS = values("words", ["canonical", "word"], list(ty.WORD_OF.items()))
QUERIES["type_normalise"] = Query(
    lambda spark, sf: ENTRY.df(spark, sf).select(
        "p_partkey", "type_text", "size", ty.normalise_type(F.col("type_text"), F.col("size")).alias("word")),
    f"""WITH {HEAD}, {WORDS}
    SELECT p_partkey, type_text, size, CASE
        WHEN {BLANK} THEN 'adVariant'
        WHEN lower(trim(type_text)) IN ({', '.join(text(w.lower()) for w in ty.VOCABULARY)}) THEN trim(type_text)
        WHEN {AUTO} THEN 'AutoNumber'
        WHEN any_of.canonical = 'Text' THEN CASE WHEN size BETWEEN 1 AND 255 THEN 'adWChar' ELSE 'adMemo' END
        ELSE COALESCE(words.word, 'adVariant') END AS word
    FROM x LEFT JOIN any_of ON name = base LEFT JOIN words ON words.canonical = any_of.canonical""")
QUERIES["type_autonumber"] = Query(
    lambda spark, sf: ENTRY.df(spark, sf).select(
        "p_partkey", "type_text", ty.is_auto_number(F.col("type_text")).alias("is_auto")),
    f"WITH {X} SELECT p_partkey, type_text, {AUTO} AS is_auto FROM x")


def _split(spark, sf):
    base, size = ty.split_type(F.col("type_text"))
    return ENTRY.df(spark, sf).select("p_partkey", "type_text", base.alias("base"), size.alias("length"),
                                      ty.clamp_length(F.col("size") * 20).alias("clamped"))


QUERIES["type_split"] = Query(_split, f"""
    WITH {X}, m AS (SELECT *, regexp_extract(type_text, '[(]([0-9]+)[)]', 1) AS n FROM x)
    SELECT p_partkey, type_text,
           upper(trim(CASE WHEN n <> '' THEN split_part(type_text, '(', 1) ELSE type_text END)) AS base,
           COALESCE(TRY_CAST(n AS INTEGER), 0) AS length,
           CASE WHEN size * 20 BETWEEN 1 AND 8000 THEN size * 20 ELSE 0 END AS clamped
    FROM m""")

# ---- numeric codes ----

CODES = values("codes", ["system", "code", "canonical"], [
    (system, code, canonical) for system, table in (("oledb", ty.OLEDB_CODES), ("firebird", ty.FIREBIRD_CODES))
    for canonical, numbers in table.items() for code in numbers])
QUERIES["type_codes"] = Query(
    lambda spark, sf: ENTRY.df(spark, sf).select(
        "p_partkey", "code", "subtype", ty.code_to_canonical("oledb", F.col("code")).alias("oledb"),
        ty.code_to_canonical("firebird", F.col("code"), F.col("subtype")).alias("firebird"),
        ty.code_to_canonical("firebird", F.lit(261), F.col("subtype")).alias("blob")),
    f"""WITH {CODES}, {X}
    SELECT p_partkey, x.code, subtype, COALESCE(o.canonical, 'Text') AS oledb, COALESCE(f.canonical, 'Unknown') AS firebird,
           CASE WHEN subtype = 1 THEN 'Text' ELSE 'Bytes' END AS blob
    FROM x LEFT JOIN codes o ON o.system = 'oledb' AND o.code = x.code
           LEFT JOIN codes f ON f.system = 'firebird' AND f.code = x.code""")

# ---- dialect extras ----

PG_NAMES = values("pg", ["name", "declared"], [(n, d) for d, names in ty.POSTGRES_FALLBACK.items() for n in names])
ACCESS_NAMES = values("ac", ["name", "declared"], [(n, d) for d, names in ty.ACCESS_FALLBACK.items() for n in names])
QUERIES["type_fallbacks"] = Query(
    lambda spark, sf: ENTRY.df(spark, sf).select("p_partkey", "type_text", "size", *[
        ty.fallback_ddl(t, F.col("type_text"), F.col("size")).alias(f"on_{t.lower()}") for t in ("PostgreSQL", "Access", "DBase")]),
    f"""WITH {HEAD}, {PG_NAMES}, {ACCESS_NAMES},
    u AS (SELECT x.*, any_of.canonical IS NULL AND NOT {AUTO} AS lost,
                 CASE WHEN {BLANK} THEN 'Text' ELSE COALESCE(any_of.canonical, 'Unknown') END AS canonical
          FROM x LEFT JOIN any_of ON name = base),
    t AS (SELECT u.*, v.target FROM u, (VALUES ('PostgreSQL'), ('Access'), ('DBase')) AS v(target)),
    p AS (SELECT t.*, CASE WHEN {AUTO} THEN ident.declared
                 ELSE COALESCE({SIZED.replace('canonical =', 't.canonical =')}, ddl.declared) END AS plain
          FROM t JOIN ddl ON ddl.dialect = target AND ddl.canonical = t.canonical JOIN ident ON ident.dialect = target),
    f AS (SELECT p.*, CASE
            WHEN target = 'PostgreSQL' AND plain = 'TEXT' AND lost AND COALESCE(type_text, '') <> ''
                THEN COALESCE(pg.declared, type_text)
            WHEN target = 'Access' AND lost THEN COALESCE(ac.declared, 'TEXT')
            WHEN target = 'DBase' AND plain = 'CHARACTER'
                THEN 'CHARACTER(' || CASE WHEN size BETWEEN 1 AND 254 THEN size ELSE 254 END || ')'
            ELSE plain END AS declared
          FROM p LEFT JOIN pg ON pg.name = lower(trim(type_text)) LEFT JOIN ac ON ac.name = base)
    SELECT p_partkey, type_text, size, max(declared) FILTER (WHERE target = 'PostgreSQL') AS on_postgresql,
           max(declared) FILTER (WHERE target = 'Access') AS on_access,
           max(declared) FILTER (WHERE target = 'DBase') AS on_dbase
    FROM f GROUP BY p_partkey, type_text, size""")

# ---- catalogs of live databases ----

RAW_COLUMNS = Recipe("part", {
    "db": "lower(p_brand)", "backend": case_of(f"CAST(substring(p_brand, 7) AS INT) % 10", [text(b) for b in ty.BACKENDS]),
    "table_name": f"p_type || '_' || CAST({div('p_partkey', 500)} AS STRING)",
    "position": "CAST(p_partkey % 500 + 1 AS INT)",
    "column_name": "replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 500 AS STRING)",
    "type_name": case_of(f"{div('p_partkey', 7)} % {len(TYPE_TEXTS)}", [text(t) for t in TYPE_TEXTS]),
    "length": "CAST(CASE WHEN p_size > 45 THEN p_size * 1000 ELSE p_size END AS INT)",
    "not_null": "p_size % 2 = 0",
    "identity": case_of("p_partkey % 8", ["'YES'", "'auto_increment'", "'Y'", "'nextval(''s'')'", "'3'", "'1'", "''", None]),
})
RAW_KEYS = Recipe("part", {
    "db": "lower(p_brand)", "table_name": RAW_COLUMNS.columns["table_name"], "column_name": RAW_COLUMNS.columns["column_name"],
    "constraint_name": "'c_' || p_type || CAST(p_size % 3 AS STRING)", "ordinal": "CAST(p_partkey % 500 + 1 AS INT)",
    "kind": "CASE p_size % 3 WHEN 0 THEN 'PRIMARY KEY' WHEN 1 THEN 'UNIQUE' ELSE 'FOREIGN KEY' END",
})


def _usage(spark, sf):
    keys = RAW_KEYS.df(spark, sf)
    return (keys.select("db", "constraint_name", "table_name", "column_name", "ordinal"),
            keys.select("db", "constraint_name", "table_name", "kind").distinct())


QUERIES["catalog_primary_keys"] = Query(
    lambda spark, sf: catalog.primary_keys(*_usage(spark, sf)),
    f"""WITH k AS ({RAW_KEYS.sql})
    SELECT db, table_name, column_name, ordinal FROM k WHERE kind = 'PRIMARY KEY'""")


def _columns(spark, sf):
    return catalog.column_catalog(RAW_COLUMNS.df(spark, sf), catalog.primary_keys(*_usage(spark, sf)))


CATALOG_SQL = f"""
    k AS (SELECT DISTINCT db, table_name, column_name FROM ({RAW_KEYS.sql}) WHERE kind = 'PRIMARY KEY'),
    c AS (SELECT r.*, k.column_name IS NOT NULL AS pk, regexp_extract(type_name, '[(]([0-9]+)[)]', 1) AS n
          FROM ({RAW_COLUMNS.sql}) r LEFT JOIN k USING (db, table_name, column_name)),
    l AS (SELECT *, CASE WHEN backend = 'SQLite' THEN COALESCE(TRY_CAST(n AS INTEGER), 0)
                         WHEN length BETWEEN 1 AND 8000 THEN length ELSE 0 END AS max_length,
                 upper(trim(CASE WHEN n <> '' THEN split_part(type_name, '(', 1) ELSE type_name END)) AS short_name,
                 lower(COALESCE(identity, '')) AS mark FROM c),
    t AS (SELECT *, CASE WHEN backend = 'SQLite' THEN short_name ELSE type_name END AS type_text FROM l),
    u AS (SELECT t.*, {BASE} AS base, CASE backend
                 WHEN 'SQLite' THEN pk AND short_name = 'INTEGER' WHEN 'Access' THEN pk AND mark = '3'
                 WHEN 'MySQL' THEN mark LIKE '%auto#_increment%' ESCAPE '#' WHEN 'MariaDB' THEN mark LIKE '%auto#_increment%' ESCAPE '#'
                 WHEN 'SqlServer' THEN mark IN ('1', 'true', 'yes') WHEN 'PostgreSQL' THEN mark = 'yes' OR mark LIKE 'nextval(%'
                 WHEN 'Firebird' THEN mark <> '' WHEN 'DB2' THEN mark IN ('y', 'd') WHEN 'Oracle' THEN mark IN ('yes', 'y', '1')
                 ELSE FALSE END AS is_identity FROM t),
    v AS (SELECT u.*, COALESCE(known.canonical, 'Unknown') AS canonical FROM u LEFT JOIN known ON dialect = backend AND name = base),
    cat AS (SELECT db, table_name, position, column_name, CASE WHEN is_identity THEN 'AutoNumber'
                WHEN v.canonical = 'Text' THEN CASE WHEN max_length BETWEEN 1 AND 255 THEN 'adWChar' ELSE 'adMemo' END
                ELSE COALESCE(word, 'adVariant') END AS sql_type, not_null, pk AS primary_key, max_length, v.canonical
            FROM v LEFT JOIN words ON words.canonical = v.canonical)"""
QUERIES["catalog_columns"] = Query(_columns, f"WITH {_known()}, {WORDS}, {CATALOG_SQL} SELECT * FROM cat")


def _types(spark, sf):
    rows = _columns(spark, sf)
    clamped = catalog.column_types(rows, legacy_int_clamp=True).withColumnRenamed("canonical", "legacy")
    return clamped.select("db", "table_name", "column_name", "legacy").join(
        catalog.column_types(rows).select("db", "table_name", "column_name", "canonical").hint("merge"),
        ["db", "table_name", "column_name"])


QUERIES["catalog_types"] = Query(_types, f"""
    WITH {_known()}, {_ranked()}, {ANY}, {WORDS}, {CATALOG_SQL}
    SELECT db, table_name, column_name, cat.canonical, COALESCE(any_of.canonical, 'Unknown') AS legacy
    FROM cat LEFT JOIN any_of ON name = lower(sql_type)""")

TABLE_KINDS = Recipe("part", {
    "db": "lower(p_brand)", "backend": RAW_COLUMNS.columns["backend"],
    "table_name": "CASE p_partkey % 6 WHEN 0 THEN 'MSys' WHEN 1 THEN 'sqlite_' WHEN 2 THEN 'SQLiteX' ELSE '' END || p_type || CAST(p_partkey AS STRING)"
                  " || CASE WHEN p_partkey % 4 = 0 THEN '.DBF' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE '' END",
    "kind": case_of("p_size % 5", ["'TABLE'", "'BASE TABLE'", "'VIEW'", "'T'", None]),
    "system": "CASE WHEN p_size % 7 = 0 THEN TRUE WHEN p_size % 7 = 1 THEN FALSE END",
})
QUERIES["catalog_tables"] = Query(
    lambda spark, sf: catalog.user_tables(TABLE_KINDS.df(spark, sf)),
    f"""WITH r AS ({TABLE_KINDS.sql})
    SELECT db, backend, CASE WHEN backend = 'DBase' AND table_name ILIKE '%.dbf' THEN left(table_name, length(table_name) - 4)
                WHEN backend IN ('DB2', 'Firebird') THEN rtrim(table_name) ELSE table_name END AS table_name
    FROM r WHERE CASE backend
        WHEN 'SQLite' THEN COALESCE(kind, '') = 'TABLE' AND table_name NOT ILIKE 'sqlite_%'
        WHEN 'Access' THEN COALESCE(kind, '') = 'TABLE' AND table_name NOT ILIKE 'msys%'
        WHEN 'SqlServer' THEN COALESCE(kind, '') = 'BASE TABLE' WHEN 'PostgreSQL' THEN COALESCE(kind, '') = 'BASE TABLE'
        WHEN 'DB2' THEN COALESCE(kind, '') = 'T' WHEN 'Firebird' THEN NOT COALESCE(system, FALSE) AND COALESCE(kind, '') <> 'VIEW'
        ELSE TRUE END""")

KEY_PARTS = Recipe("part", {
    "db": f"'db_' || CAST({div('p_partkey', 2)} % 25 AS STRING)", "owner": f"{div('p_partkey', 50)}", "ordinal": "CAST(p_partkey % 2 + 1 AS INT)",
    "column_name": "replace(p_name, ' ', '_')", "slot": f"{div('p_partkey', 2)}",
})


def _key_usage(spark, sf):
    rows = KEY_PARTS.df(spark, sf)
    slot = F.col("slot").cast("string")
    child = rows.select("db", F.concat(F.lit("fk_"), slot).alias("constraint_name"),
                        F.concat(F.lit("child_"), F.col("owner").cast("string")).alias("table_name"), "column_name", "ordinal")
    parent = rows.select("db", F.concat(F.lit("pk_"), slot).alias("constraint_name"),
                         F.concat(F.lit("parent_"), F.col("owner").cast("string")).alias("table_name"),
                         F.upper("column_name").alias("column_name"), "ordinal")
    references = rows.select("db", F.concat(F.lit("fk_"), slot).alias("constraint_name"),
                             F.concat(F.lit("pk_"), slot).alias("referenced_constraint")).distinct()
    return references, child.unionByName(parent)


QUERIES["catalog_foreign_keys"] = Query(
    lambda spark, sf: catalog.foreign_keys(*_key_usage(spark, sf)),
    f"""WITH r AS ({KEY_PARTS.sql})
    SELECT db, 'fk_' || slot AS constraint_name, 'child_' || owner AS child_table, column_name AS child_column,
           'parent_' || owner AS parent_table, upper(column_name) AS parent_column, ordinal FROM r""")
