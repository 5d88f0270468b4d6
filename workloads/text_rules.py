"""Sink encoders, fixed-width records, identifiers, text rules and connection addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import encode, text as tx, types as ty
from keelson.operators import ingest
from keelson.sources import catalog, dbf
from workloads.base import Query, Recipe, case_of

QUERIES: dict[str, Query] = {}

# ---- encoders ----

STORED = Recipe("orders", {
    "o_orderkey": "o_orderkey", "is_open": "CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus = 'O' END",
    "number": "CAST(o_custkey AS INT)", "big": "o_orderkey * 1000000", "day": "CAST(o_orderdate AS DATE)",
    "moment": "o_orderdate", "price": "CAST(o_totalprice AS DECIMAL(18,2))", "word": "o_orderpriority",
})


def _encoded(backends):
    def run(spark, sf):
        df = STORED.df(spark, sf)
        kind = {"is_open": ty.BOOLEAN, "number": ty.INT32, "big": ty.INT64, "day": ty.DATE, "moment": ty.DATETIME,
                "price": ty.DECIMAL, "word": ty.TEXT}
        cols = []
        for b in backends:
            for c, k in kind.items():
                value = encode.encode_for(b, F.col(c), k)
                if c in ("day", "moment") and b != "SQLite":
                    value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
                if c == "price" and b != "Access":
                    value = value.cast("string")
                cols.append(value.alias(f"{b.lower()}_{c}"))
        return df.select("o_orderkey", *cols)
    return run


def _encoded_sql(backends):
    stamp = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
    flag = "CAST(is_open AS INTEGER)"
    forms = {
        "SQLite": ["CAST(is_open AS BIGINT)", "CAST(number AS BIGINT)", "big", "strftime(day, '%Y-%m-%d')", stamp.format(c="moment"), "CAST(price AS VARCHAR)"],
        "Access": ["is_open", "number", "CAST(greatest(least(big, 2147483647), -2147483648) AS INTEGER)", stamp.format(c="day"), stamp.format(c="moment"), "CAST(price AS DOUBLE)"],
        "Firebird": [flag, "number", "big", stamp.format(c="day"), stamp.format(c="moment"), "CAST(price AS VARCHAR)"],
        "MySQL": ["is_open", "number", "big", stamp.format(c="day"), stamp.format(c="moment"), "CAST(price AS VARCHAR)"],
    }
    forms |= {"DB2": forms["Firebird"], "Oracle": forms["Firebird"], "PostgreSQL": forms["MySQL"], "SqlServer": forms["MySQL"]}
    names = ["is_open", "number", "big", "day", "moment", "price", "word"]
    cols = [f"{f} AS {b.lower()}_{n}" for b in backends for f, n in zip([*forms[b], "word"], names)]
    return f"WITH x AS ({STORED.sql}) SELECT o_orderkey, {', '.join(cols)} FROM x"


for _name, _backends in (("enc_sqlite", ["SQLite"]), ("enc_access", ["Access"]),
                         ("enc_others", ["Firebird", "DB2", "Oracle", "MySQL", "PostgreSQL", "SqlServer"])):
    QUERIES[_name] = Query(_encoded(_backends), _encoded_sql(_backends))

# ---- fixed width ----

FIXED = Recipe("customer", {
    "c_custkey": "c_custkey", "c_name": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_name END",
    "balance": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END", "c_nationkey": "c_nationkey",
    "positive": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal > 5000 END",
    "since": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(c_custkey % 3000 AS INT) END",
    "since_text": "CASE WHEN c_custkey % 3 = 0 THEN '1995' ELSE '19950101T00' END",
    "segment": "c_mktsegment",
})
LAYOUT = [("c_custkey", "N", 8, 0), ("c_name", "C", 12, 0), ("balance", "F", 12, 1), ("c_nationkey", "N", 4, 0),
          ("positive", "L", 1, 0), ("since", "D", 8, 0), ("since_text", "D", 8, 0), ("segment", "C", 12, 0), ("segment", "M", 3, 0)]


def _fixed(spark, sf):
    df = FIXED.df(spark, sf)
    kind = {f.name: f.dataType for f in df.schema}
    cells = [encode.fixed_width(F.col(c), kind[c], k, w, d) for c, k, w, d in LAYOUT]
    return df.select(
        "c_custkey", F.concat(*cells).alias("record"),
        encode.fixed_width(F.col("balance"), kind["balance"], "N", 4, 0).alias("short_balance"),
        encode.fixed_width_overflow(F.col("balance"), kind["balance"], "N", 3, 0).alias("too_long"),
        encode.fixed_width(F.col("segment"), kind["segment"], "N", 5, 0).alias("not_a_number"))


WHOLE_BALANCE = "CAST(CAST(round_even(balance, 0) AS BIGINT) AS VARCHAR)"
QUERIES["fixed_width"] = Query(_fixed, f"""
    WITH x AS ({FIXED.sql})
    SELECT c_custkey,
           lpad(CAST(c_custkey AS VARCHAR), 8, ' ') || rpad(COALESCE(c_name, ''), 12, ' ')
           || COALESCE(lpad(CAST(CAST(round(CAST(balance AS DECIMAL(18,2)), 1) AS DECIMAL(18,1)) AS VARCHAR), 12, ' '), repeat(' ', 12))
           || lpad(CAST(c_nationkey AS VARCHAR), 4, ' ') || CASE WHEN positive THEN 'T' ELSE 'F' END
           || COALESCE(strftime(since, '%Y%m%d'), repeat(' ', 8)) || rpad(left(since_text, 8), 8, ' ')
           || rpad(segment, 12, ' ') || '   ' AS record,
           COALESCE(lpad({WHOLE_BALANCE}, 4, ' '), '    ') AS short_balance,
           balance IS NOT NULL AND length({WHOLE_BALANCE}) > 3 AS too_long, '    0' AS not_a_number
    FROM x""")

# ---- dBase files ----

DBF_ROWS = Recipe("customer", {
    "customer_key": "CAST(c_custkey AS INT)", "customer_name": "c_name", "customer_segment_name": "c_mktsegment",
    "account": "CAST(c_acctbal AS DECIMAL(12,2))", "is_positive": "c_acctbal > 0",
    "since_day": "DATE '1995-01-01' + CAST(c_custkey % 3000 AS INT)",
})


def _dbf(spark, sf):
    from keelson.operators.scale import new_folder
    df = DBF_ROWS.df(spark, sf)
    path = new_folder(spark, "dbf")
    dbf.write_dbf(df, path, rows_per_file=1000)
    back = dbf.read_dbf(spark, path, df.columns)
    return back.withColumns({"account": F.col("account").cast("string"), "since_day": F.col("since_day").cast("string"),
                             "customer_key": F.col("customer_key").cast("int")})


QUERIES["dbf_roundtrip"] = Query(_dbf, f"""
    WITH x AS ({DBF_ROWS.sql})
    SELECT customer_key, customer_name, customer_segment_name, CAST(account AS VARCHAR) AS account, is_positive,
           strftime(since_day, '%Y-%m-%d') AS since_day FROM x""")

# Comments as texts of 20 characters, prices with more places than the field, moments within a day.
WIDE = Recipe("orders", {
    "o_orderkey": "o_orderkey", "note": "o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN ' and more of it' ELSE '' END",
    "price": "CAST(o_totalprice AS DECIMAL(18,2))", "share": "CAST(o_orderkey AS DECIMAL(18,6)) / 8", "day": "CAST(o_orderdate AS DATE)",
    "sign": "CASE WHEN o_orderkey % 7 = 0 THEN '→' WHEN o_orderkey % 7 = 1 THEN 'š' ELSE 'a' END"})
WIDE_FIELDS = [("o_orderkey", "N", 6, 0), ("note", "C", 20, 0), ("price", "N", 12, 2), ("share", "F", 20, 2), ("day", "D", 8, 0), ("sign", "C", 1, 0)]


def _wide(spark, sf):
    from keelson.operators.scale import new_folder
    rows = WIDE.df(spark, sf)
    path = new_folder(spark, "dbf")
    unfit = dbf.write_dbf(rows, path, [dbf.Field(*f) for f in WIDE_FIELDS], rows_per_file=5000)
    return dbf.read_dbf(spark, path, rows.columns), unfit


_UNFIT = f"""
    WITH x AS ({WIDE.sql}),
    judged AS (SELECT *, list_filter([
        CASE WHEN length(CAST(o_orderkey AS VARCHAR)) > 6 THEN 'overflow:o_orderkey' END, CASE WHEN length(note) > 20 THEN 'length:note' END,
        CASE WHEN o_orderkey % 2 = 1 THEN 'scale:share' END, CASE WHEN o_orderkey % 7 = 0 THEN 'charset:sign' END], lambda c: c IS NOT NULL) AS reasons FROM x)"""
QUERIES["dbf_rejects"] = Query(
    lambda spark, sf: _wide(spark, sf)[1].select("o_orderkey", F.array_join("reasons", ",").alias("reasons")),
    f"{_UNFIT} SELECT o_orderkey, array_to_string(reasons, ',') AS reasons FROM judged WHERE len(reasons) > 0")
QUERIES["dbf_wide_values"] = Query(
    lambda spark, sf: _wide(spark, sf)[0].select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "note", F.col("price").cast("string").alias("price"),
                                                 F.round("share", 2).alias("share"), F.col("day").cast("string").alias("day"), "sign"),
    f"""{_UNFIT} SELECT o_orderkey, note, CAST(price AS VARCHAR) AS price, round(o_orderkey / 8, 2) AS share, strftime(day, '%Y-%m-%d') AS day, sign
    FROM judged WHERE len(reasons) = 0""")

LONG_NAMES = Recipe("part", {"db": "lower(p_brand)", "table_name": "p_type", "column_name": "replace(p_name, ' ', '_') || '_' || CAST(p_size AS STRING)"})
QUERIES["dbf_name_collisions"] = Query(
    lambda spark, sf: dbf.collisions(LONG_NAMES.df(spark, sf)),
    f"""WITH x AS ({LONG_NAMES.sql})
    SELECT db, table_name, lower(left(column_name, 10)) AS short_name, count(DISTINCT lower(column_name)) AS n_columns
    FROM x GROUP BY ALL HAVING count(DISTINCT lower(column_name)) > 1""")

# ---- identifiers ----

NAMES = Recipe("part", {
    "p_partkey": "p_partkey",
    "t": "p_type || ' ' || CASE p_partkey % 4 WHEN 0 THEN '\"x\"' WHEN 1 THEN '`y`' WHEN 2 THEN '[z]' ELSE 'plain' END",
    "c": "p_name || ' of brand ' || p_brand || '  ' || CASE p_partkey % 2 WHEN 0 THEN '' ELSE p_type END",
    "given": case_of("p_partkey % 3", ["'  '", "'my_fk'", None]),
})


def _identifiers(spark, sf):
    t, c = F.col("t"), F.col("c")
    return NAMES.df(spark, sf).select(
        "p_partkey", *[tx.quote(b, t).alias(f"q_{b.lower()}") for b in ("SQLite", "MySQL", "SqlServer", "Access", "Oracle")],
        tx.quote_script("Oracle", t).alias("q_script"),
        *[tx.fit_identifier(b, c).alias(f"fit_{b.lower()}") for b in ("Firebird", "Oracle", "DBase", "DB2", "MySQL")],
        tx.fk_name(F.col("given"), t, c).alias("fk"), tx.script_fk_name(t, c, F.col("p_partkey")).alias("fk_script"),
        tx.index_name(t, c).alias("ix"))


QUERIES["identifiers"] = Query(_identifiers, f"""
    WITH x AS ({NAMES.sql})
    SELECT p_partkey, '"' || replace(t, '"', '""') || '"' AS q_sqlite, '`' || replace(t, '`', '``') || '`' AS q_mysql,
           '[' || replace(t, ']', ']]') || ']' AS q_sqlserver, '[' || t || ']' AS q_access,
           '"' || replace(upper(t), '"', '""') || '"' AS q_oracle, '"' || replace(t, '"', '""') || '"' AS q_script,
           rtrim(left(c, 31)) AS fit_firebird, upper(c) AS fit_oracle, left(c, 10) AS fit_dbase, rtrim(c) AS fit_db2,
           c AS fit_mysql, CASE WHEN given IS NULL OR trim(given) = '' THEN 'FK_' || t || '_' || c ELSE given END AS fk,
           'fk_' || t || '_' || c || '_' || p_partkey AS fk_script, left('IX_' || t || '_' || c, 64) AS ix
    FROM x""")

# ---- text rules over whole documents ----

PIECES = Recipe("documents", {
    "doc_id": "doc_id", "text": "CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 9 = 1 THEN NULL ELSE text END",
    "yes": case_of("doc_id % 5", ["''", "'YES'", "'yes'", "'No'", None]),
    "flag": case_of("doc_id % 4", ["'True'", "'TRUE'", "'1'", None]),
    "size": case_of("doc_id % 6", ["' 20 '", "'+5'", "'2.5'", "'x'", "''", None]),
})


def _rules(spark, sf):
    return PIECES.df(spark, sf).select(
        "doc_id", F.length(tx.null_if_empty(F.col("text"))).alias("kept_chars"), tx.limit_len(F.col("text"), 255).alias("first_chars"),
        tx.allow_null_text(F.col("yes")).alias("allow_null"), tx.key_flag(F.col("flag")).alias("is_key"),
        tx.to_int_or_zero(F.col("size")).alias("size"), tx.type_or_variant(F.col("yes")).alias("type"))


QUERIES["str_rules"] = Query(_rules, f"""
    WITH x AS ({PIECES.sql})
    SELECT doc_id, CAST(length(NULLIF(text, '')) AS INTEGER) AS kept_chars, left(text, 255) AS first_chars,
           CASE WHEN yes IS NULL OR yes = '' OR lower(yes) = 'yes' THEN 'YES' ELSE yes END AS allow_null,
           COALESCE(lower(flag) = 'true', FALSE) AS is_key,
           CASE WHEN regexp_full_match(trim(size), '[+-]?[0-9]+') THEN CAST(trim(size) AS INTEGER) ELSE 0 END AS size,
           CASE WHEN yes IS NULL OR yes = '' THEN 'adVariant' ELSE yes END AS type
    FROM x""")

# ---- tenant registry ----

ADDRESSES = [
    "'/data/' || s_name || '.sqlite'", "'C:/x/' || s_name || '.DB'", "s_name || '.accdb'", "s_name || '.mdb'",
    "s_name || '.fdb'", "s_name || '.gdb'", "s_name || '.dbf'", "'Host=' || s_name || ';Port=3306;Uid=a'",
    "'host=' || s_name || ';Database=b'", "'DataSource=' || s_name || ';Database=b;User=c'",
    "'Data Source=' || s_name || ';User Id=b'", "'Server=' || s_name || ';UID=y'", "'Server=' || s_name || ';Database=y'",
    "'Server=' || s_name || ';Initial Catalog=y'", "'somewhere ' || s_name",
    "'ODBC;DSN=d;DATABASE= C:/a/' || s_name || '.sqlite ;X=1'", "'odbc;DSN=' || s_name", "'  '", None,
]
REGISTRY = Recipe("supplier", {
    "s_suppkey": "s_suppkey", "Adresa": case_of(f"s_suppkey % {len(ADDRESSES)}", ADDRESSES),
    "NazivFirme": case_of("s_suppkey % 3", ["s_name", "''", None]),
    "Skriven": case_of("s_suppkey % 7", ["'0'", "'1'", "'0'", "'0'", "'x'", "'0'", None]),
})
BACKEND_SQL = """CASE
    WHEN regexp_matches(lower(a), '[.](sqlite|db)$') THEN 'SQLite' WHEN regexp_matches(lower(a), '[.](accdb|mdb)$') THEN 'Access'
    WHEN regexp_matches(lower(a), '[.](fdb|gdb)$') THEN 'Firebird' WHEN lower(a) LIKE '%.dbf' THEN 'DBase'
    WHEN a ILIKE '%host=%' AND a ILIKE '%port=3306%' THEN 'MySQL' WHEN a ILIKE '%host=%' THEN 'PostgreSQL'
    WHEN a ILIKE '%datasource=%' AND a ILIKE '%database=%' AND a ILIKE '%user=%' THEN 'Firebird'
    WHEN a ILIKE '%data source=%' AND a ILIKE '%user id=%' THEN 'Oracle'
    WHEN a ILIKE '%server=%' AND a ILIKE '%uid=%' THEN 'DB2'
    WHEN a ILIKE '%server=%' AND (a ILIKE '%database=%' OR a ILIKE '%initial catalog=%') THEN 'SqlServer' END"""
REGISTRY_SQL = f"""
    r AS (SELECT * FROM ({REGISTRY.sql}) WHERE trim(COALESCE(Adresa, '')) <> '' AND COALESCE(Skriven, '0') = '0'),
    p AS (SELECT *, CASE WHEN lower(Adresa) LIKE 'odbc%' AND regexp_matches(lower(Adresa), 'database=[^;]+')
                    THEN trim(regexp_extract(Adresa, '(?i)database=([^;]+)', 1)) ELSE Adresa END AS a FROM r),
    e AS (SELECT s_suppkey, CASE WHEN trim(COALESCE(NazivFirme, '')) = '' THEN a ELSE NazivFirme END AS label,
                 {BACKEND_SQL} AS backend, a AS address FROM p)"""
QUERIES["registry_detect"] = Query(
    lambda spark, sf: catalog.read_registry(REGISTRY.df(spark, sf)),
    f"""WITH {REGISTRY_SQL}
    SELECT label, backend, address, CASE WHEN backend IS NULL THEN 'backend not recognised: ' || address END AS reason FROM e""")

BATCH = Recipe("supplier", {
    "s_suppkey": "s_suppkey", "address": "CASE WHEN s_suppkey % 3 = 0 THEN upper('/data/db_' || CAST(s_nationkey AS STRING) || '.db') "
                                         "ELSE '/data/db_' || CAST(s_nationkey AS STRING) || '.db' END"})
QUERIES["registry_batch"] = Query(
    lambda spark, sf: ingest.batch_list(BATCH.df(spark, sf), "s_suppkey"),
    f"""WITH x AS ({BATCH.sql})
    SELECT min(s_suppkey) AS s_suppkey, arg_min(address, s_suppkey) AS address FROM x GROUP BY lower(address)""")

TABLE_NAMES = Recipe("supplier", {
    "db": "s_name", "table_name": case_of("s_suppkey % 5", ["'FirmeAdrese'", "'firmaadresa'", "'FIRMEADRESE'", "'firme'", "'adrese'"])})
QUERIES["registry_tables"] = Query(
    lambda spark, sf: catalog.find_registry(TABLE_NAMES.df(spark, sf)),
    f"WITH x AS ({TABLE_NAMES.sql}) SELECT * FROM x WHERE lower(table_name) IN ('firmeadrese', 'firmaadresa')")
