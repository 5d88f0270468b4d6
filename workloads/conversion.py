"""Value conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import convert as cv
from keelson.functions import types as ty
from workloads.base import Query, Recipe, case_of

QUERIES: dict[str, Query] = {}

# ---- booleans ----

BOOLEANS = Recipe("orders", {
    "o_orderkey": "o_orderkey",
    "word": case_of("o_orderkey % 11", ["'1'", "'-1'", "'0'", "'true'", "'YES'", "'t'", "'.T.'", "'y'", "''", "' true'", None]),
    "number": "CAST(o_orderkey % 4 - 1 AS INT)",
    "price": "o_totalprice * (o_orderkey % 2)",
})


def _booleans(spark, sf_dir):
    df = BOOLEANS.df(spark, sf_dir)
    kind = {f.name: f.dataType for f in df.schema}
    return df.select(
        "o_orderkey",
        cv.to_canonical("word", kind["word"], ty.BOOLEAN).alias("from_word"),
        cv.to_canonical("price", kind["price"], ty.BOOLEAN).alias("from_price"),
        cv.canonical_value("number", kind["number"], ty.INT32, ty.BOOLEAN).alias("from_number"))


QUERIES["cnv_boolean"] = Query(_booleans, f"""
    WITH x AS ({BOOLEANS.sql})
    SELECT o_orderkey, word IN ('1', '-1') OR lower(word) IN ('true', 'yes', 't', '.t.') AS from_word,
           price <> 0 AS from_price, number <> 0 AS from_number
    FROM x""")

# ---- number texts ----


def sql_number(c: str) -> str:
    """Plain number text of the shapes in the recipes below, NULL for anything else."""
    t = f"trim({c})"
    bare = f"replace(replace({t}, ',', ''), '+', '')"
    core = f"replace(replace(replace({bare}, '(', ''), ')', ''), '-', '')"
    minus = f"({t} LIKE '(%' OR {t} LIKE '-%' OR {t} LIKE '%-')"
    fine = f"regexp_full_match({core}, '[0-9]+([.][0-9]*)?(e[0-9]+)?')"
    return f"CASE WHEN {fine} THEN CASE WHEN {minus} THEN '-' ELSE '' END || {core} END"


def sql_whole(c: str) -> str:
    wide = f"TRY_CAST({sql_number(c)} AS DECIMAL(38,10))"
    return f"CASE WHEN {wide} = floor({wide}) THEN TRY_CAST({wide} AS BIGINT) END"


def _number_texts(n: str, big: str) -> list[str | None]:
    return [f"' ' || {n} || ' '", f"{n} || ',234'", f"'(' || {n} || ')'", f"{n} || '-'", f"{n} || '.0'", f"{n} || '.5'",
            f"'x' || {n}", f"{n} || 'e2'", f"'+' || {n}", f"'-' || {n}", big, "''", None]


KEY = "CAST(l_orderkey AS STRING)"
WHOLE = Recipe("lineitem", {
    "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey",
    "big": "l_orderkey * 1000000 * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END)",
    "raw": case_of("(l_orderkey + l_linenumber) % 13", _number_texts(KEY, f"{KEY} || '99999999'")),
    "half": "CAST(l_orderkey AS DOUBLE) + 0.5",
})


def _int32(spark, sf_dir):
    df = WHOLE.df(spark, sf_dir)
    kind = {f.name: f.dataType for f in df.schema}
    one = lambda c: cv.to_canonical(c, kind[c], ty.INT32).alias(f"{c}_int32")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", one("big"), one("raw"), one("half"))


def _int64(spark, sf_dir):
    df = WHOLE.df(spark, sf_dir)
    kind = {f.name: f.dataType for f in df.schema}
    one = lambda c: cv.to_canonical(c, kind[c], ty.INT64).alias(f"{c}_int64")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", one("big"), one("raw"), one("half"))


HALF_EVEN = "CAST(round_even(half, 0) AS {t})"
QUERIES["cnv_int32_clamp"] = Query(_int32, f"""
    WITH x AS ({WHOLE.sql})
    SELECT l_orderkey, l_linenumber, l_partkey,
           CAST(greatest(least(big, 2147483647), -2147483648) AS INTEGER) AS big_int32,
           CASE WHEN raw IS NOT NULL THEN COALESCE(TRY_CAST({sql_whole('raw')} AS INTEGER), 0) END AS raw_int32,
           {HALF_EVEN.format(t='INTEGER')} AS half_int32
    FROM x""")
QUERIES["cnv_int64"] = Query(_int64, f"""
    WITH x AS ({WHOLE.sql})
    SELECT l_orderkey, l_linenumber, l_partkey, big AS big_int64,
           CASE WHEN raw IS NOT NULL THEN COALESCE({sql_whole('raw')}, 0) END AS raw_int64,
           {HALF_EVEN.format(t='BIGINT')} AS half_int64
    FROM x""")

PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)"
PRICES = Recipe("lineitem", {
    "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey",
    "price": "l_extendedprice",
    "raw": case_of("(l_orderkey + l_linenumber) % 10", [
        PRICE, f"' ' || {PRICE}", f"'1,' || {PRICE}", f"{PRICE} || '-'", f"'(' || {PRICE} || ')'", f"'EUR ' || {PRICE}",
        f"replace({PRICE}, '.', ',')", f"{PRICE} || 'e1'", "''", None]),
})


def _prices(canonical, name, as_text):
    def run(spark, sf_dir):
        df = PRICES.df(spark, sf_dir)
        kind = {f.name: f.dataType for f in df.schema}
        cols = []
        for c in ("raw", "price"):
            value = cv.to_canonical(c, kind[c], canonical)
            cols.append((value.cast("string") if as_text else value).alias(f"{c}_{name}"))
        return df.select("l_orderkey", "l_linenumber", "l_partkey", *cols)
    return run


QUERIES["cnv_double"] = Query(_prices(ty.DOUBLE, "double", False), f"""
    WITH x AS ({PRICES.sql})
    SELECT l_orderkey, l_linenumber, l_partkey, price AS price_double,
           CASE WHEN raw IS NOT NULL THEN COALESCE(TRY_CAST({sql_number('raw')} AS DOUBLE), 0.0) END AS raw_double
    FROM x""")
QUERIES["cnv_decimal"] = Query(_prices(ty.DECIMAL, "decimal", True), f"""
    WITH x AS ({PRICES.sql})
    SELECT l_orderkey, l_linenumber, l_partkey,
           CAST(CAST(CAST(price AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS VARCHAR) AS price_decimal,
           CASE WHEN raw IS NOT NULL THEN CAST(COALESCE(TRY_CAST({sql_number('raw')} AS DECIMAL(38,10)), 0) AS VARCHAR)
           END AS raw_decimal
    FROM x""")

# ---- texts ----

TEXTS = Recipe("customer", {
    "c_custkey": "c_custkey", "c_acctbal": "c_acctbal", "c_nationkey": "c_nationkey",
    "positive": "c_acctbal > 0", "since": "DATE '1995-01-01' + CAST(c_custkey AS INT)", "c_name": "c_name",
})


def _texts(spark, sf_dir):
    df = TEXTS.df(spark, sf_dir)
    kind = {f.name: f.dataType for f in df.schema}
    one = lambda c: cv.to_canonical(c, kind[c], ty.TEXT).alias(f"{c}_text")
    return df.select("c_custkey", one("c_acctbal"), one("c_nationkey"), one("positive"), one("since"), one("c_name"),
                     cv.to_canonical("c_nationkey", kind["c_nationkey"], ty.UNKNOWN).alias("passed"))


QUERIES["cnv_text"] = Query(_texts, f"""
    WITH x AS ({TEXTS.sql})
    SELECT c_custkey, regexp_replace(CAST(c_acctbal AS VARCHAR), '[.]0$', '') AS c_acctbal_text,
           CAST(c_nationkey AS VARCHAR) AS c_nationkey_text,
           CASE WHEN positive THEN 'True' ELSE 'False' END AS positive_text,
           strftime(since, '%Y-%m-%d') AS since_text, c_name AS c_name_text, c_nationkey AS passed
    FROM x""")

# ---- dates ----


def _two(part: str, column: str) -> str:
    return f"lpad(CAST({part}({column}) AS STRING), 2, '0')"


def _day_texts(c: str) -> list[str | None]:
    y, m, d = f"CAST(year({c}) AS STRING)", _two("month", c), _two("day", c)
    short = f"CAST(day({c}) AS STRING) || '.' || CAST(month({c}) AS STRING) || '.' || {y}"
    return [f"{y} || '-' || {m} || '-' || {d}", f"{d} || '.' || {m} || '.' || {y}", short,
            f"{d} || '/' || {m} || '/' || {y}", f"{m} || '/' || {d} || '/' || {y}", f"{y} || '.' || {m} || '.' || {d}",
            f"{d} || '.' || {m} || '.' || {y} || ' 00:00:00'", f"'on ' || {y}", "''", None]


DATES = Recipe("orders", {
    "o_orderkey": "o_orderkey", "raw": case_of("o_orderkey % 10", _day_texts("o_orderdate")),
    "moment": "o_orderdate", "number": "CAST(o_orderkey AS INT)", "serial": "o_orderkey % 100000",
})


def sql_first(c: str, formats: list[str]) -> str:
    return "COALESCE(" + ", ".join(f"try_strptime({c}, '{f}')" for f in formats) + ")"


DATE_FORMATS = ["%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y.%m.%d"]
TIME_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%g", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%g", "%Y-%m-%d",
                "%d.%m.%Y %H:%M:%S", "%d.%m.%Y", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y"]
SQL_DATE = sql_first("raw", DATE_FORMATS + TIME_FORMATS)
SQL_TIME = sql_first("raw", TIME_FORMATS)


def _dates(spark, sf_dir):
    df = DATES.df(spark, sf_dir)
    kind = {f.name: f.dataType for f in df.schema}
    one = lambda c: cv.to_canonical(c, kind[c], ty.DATE).cast("string").alias(f"{c}_date")
    return df.select("o_orderkey", one("raw"), one("moment"), one("number"), one("serial"))


QUERIES["cnv_date_text"] = Query(_dates, f"""
    WITH x AS ({DATES.sql})
    SELECT o_orderkey,
           CASE WHEN raw IS NOT NULL THEN CAST(COALESCE(CAST({SQL_DATE} AS DATE), DATE '0001-01-01') AS VARCHAR) END AS raw_date,
           CAST(CAST(moment AS DATE) AS VARCHAR) AS moment_date, '0001-01-01' AS number_date,
           CAST(DATE '1899-12-30' + CAST(serial AS INTEGER) AS VARCHAR) AS serial_date
    FROM x""")


def _moment_texts(c: str) -> list[str | None]:
    y, m, d = f"CAST(year({c}) AS STRING)", _two("month", c), _two("day", c)
    t = f"{_two('hour', c)} || ':' || {_two('minute', c)} || ':' || lpad(CAST(CAST(floor(second({c})) AS INT) AS STRING), 2, '0')"
    iso, dots, slashes = f"{y} || '-' || {m} || '-' || {d}", f"{d} || '.' || {m} || '.' || {y}", f"{d} || '/' || {m} || '/' || {y}"
    short = f"CAST(day({c}) AS STRING) || '.' || CAST(month({c}) AS STRING) || '.' || {y}"
    us = f"{m} || '/' || {d} || '/' || {y}"
    return [f"{iso} || ' ' || {t}", f"{iso} || ' ' || {t} || '.250'", f"{iso} || 'T' || {t}", f"{iso} || 'T' || {t} || '.007'",
            iso, f"{dots} || ' ' || {t}", f"{short} || ' ' || {t}", dots, short, f"{slashes} || ' ' || {t}", slashes,
            f"{us} || ' ' || {t}", us, f"'at ' || {t}", "' '", None]


MOMENTS = Recipe("events", {
    "event_id": "event_id", "raw": case_of("event_id % 16", _moment_texts("ts")), "day": "CAST(ts AS DATE)",
})


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


def _moments(spark, sf_dir):
    df = MOMENTS.df(spark, sf_dir)
    kind = {f.name: f.dataType for f in df.schema}
    one = lambda c: _stamp(cv.to_canonical(c, kind[c], ty.DATETIME)).alias(f"{c}_moment")
    return df.select("event_id", one("raw"), one("day"))


SQL_STAMP = "lpad(CAST(year({c}) AS VARCHAR), 4, '0') || strftime({c}, '-%m-%d %H:%M:%S.%g')"
QUERIES["cnv_datetime_text"] = Query(_moments, f"""
    WITH x AS ({MOMENTS.sql}),
    y AS (SELECT *, COALESCE({SQL_TIME}, TIMESTAMP '0001-01-01 00:00:00') AS found FROM x)
    SELECT event_id, CASE WHEN raw IS NOT NULL THEN {SQL_STAMP.format(c='found')} END AS raw_moment,
           strftime(day, '%Y-%m-%d') || ' 00:00:00.000' AS day_moment
    FROM y""")

SERIALS = Recipe("events", {"event_id": "event_id", "serial": "value * 1000 - 5000", "far": "value * 100000"})


def _serials(spark, sf_dir):
    df = SERIALS.df(spark, sf_dir)
    kind = {f.name: f.dataType for f in df.schema}
    return df.select(
        "event_id", _stamp(cv.to_canonical("serial", kind["serial"], ty.DATETIME)).alias("serial_moment"),
        cv.to_canonical("serial", kind["serial"], ty.DATE).cast("string").alias("serial_date"),
        cv.overflowed("far", kind["far"], ty.DATETIME).alias("far_overflowed"))


QUERIES["cnv_ole_date"] = Query(_serials, f"""
    WITH x AS ({SERIALS.sql}),
    m AS (SELECT *, CAST(trunc(serial * 86400000.0 + CASE WHEN serial >= 0 THEN 0.5 ELSE -0.5 END) AS BIGINT) AS ms FROM x),
    f AS (SELECT *, CASE WHEN ms < 0 THEN ms - (ms % 86400000) * 2 ELSE ms END AS flipped FROM m),
    t AS (SELECT *, TIMESTAMP '1899-12-30 00:00:00' + to_milliseconds(flipped) AS found FROM f)
    SELECT event_id, strftime(found, '%Y-%m-%d %H:%M:%S.%g') AS serial_moment,
           strftime(found, '%Y-%m-%d') AS serial_date, far >= 2958466.0 AS far_overflowed
    FROM t""")

# ---- guids and bytes ----

DIGITS = "md5(text)"


def _dashed(digits: str) -> str:
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substring({digits}, {a}, {n})" for a, n in parts)


GUIDS = Recipe("documents", {
    "doc_id": "doc_id",
    "raw": case_of("doc_id % 7", [
        DIGITS, f"upper({_dashed(DIGITS)})", f"'{{' || {_dashed(DIGITS)} || '}}'", f"' (' || {_dashed(DIGITS)} || ') '",
        f"substring({DIGITS}, 1, 31)", "'x'", None]),
    "stored": f"unhex(CASE WHEN doc_id % 5 = 0 THEN substring({DIGITS}, 1, 30) ELSE {DIGITS} END)",
    "digits": DIGITS,
})


def _guids(spark, sf_dir):
    df = GUIDS.df(spark, sf_dir)
    kind = {f.name: f.dataType for f in df.schema}
    one = lambda c: cv.to_canonical(c, kind[c], ty.GUID).alias(f"{c}_guid")
    return df.select("doc_id", one("raw"), one("stored"))


ZERO = "'00000000-0000-0000-0000-000000000000'"
MIXED = "".join(f"substring(digits, {a}, 2) || " for a in (7, 5, 3, 1)) + "'-' || " + \
        "".join(f"substring(digits, {a}, 2) || " for a in (11, 9)) + "'-' || " + \
        "".join(f"substring(digits, {a}, 2) || " for a in (15, 13)) + "'-' || substring(digits, 17, 4) || '-' || substring(digits, 21, 12)"
QUERIES["cnv_guid"] = Query(_guids, f"""
    WITH x AS ({GUIDS.sql})
    SELECT doc_id, CASE WHEN raw IS NOT NULL THEN lower(COALESCE(CAST(TRY_CAST(
               CASE WHEN trim(raw) LIKE '(%)' THEN substring(trim(raw), 2, length(trim(raw)) - 2) ELSE raw END
               AS UUID) AS VARCHAR), {ZERO})) END AS raw_guid,
           CASE WHEN octet_length(stored) = 16 THEN {MIXED} ELSE {ZERO} END AS stored_guid
    FROM x""")


def _bytes(spark, sf_dir):
    df = GUIDS.df(spark, sf_dir)
    kind = {f.name: f.dataType for f in df.schema}
    return df.select(
        "doc_id", F.hex(cv.to_canonical("stored", kind["stored"], ty.BYTES)).alias("stored_hex"),
        F.hex(cv.to_canonical("raw", kind["raw"], ty.BYTES)).alias("raw_hex"))


QUERIES["cnv_bytes"] = Query(_bytes, f"""
    WITH x AS ({GUIDS.sql})
    SELECT doc_id, upper(hex(stored)) AS stored_hex, CAST(NULL AS VARCHAR) AS raw_hex FROM x""")

# ---- defaults ----

GAPS = Recipe("orders", {
    "o_orderkey": "o_orderkey",
    "o_custkey": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END",
    "o_orderstatus": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END",
    "o_totalprice": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END",
    "o_orderdate": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "broken": "o_orderkey % 2 = 0",
})


def _defaults(spark, sf_dir):
    df = GAPS.df(spark, sf_dir)
    kinds = {"o_custkey": ty.INT64, "o_orderstatus": ty.TEXT, "o_totalprice": ty.DOUBLE, "o_orderdate": ty.DATE}
    return cv.default_nulls(df, kinds, F.col("broken")).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


QUERIES["null_defaults"] = Query(_defaults, f"""
    WITH x AS ({GAPS.sql})
    SELECT o_orderkey, CASE WHEN broken THEN COALESCE(o_custkey, 0) ELSE o_custkey END AS o_custkey,
           CASE WHEN broken THEN COALESCE(o_orderstatus, '') ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN broken THEN COALESCE(o_totalprice, 0.0) ELSE o_totalprice END AS o_totalprice,
           CAST(CASE WHEN broken THEN COALESCE(o_orderdate, DATE '0001-01-01') ELSE o_orderdate END AS VARCHAR) AS o_orderdate,
           broken
    FROM x""")


def _warnings(spark, sf_dir):
    dates = DATES.df(spark, sf_dir)
    kind = {f.name: f.dataType for f in dates.schema}
    flags = dates.select(*[
        cv.was_defaulted(c, kind[c], canonical).alias(n) for c, canonical, n in (
            ("raw", ty.DATE, "date_text"), ("raw", ty.DATETIME, "moment_text"), ("moment", ty.BOOLEAN, "moment_as_boolean"),
            ("number", ty.DATE, "number_as_date"))])
    return flags.agg(*[F.count_if(n).alias(n) for n in flags.columns])


QUERIES["default_warnings"] = Query(_warnings, f"""
    WITH x AS ({DATES.sql})
    SELECT count(*) FILTER (WHERE trim(raw) <> '' AND {SQL_DATE} IS NULL) AS date_text,
           count(*) FILTER (WHERE trim(raw) <> '' AND {SQL_TIME} IS NULL) AS moment_text,
           count(*) FILTER (WHERE moment IS NOT NULL) AS moment_as_boolean,
           count(*) FILTER (WHERE number IS NOT NULL) AS number_as_date
    FROM x""")


def _canonicalise(spark, sf_dir):
    """All columns of a text export of orders, back to their types in one pass."""
    df = Recipe("orders", {
        "O_ORDERKEY": "CAST(o_orderkey AS STRING)", "O_CUSTKEY": "' ' || CAST(o_custkey AS STRING)",
        "O_TOTALPRICE": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)", "OPEN": "CASE WHEN o_orderstatus = 'O' THEN '-1' ELSE '0' END",
        "O_ORDERDATE": _day_texts("o_orderdate")[1],
    }).df(spark, sf_dir)
    return cv.canonicalise(
        df, {"o_orderkey": ty.INT64, "o_custkey": ty.INT32, "o_totalprice": ty.DOUBLE, "open": ty.BOOLEAN, "o_orderdate": ty.DATE}
    ).toDF("o_orderkey", "o_custkey", "o_totalprice", "is_open", "o_orderdate").withColumn(
        "o_orderdate", F.col("o_orderdate").cast("string"))


QUERIES["canonicalise_rows"] = Query(_canonicalise, """
    SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS o_totalprice,
           o_orderstatus = 'O' AS is_open, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate
    FROM orders""")
