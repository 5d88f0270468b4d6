"""Table transfer: dirty copies of lineitem and orders into checked targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import types as ty
from keelson.functions.convert import decimal_types
from keelson.operators import filters
from keelson.operators.scale import new_folder
from keelson.plans import transfer as job
from keelson.plans.sync import conform_table
from keelson.plans.transfer import Rules, Target
from keelson.sources.stores import FileStore
from workloads.base import Query, Recipe, case_of, table, text

QUERIES: dict[str, Query] = {}

# Legacy export: numbers and dates as text, gaps, over-long and out-of-range values.
MIX = "(l_orderkey + l_linenumber + l_partkey)"
DAY = ("lpad(CAST(day(l_shipdate) AS STRING), 2, '0') || '.' || lpad(CAST(month(l_shipdate) AS STRING), 2, '0')"
       " || '.' || CAST(year(l_shipdate) AS STRING)")
DIRTY = Recipe("lineitem", {
    "L_ORDERKEY": "' ' || CAST(l_orderkey AS STRING)",
    "L_PARTKEY": f"CASE WHEN {MIX} % 41 = 0 THEN l_partkey * 10000000000 ELSE l_partkey END",
    "L_Quantity": f"CASE WHEN {MIX} % 23 = 0 THEN NULL ELSE '1,' || CAST(CAST(l_quantity AS INT) + 100 AS STRING) END",
    "L_PRICE": f"CASE WHEN {MIX} % 53 = 0 THEN l_extendedprice * 1e30 ELSE l_extendedprice END",
    "L_FLAG": f"CASE WHEN {MIX} % 19 = 0 THEN NULL WHEN {MIX} % 37 = 0 THEN l_returnflag || '-too-long' ELSE l_returnflag END",
    "L_SHIPDATE": f"CASE WHEN {MIX} % 29 = 0 THEN NULL ELSE {DAY} END",
    "L_OPEN": "CASE WHEN l_linestatus = 'O' THEN -1 ELSE 0 END",
    "L_NOTE": f"CASE WHEN {MIX} % 5 = 0 THEN NULL ELSE l_linestatus END",
    "L_EXTRA": "l_tax",
})
DIRTY_TYPES = {"l_orderkey": ty.INT64, "l_partkey": ty.INT64, "l_quantity": ty.DOUBLE, "l_price": ty.DECIMAL, "l_flag": ty.TEXT,
               "l_shipdate": ty.DATE, "l_open": ty.INT32, "l_note": ty.TEXT}
LINE_TARGET = [
    Target("l_orderkey", ty.INT64, True), Target("l_partkey", ty.INT32, True), Target("l_quantity", ty.INT32),
    Target("l_price", ty.DECIMAL, True), Target("l_flag", ty.TEXT, True, 4), Target("l_shipdate", ty.DATE, True),
    Target("l_open", ty.BOOLEAN, True), Target("l_note", ty.TEXT, False, 10), Target("l_missing", ty.TEXT),
]
DIRTY_ORDERS = Recipe("orders", {
    "o_orderkey": "o_orderkey", "o_custkey": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_custkey END",
    "o_orderpriority": "o_orderpriority", "o_totalprice": "o_totalprice",
})
ORDER_TARGET = [Target("o_orderkey", ty.INT64, True), Target("o_custkey", ty.INT64, True),
                Target("o_orderpriority", ty.TEXT, True, 10), Target("o_totalprice", ty.DOUBLE)]


def split_lines(spark, sf):
    return job.split_rows(DIRTY.placed(spark, sf), LINE_TARGET, Rules(DIRTY_TYPES))


def split_orders(spark, sf):
    return job.split_rows(DIRTY_ORDERS.placed(spark, sf), ORDER_TARGET)


def _printable(df):
    return df.withColumns({"l_price": F.col("l_price").cast("string"), "l_shipdate": F.col("l_shipdate").cast("string")})


LINES = f"""
    raw AS ({DIRTY.placed_sql}),
    conv AS (SELECT CAST(trim(L_ORDERKEY) AS BIGINT) AS l_orderkey, L_PARTKEY AS big, TRY_CAST(L_PARTKEY AS INTEGER) AS l_partkey,
        TRY_CAST(replace(L_Quantity, ',', '') AS INTEGER) AS l_quantity,
        L_PRICE AS price, TRY_CAST(CASE WHEN L_PRICE < 1e15 THEN round(L_PRICE, 2) END AS DECIMAL(38,10)) AS l_price, L_FLAG AS l_flag,
        CAST(strptime(L_SHIPDATE, '%d.%m.%Y') AS DATE) AS l_shipdate, L_OPEN <> 0 AS l_open, L_NOTE AS l_note, _row FROM raw),
    judged AS (SELECT *, list_filter([
            CASE WHEN big IS NOT NULL AND l_partkey IS NULL THEN 'type:l_partkey' END,
            CASE WHEN price IS NOT NULL AND l_price IS NULL THEN 'overflow:l_price' END,
            CASE WHEN length(l_flag) > 4 THEN 'length:l_flag' END], lambda x: x IS NOT NULL) AS reasons,
        l_flag IS NULL OR l_shipdate IS NULL AS soft FROM conv),
    marked AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'rejected' WHEN soft THEN 'repaired' ELSE 'clean' END AS status FROM judged)"""
QUERIES["transfer_clean"] = Query(
    lambda spark, sf: _printable(job.accepted(split_lines(spark, sf))),
    f"""WITH {LINES}
    SELECT l_orderkey, l_partkey, CASE WHEN status = 'repaired' THEN COALESCE(l_quantity, 0) ELSE l_quantity END AS l_quantity,
           CAST(l_price AS VARCHAR) AS l_price, CASE WHEN status = 'repaired' THEN COALESCE(l_flag, '') ELSE l_flag END AS l_flag,
           CAST(CASE WHEN status = 'repaired' THEN COALESCE(l_shipdate, DATE '0001-01-01') ELSE l_shipdate END AS VARCHAR) AS l_shipdate,
           l_open, CASE WHEN status = 'repaired' THEN COALESCE(l_note, '') ELSE l_note END AS l_note
    FROM marked WHERE status <> 'rejected'""")
QUERIES["transfer_rejects"] = Query(
    lambda spark, sf: _printable(job.rejected(split_lines(spark, sf))).withColumn("reasons", F.array_join("reasons", ",")),
    f"""WITH {LINES}
    SELECT l_orderkey, l_partkey, l_quantity, CAST(l_price AS VARCHAR) AS l_price, l_flag, CAST(l_shipdate AS VARCHAR) AS l_shipdate,
           l_open, l_note, reasons[1] AS first_reason, array_to_string(reasons, ',') AS reasons
    FROM marked WHERE status = 'rejected'""")
REPORT = f"""
    orders_marked AS (SELECT CASE WHEN length(o_orderpriority) > 10 THEN 'rejected' WHEN o_custkey IS NULL THEN 'repaired'
                             ELSE 'clean' END AS status, 'length:o_orderpriority' AS reason, _row FROM ({DIRTY_ORDERS.placed_sql})),
    both_tables AS (SELECT 'lineitem' AS table_name, status, reasons[1] AS reason, _row FROM marked
                    UNION ALL SELECT 'orders', status, reason, _row FROM orders_marked),
    counted AS (SELECT table_name, 'ok' AS status, count(*) AS rows_read, count(*) FILTER (WHERE status = 'clean') AS rows_clean,
                       count(*) FILTER (WHERE status = 'repaired') AS rows_repaired,
                       count(*) FILTER (WHERE status = 'rejected') AS rows_rejected,
                       arg_min(reason, _row) FILTER (WHERE status = 'rejected') AS first_error FROM both_tables GROUP BY table_name),
    report AS (SELECT * EXCLUDE (first_error), CASE WHEN rows_rejected > 0
                      THEN rows_rejected || ' row(s) rejected: ' || first_error END AS error FROM counted)"""


def _report(spark, sf):
    return job.report_of({"lineitem": split_lines(spark, sf), "orders": split_orders(spark, sf)})


QUERIES["transfer_report"] = Query(_report, f"WITH {LINES}, {REPORT} SELECT * FROM report")
QUERIES["transfer_totals"] = Query(
    lambda spark, sf: job.report_totals(_report(spark, sf)),
    f"""WITH {LINES}, {REPORT} SELECT count(*) FILTER (WHERE status = 'ok') AS tables_ok,
        count(*) FILTER (WHERE status = 'skipped') AS tables_skipped, count(error) AS n_errors FROM report""")

# ---- the job itself, over files ----

COPIED = {
    "orders": ORDER_TARGET,
    "customer": [Target("C_CUSTKEY", ty.INT64, True), Target("C_NAME", ty.TEXT, True, 20), Target("C_ACCTBAL", ty.DECIMAL, True),
                 Target("C_MKTSEGMENT", ty.TEXT, False, 9)],
    "nation": [Target("other_key", ty.INT32)],
}


def _copy(spark, sf):
    target, rejects = FileStore(new_folder(spark, "target")), FileStore(new_folder(spark, "rejects"))
    rules = {name: Rules(targets=columns) for name, columns in COPIED.items()}
    report = job.transfer(spark, FileStore(sf), target, [*COPIED, "absent"], rules, rejects)
    return report, target, rejects


def _job_report(spark, sf):
    report = _copy(spark, sf)[0]
    return report.withColumn("error", F.when(F.col("status") == "failed", F.lit("failed")).otherwise(F.col("error")))


QUERIES["transfer_job"] = Query(_job_report, """
    WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE length(o_orderpriority) > 10) AS bad FROM orders),
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE length(c_mktsegment) > 9) AS bad FROM customer)
    SELECT 'orders' AS table_name, 'ok' AS status, n AS rows_read, n - bad AS rows_clean, CAST(0 AS BIGINT) AS rows_repaired,
           bad AS rows_rejected, CASE WHEN bad > 0 THEN bad || ' row(s) rejected: length:o_orderpriority' END AS error FROM o
    UNION ALL SELECT 'customer', 'ok', n, n - bad, 0, bad, CASE WHEN bad > 0 THEN bad || ' row(s) rejected: length:C_MKTSEGMENT' END FROM c
    UNION ALL SELECT 'nation', 'skipped', 0, 0, 0, 0, NULL
    UNION ALL SELECT 'absent', 'failed', 0, 0, 0, 0, 'failed'""")


def _copied(spark, sf):
    _, target, rejects = _copy(spark, sf)
    good = target.read(spark, "customer").withColumn("first_reason", F.lit(None).cast("string"))
    bad = rejects.read(spark, "customer").drop("reasons")
    return good.unionByName(bad).withColumn("C_ACCTBAL", F.col("C_ACCTBAL").cast("string"))


QUERIES["transfer_copy"] = Query(_copied, """
    SELECT c_custkey AS "C_CUSTKEY", c_name AS "C_NAME", CAST(CAST(round(c_acctbal, 2) AS DECIMAL(38,10)) AS VARCHAR) AS "C_ACCTBAL",
           c_mktsegment AS "C_MKTSEGMENT", CASE WHEN length(c_mktsegment) > 9 THEN 'length:C_MKTSEGMENT' END AS first_reason
    FROM customer""")

# ---- keys, required columns, decimals, repeated runs ----

LINE_KEYS = [Target("l_orderkey", ty.INT64, True), Target("l_linenumber", ty.INT32), Target("l_partkey", ty.INT64)]


def _duplicate_keys(spark, sf):
    target, rejects = FileStore(new_folder(spark, "target")), FileStore(new_folder(spark, "rejects"))
    rules = {"lineitem": Rules(targets=LINE_KEYS, keys=("l_orderkey",))}
    report = job.transfer(spark, FileStore(sf), target, ["lineitem"], rules, rejects).first()
    good = target.read(spark, "lineitem").withColumn("first_reason", F.lit(None).cast("string"))
    return good.unionByName(rejects.read(spark, "lineitem").drop("reasons")).withColumn("error", F.lit(report["error"]))


QUERIES["transfer_duplicate_keys"] = Query(_duplicate_keys, """
    WITH l AS (SELECT *, row_number() OVER () AS _row FROM lineitem),
    k AS (SELECT *, _row > min(_row) OVER (PARTITION BY l_orderkey) AS late FROM l)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN late THEN 'duplicate:l_orderkey' END AS first_reason,
           (SELECT count(*) FROM k WHERE late) || ' row(s) rejected: duplicate:l_orderkey' AS error FROM k""")

REQUIRED = [Target("o_orderkey", ty.INT64, True), Target("o_totalprice", ty.DOUBLE), Target("o_region", ty.TEXT, True)]


def _missing_required(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    filled = [*REQUIRED[:2], Target("o_region", ty.TEXT, True, filled=True)]
    found = None
    for name, targets in (("left out", REQUIRED), ("filled", filled)):
        rows = job.split_rows(orders, targets).select(
            F.lit(name).alias("target"), "o_orderkey", "o_totalprice", F.col("_status").alias("status"), F.col("_reasons")[0].alias("first_reason"))
        found = rows if found is None else found.unionByName(rows)
    return found


QUERIES["transfer_missing_required"] = Query(_missing_required, """
    SELECT 'left out' AS target, o_orderkey, o_totalprice, 'rejected' AS status, 'missing:o_region' AS first_reason FROM orders
    UNION ALL SELECT 'filled', o_orderkey, o_totalprice, 'clean', NULL FROM orders""")


def _states(spark, sf, steps):
    """Rows of target and rejects after each run of the job on orders."""
    target, rejects = FileStore(new_folder(spark, "target")), FileStore(new_folder(spark, "rejects"))
    found = None
    for number, (rules, append) in enumerate(steps, 1):
        report = job.transfer(spark, FileStore(sf), target, ["orders"], {"orders": rules}, rejects, append=append)
        sizes = [store.read(spark, "orders").count() for store in (target, rejects)]
        state = report.select(F.lit(number).alias("run"), "status", "rows_read", "rows_rejected", "error",
                              F.lit(sizes[0]).cast("long").alias("in_target"), F.lit(sizes[1]).cast("long").alias("in_rejects"))
        found = state if found is None else found.unionByName(state)
    return found


PRIORITY = [Target("o_orderkey", ty.INT64, True), Target("o_orderpriority", ty.TEXT, True, 10)]
QUERIES["transfer_rerun_rejects"] = Query(
    lambda spark, sf: _states(spark, sf, [(Rules(targets=PRIORITY), False), (Rules(targets=ORDER_TARGET[:2]), False)]), """
    WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE length(o_orderpriority) > 10) AS bad FROM orders)
    SELECT 1 AS run, 'ok' AS status, n AS rows_read, bad AS rows_rejected,
           CASE WHEN bad > 0 THEN bad || ' row(s) rejected: length:o_orderpriority' END AS error, n - bad AS in_target, bad AS in_rejects FROM o
    UNION ALL SELECT 2, 'ok', n, 0, NULL, n, 0 FROM o""")
QUERIES["transfer_append"] = Query(
    lambda spark, sf: _states(spark, sf, [
        (Rules(targets=PRIORITY), False), (Rules(targets=ORDER_TARGET[:1], keys=("o_orderkey",)), True), (Rules(targets=ORDER_TARGET[:1]), True)]), """
    WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE length(o_orderpriority) > 10) AS bad FROM orders)
    SELECT 1 AS run, 'ok' AS status, n AS rows_read, bad AS rows_rejected,
           CASE WHEN bad > 0 THEN bad || ' row(s) rejected: length:o_orderpriority' END AS error, n - bad AS in_target, bad AS in_rejects FROM o
    UNION ALL SELECT 2, 'ok', n, n - bad, CASE WHEN n > bad THEN (n - bad) || ' row(s) rejected: duplicate:o_orderkey' END, n, n - bad FROM o
    UNION ALL SELECT 3, 'ok', n, 0, NULL, 2 * n, 0 FROM o""")

#: Amounts as text with eighteen places, every seventh with twenty-five.
AMOUNTS = Recipe("orders", {
    "o_orderkey": "o_orderkey",
    "amount": "CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 7 = 0 THEN '.0000000000000000000000123' ELSE '.000000000000000123' END"})


def _decimal_scale(spark, sf):
    rows = AMOUNTS.df(spark, sf)
    fitted = decimal_types(rows, ["amount"])["amount"]
    found = None
    for name, size in (("declared", (38, 18)), ("fitted", (fitted.precision, fitted.scale))):
        targets = [Target("o_orderkey", ty.INT64), Target("amount", ty.DECIMAL, decimal=size)]
        split = job.split_rows(rows, targets, Rules({"amount": ty.DECIMAL}))
        part = split.select(F.lit(name).alias("target"), "o_orderkey", F.col("_reasons")[0].alias("first_reason"),
                            F.when(F.col("_status") != job.REJECTED, F.col("amount").cast("string")).alias("amount"))
        found = part if found is None else found.unionByName(part)
    return found


QUERIES["transfer_decimal_scale"] = Query(_decimal_scale, """
    SELECT 'declared' AS target, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'scale:amount' END AS first_reason,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey || '.000000000000000123' END AS amount FROM orders
    UNION ALL SELECT 'fitted', o_orderkey, NULL, o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.0000000000000000000000123'
           ELSE '.0000000000000001230000000' END FROM orders""")

# ---- rows under a declared schema ----

DECLARED_ORDERS = [("O_ORDERKEY", "bigint"), ("o_totalprice", "double"), ("o_comment", "varchar(20)"), ("o_paid", "boolean"), ("o_due", "date")]


def _conform(drop):
    return lambda spark, sf: conform_table(
        Recipe("orders", {c: c for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")}).df(spark, sf), DECLARED_ORDERS, drop)


QUERIES["conform_rows"] = Query(_conform(False), """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, CAST(NULL AS VARCHAR) AS o_comment, CAST(NULL AS BOOLEAN) AS o_paid,
           CAST(NULL AS DATE) AS o_due FROM orders""")
QUERIES["conform_rows_dropping"] = Query(_conform(True), """
    SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_comment, CAST(NULL AS BOOLEAN) AS o_paid, CAST(NULL AS DATE) AS o_due FROM orders""")
QUERIES["project_common"] = Query(
    lambda spark, sf: filters.project_common(table(spark, sf, "orders"), ["O_OrderKey", "o_missing", "O_TOTALPRICE", "o_orderstatus"]),
    'SELECT o_orderkey AS "O_OrderKey", o_orderstatus, o_totalprice AS "O_TOTALPRICE" FROM orders')

# ---- renames ----

PART_TABLES = Recipe("part", {
    "program_id": "CAST(substring(p_brand, 7) AS BIGINT)", "table_name": "CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END",
    "column_name": "replace(p_name, ' ', '_') || CAST(p_partkey AS STRING)"})
RENAMES = Recipe("part", {
    "id": "p_partkey", "program_id": "CAST(substring(p_brand, 7) AS BIGINT)",
    "old_name": f"' ' || {case_of('p_size % 3', ['p_type', 'lower(p_type)', text('')])}",
    "new_name": "CASE WHEN p_size % 10 = 0 THEN ' ' ELSE p_type || '_v' || CAST(p_partkey AS STRING) END", "version": "CAST(p_size AS STRING)"})
OLD_RENAMES = Recipe("part", {
    "id": "p_partkey * 2", "program_id": "CAST(substring(p_brand, 7) AS BIGINT)", "old_name": "p_type",
    "new_name": "p_type || '_first'", "version": "'1'"})


def _register(spark, sf):
    return filters.save_rename(OLD_RENAMES.df(spark, sf), RENAMES.df(spark, sf))


REGISTER = f"""
    good AS (SELECT id, program_id, trim(old_name) AS old_name, trim(new_name) AS new_name, trim(version) AS version
             FROM ({RENAMES.sql}) WHERE trim(old_name) <> '' AND trim(new_name) <> ''),
    reg AS (SELECT * FROM ({OLD_RENAMES.sql}) WHERE id NOT IN (SELECT id FROM good) UNION ALL SELECT * FROM good)"""
QUERIES["rename_register"] = Query(_register, f"WITH {REGISTER} SELECT * FROM reg")
QUERIES["rename_apply"] = Query(
    lambda spark, sf: filters.apply_renames(PART_TABLES.df(spark, sf), _register(spark, sf)),
    f"""WITH {REGISTER}, last AS (SELECT program_id, lower(old_name) AS k, arg_max(new_name, id) AS new_name FROM reg GROUP BY ALL)
    SELECT p.program_id, COALESCE(new_name, table_name) AS table_name, column_name
    FROM ({PART_TABLES.sql}) p LEFT JOIN last ON last.program_id = p.program_id AND k = lower(table_name)""")
