"""Operation log, derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import oplog
from keelson.operators.scale import new_folder
from workloads.base import Query, Recipe, case_of

QUERIES: dict[str, Query] = {}

LOG = Recipe("events", {
    "id": "event_id", "ts": "ts", "level": "upper(event_type)",
    "category": case_of("user_id % 4", ["'Transfer'", "'Import'", "''", None]),
    "message": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END",
    "details": "CASE WHEN event_id % 5 = 0 THEN 'user ' || CAST(user_id AS STRING) || repeat(' more', 120) WHEN event_id % 5 = 1 THEN ' ' END",
    "sql": "CASE WHEN event_id % 7 = 0 THEN 'DROP TABLE t' || CAST(user_id AS STRING) END",
    "backend": case_of("event_id % 3", ["'SQLite'", "'MySQL'", None]),
})
HIT = ("(COALESCE(message, '') ILIKE '%4%' OR COALESCE(details, '') ILIKE '%4%' OR COALESCE(sql, '') ILIKE '%4%' OR COALESCE(backend, '') ILIKE '%4%')")


def _plain(df):
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
QUERIES["log_filter"] = Query(
    lambda spark, sf: _plain(oplog.log_search(LOG.df(spark, sf), "ERROR", "Transfer", " 4 ")),
    f"SELECT * REPLACE ({STAMP} AS ts) FROM ({LOG.sql}) WHERE level = 'ERROR' AND category = 'Transfer' AND {HIT}")
QUERIES["log_search_text"] = Query(
    lambda spark, sf: _plain(oplog.log_search(LOG.df(spark, sf), "All", "All", "drop TABLE")),
    f"SELECT * REPLACE ({STAMP} AS ts) FROM ({LOG.sql}) WHERE sql ILIKE '%drop table%'")
QUERIES["log_categories"] = Query(
    lambda spark, sf: oplog.log_categories(LOG.df(spark, sf)), f"SELECT DISTINCT COALESCE(category, '') AS category FROM ({LOG.sql})")
QUERIES["log_latest"] = Query(
    lambda spark, sf: _plain(oplog.latest(LOG.df(spark, sf))),
    f"SELECT * REPLACE ({STAMP} AS ts) FROM ({LOG.sql}) ORDER BY ({LOG.columns['ts']}) DESC, id DESC LIMIT 1".replace("(ts) DESC", "ts DESC"))
QUERIES["log_summary"] = Query(
    lambda spark, sf: oplog.log_summary(LOG.df(spark, sf), "ERROR", None, "4").withColumn("last_entry", F.date_format("last_entry", "yyyy-MM-dd HH:mm:ss")),
    f"""SELECT count(*) FILTER (WHERE level = 'ERROR' AND {HIT}) AS n_found, count(*) AS n_total,
        strftime(max(ts) FILTER (WHERE level = 'ERROR' AND {HIT}), '%Y-%m-%d %H:%M:%S') AS last_entry FROM ({LOG.sql})""")
QUERIES["log_render"] = Query(
    lambda spark, sf: oplog.log_lines(LOG.df(spark, sf)),
    f"""SELECT id, {STAMP} || ' | ' || level || ' | ' || COALESCE(category, '') || ' | ' || COALESCE(message, '')
        || CASE WHEN trim(COALESCE(details, '')) = '' THEN '' ELSE chr(10) || '  Details: ' || details END
        || CASE WHEN trim(COALESCE(sql, '')) = '' THEN '' ELSE chr(10) || '  SQL: ' || sql END AS line FROM ({LOG.sql})""")


def _append(spark, sf):
    path = new_folder(spark, "log")
    log = LOG.df(spark, sf)
    oplog.append_log(log.filter("level <> 'ERROR'"), path)
    oplog.append_log(log.filter("level = 'ERROR'"), path)
    return _plain(spark.read.parquet(path))


QUERIES["log_append"] = Query(_append, f"""
    SELECT * REPLACE ({STAMP} AS ts, left(message, 255) AS message, left(details, 500) AS details, left(sql, 500) AS sql, left(backend, 255) AS backend)
    FROM ({LOG.sql})""")
