"""Checks after a migration, and the load order of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import checks
from keelson.plans.load_order import load_order
from keelson.plans.post_check import TableChecks, post_check
from workloads.base import Query, Recipe, div, table

QUERIES: dict[str, Query] = {}

PARENTS = Recipe("customer", {"c_custkey": "CASE WHEN c_custkey % 97 = 0 THEN -c_custkey ELSE c_custkey END", "c_name": "c_name"})
CHILDREN = Recipe("orders", {
    "o_orderkey": "o_orderkey", "o_custkey": "CASE WHEN o_orderkey % 10 < 3 THEN 97 WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END",
    "o_orderpriority": "o_orderpriority"})

QUERIES["pk_duplicates"] = Query(
    lambda spark, sf: checks.check_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
QUERIES["fk_orphans"] = Query(
    lambda spark, sf: checks.check_orphans(CHILDREN.df(spark, sf), "o_custkey", PARENTS.df(spark, sf), "c_custkey"),
    f"""SELECT o_custkey AS key, count(*) AS n_rows FROM ({CHILDREN.sql})
    WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM ({PARENTS.sql})) GROUP BY o_custkey""")
QUERIES["fk_orphan_rows"] = Query(
    lambda spark, sf: checks.orphan_rows(CHILDREN.df(spark, sf), "o_custkey", PARENTS.df(spark, sf), "c_custkey", F.col("o_orderkey")),
    f"""SELECT * FROM ({CHILDREN.sql}) WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM ({PARENTS.sql}))""")
QUERIES["not_null_profile"] = Query(
    lambda spark, sf: checks.check_columns(CHILDREN.df(spark, sf), ["o_orderkey", "o_custkey"], {"o_orderpriority": 8, "o_orderkey": 4}),
    f"""WITH x AS ({CHILDREN.sql})
    SELECT 'o_orderkey' AS column_name, 'not_null' AS rule, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_rows FROM x
    UNION ALL SELECT 'o_custkey', 'not_null', count(*) FILTER (WHERE o_custkey IS NULL) FROM x
    UNION ALL SELECT 'o_orderpriority', 'max_length', count(*) FILTER (WHERE length(o_orderpriority) > 8) FROM x
    UNION ALL SELECT 'o_orderkey', 'max_length', count(*) FILTER (WHERE length(CAST(o_orderkey AS VARCHAR)) > 4) FROM x""")

COUNTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _sides(spark, sf):
    source = {name: table(spark, sf, name) for name in COUNTED}
    target = {**{name: source[name] for name in COUNTED[:6]}, "customer": table(spark, sf, "supplier"), "labels": table(spark, sf, "labels")}
    return source, target


SIDES = ("s(table_name, source_rows) AS (" + " UNION ALL ".join(f"SELECT '{n}', count(*) FROM {n}" for n in COUNTED) + "), "
         "t(table_name, target_rows) AS (" + " UNION ALL ".join(
             f"SELECT '{n}', count(*) FROM {'supplier' if n == 'customer' else n}"
             for n in [*COUNTED[:6], "labels"]) + ")")
QUERIES["rowcount_reconcile"] = Query(
    lambda spark, sf: checks.reconcile_counts(*_sides(spark, sf)),
    f"""WITH {SIDES} SELECT table_name, source_rows, target_rows, source_rows IS NOT DISTINCT FROM target_rows AS matches
    FROM s FULL JOIN t USING (table_name)""")


def _reseed(spark, sf):
    return checks.reseed_values({
        "orders": (table(spark, sf, "orders"), ["o_orderkey", "o_custkey"]),
        "lineitem": (table(spark, sf, "lineitem"), ["l_linenumber"]),
        "customer": (PARENTS.df(spark, sf), ["c_custkey"])})


QUERIES["reseed_values"] = Query(_reseed, """
    SELECT 'orders' AS table_name, 'o_orderkey' AS column_name, max(o_orderkey) + 1 AS next_value FROM orders
    UNION ALL SELECT 'orders', 'o_custkey', max(o_custkey) + 1 FROM orders
    UNION ALL SELECT 'lineitem', 'l_linenumber', CAST(max(l_linenumber) AS BIGINT) + 1 FROM lineitem
    UNION ALL SELECT 'customer', 'c_custkey', max(c_custkey) + 1 FROM ({})""".format(PARENTS.sql))

RULES = {
    "orders": TableChecks(keys=["o_orderkey"], not_null=["o_custkey"], max_length={"o_orderpriority": 8},
                          foreign_keys=[("o_custkey", "customer", "c_custkey")], identity=["o_orderkey"]),
    "lineitem": TableChecks(keys=["l_orderkey", "l_linenumber"], foreign_keys=[("l_orderkey", "orders", "o_orderkey"),
                                                                            ("l_partkey", "part", "p_partkey")]),
}


def _post(spark, sf):
    source = {n: table(spark, sf, n) for n in ("orders", "lineitem", "customer", "part")}
    target = {**source, "orders": CHILDREN.df(spark, sf), "customer": PARENTS.df(spark, sf)}
    return post_check(source, target, RULES)


QUERIES["post_check"] = Query(_post, f"""
    WITH o AS ({CHILDREN.sql}), c AS ({PARENTS.sql})
    SELECT 'orders' AS table_name, 'row_difference' AS "check", '' AS column_name, (SELECT count(*) FROM o) - (SELECT count(*) FROM orders) AS value
    UNION ALL SELECT 'customer', 'row_difference', '', (SELECT count(*) FROM c) - (SELECT count(*) FROM customer)
    UNION ALL SELECT 'lineitem', 'row_difference', '', 0
    UNION ALL SELECT 'part', 'row_difference', '', 0
    UNION ALL SELECT 'orders', 'duplicate_keys', 'o_orderkey', (SELECT count(*) FROM (SELECT o_orderkey FROM o GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'orders', 'not_null', 'o_custkey', (SELECT count(*) FROM o WHERE o_custkey IS NULL)
    UNION ALL SELECT 'orders', 'max_length', 'o_orderpriority', (SELECT count(*) FROM o WHERE length(o_orderpriority) > 8)
    UNION ALL SELECT 'orders', 'orphan_rows', 'o_custkey', (SELECT count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c))
    UNION ALL SELECT 'orders', 'next_identity', 'o_orderkey', (SELECT max(o_orderkey) + 1 FROM o)
    UNION ALL SELECT 'lineitem', 'duplicate_keys', 'l_orderkey,l_linenumber',
        (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
    UNION ALL SELECT 'lineitem', 'orphan_rows', 'l_orderkey', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o))
    UNION ALL SELECT 'lineitem', 'orphan_rows', 'l_partkey', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))""")

# ---- load order: each part is a table of two databases, below part / 2 and part / 5; in the second some pairs refer to each other ----

NAME = "'t' || CAST({} AS STRING)"
KEYS = [
    Recipe("part", {"db": "'halves'", "child_table": NAME.format("p_partkey"), "parent_table": NAME.format(div("p_partkey", 2))}),
    Recipe("part", {"db": "'fifths'", "child_table": NAME.format("p_partkey"), "parent_table": NAME.format(div("p_partkey", 5))}),
    Recipe("part", {"db": "'fifths'", "child_table": NAME.format("p_partkey"), "parent_table": NAME.format("CASE WHEN p_partkey % 300 = 77 THEN p_partkey + 1 ELSE p_partkey END")}),
    Recipe("part", {"db": "'fifths'", "child_table": NAME.format("p_partkey"), "parent_table": NAME.format("CASE WHEN p_partkey % 300 = 78 THEN p_partkey - 1 ELSE p_partkey END")}),
]


def _load_order(spark, sf):
    keys = KEYS[0].df(spark, sf)
    for more in KEYS[1:]:
        keys = keys.unionByName(more.df(spark, sf))
    tables = keys.select("db", F.col("child_table").alias("table_name")).distinct()
    return load_order(tables, keys, ["db"])


QUERIES["load_order"] = Query(_load_order, f"""
    WITH RECURSIVE k AS ({' UNION ALL '.join(r.sql for r in KEYS)}),
    e AS (SELECT DISTINCT * FROM k WHERE child_table <> parent_table),
    n AS (SELECT db, child_table AS t FROM k UNION SELECT db, parent_table FROM k),
    looped AS (SELECT DISTINCT a.db, a.child_table AS t FROM e a JOIN e b ON a.db = b.db AND a.child_table = b.parent_table AND a.parent_table = b.child_table),
    behind AS (SELECT db, t FROM looped UNION SELECT e.db, e.child_table FROM behind JOIN e ON e.db = behind.db AND e.parent_table = behind.t),
    walk AS (SELECT db, t, 0 AS level FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.db = n.db AND e.child_table = n.t)
             UNION ALL SELECT e.db, e.child_table, level + 1 FROM walk JOIN e ON e.db = walk.db AND e.parent_table = walk.t
             WHERE NOT EXISTS (SELECT 1 FROM behind b WHERE b.db = e.db AND b.t = e.child_table)),
    deepest AS (SELECT db, t, max(level) AS level FROM walk GROUP BY db, t)
    SELECT n.db, n.t AS table_name, CAST(level AS INTEGER) AS level, CASE WHEN level IS NULL THEN 'cycle' END AS reason
    FROM n LEFT JOIN deepest USING (db, t)""")
