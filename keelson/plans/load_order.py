"""Load order: parents before children, for the foreign keys of any number of databases."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.scale import cut_lineage

# Levels held as separate frames before they are written together.
KEPT_APART = 32


def load_order(tables: DataFrame, fks: DataFrame, scope: list[str]) -> DataFrame:
    """Level of each table: 0 without parents, else one more than its highest parent.

    ``tables`` holds the scope columns and table_name, ``fks`` the scope, child_table and
    parent_table. Names match without case and come back as ``tables`` spells them.
    References of a table to itself are ignored. Tables on a cycle, or behind one, have
    no level and the reason ``cycle``.

    Each round settles the tables whose parents are all settled and lowers the number
    of open parents of their children, so every key is followed exactly once; rounds end
    when one settles nothing. Only open tables stay in the loop.
    """
    node = [*scope, "_key"]
    edges = fks.select(*scope, F.lower("child_table").alias("_child"), F.lower("parent_table").alias("_parent"),
                       F.col("child_table"), F.col("parent_table"))
    spelt = tables.select(*scope, F.lit(0).alias("_rank"), "table_name").unionByName(
        edges.select(*scope, F.lit(1).alias("_rank"), F.explode(F.array("child_table", "parent_table")).alias("table_name")))
    named = spelt.groupBy(*scope, F.lower("table_name").alias("_key")).agg(F.min(F.struct("_rank", "table_name")).alias("_name")).select(
        *node, F.col("_name.table_name").alias("table_name"))
    edges = cut_lineage(edges.filter("_child <> _parent").select(*scope, "_child", "_parent").distinct())
    open_parents = edges.groupBy(*scope, F.col("_child").alias("_key")).agg(F.count(F.lit(1)).alias("_open"))
    state = cut_lineage(named.join(open_parents, node, "left").select(
        *node, "table_name", F.coalesce("_open", F.lit(0).cast("bigint")).alias("_open")))
    levels: list[DataFrame] = []
    for level in count():
        settled = state.filter(F.col("_open") == 0)
        if settled.isEmpty():
            break
        levels.append(settled.select(*scope, "table_name", F.lit(level).alias("level")))
        if len(levels) == KEPT_APART:
            levels = [cut_lineage(reduce(DataFrame.unionByName, levels))]
        closed = edges.join(
            settled.select(*scope, F.col("_key").alias("_parent")), [*scope, "_parent"], "left_semi"
        ).groupBy(*scope, F.col("_child").alias("_key")).agg(F.count(F.lit(1)).alias("_closed"))
        state = cut_lineage(state.filter(F.col("_open") > 0).join(closed, node, "left").select(
            *node, "table_name", (F.col("_open") - F.coalesce("_closed", F.lit(0))).alias("_open")))
    rest = state.filter(F.col("_open") > 0).select(*scope, "table_name", F.lit(None).cast("int").alias("level"))
    return reduce(DataFrame.unionByName, [*levels, rest]).withColumn(
        "reason", F.when(F.col("level").isNull(), F.lit("cycle")))
