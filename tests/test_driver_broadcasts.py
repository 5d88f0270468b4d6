"""Whole catalogs are never gathered on the driver: their files are small, their rows and the repeats of them are not."""

import re

import pytest

from workloads import registry

#: Queries whose plans hold no side that grows with the catalog in a broadcast.
QUERIES = ["declared_schema", "tsv_orphans", "column_guard", "catalog_columns", "catalog_types", "fleet_missing_fks", "fleet_summary", "fk_applicability", "fleet_diff_all", "apply_order", "fleet_summary_with_drops"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    kinds = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]
    rows = [(k, f"{'red' if k % 3 else 'hot'} bolt", f"Brand#{k % 25 + 1}", kinds[k % 6], k % 50 + 1, 9.5) for k in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
                          ).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def broadcast(plan: str) -> list[str]:
    """What is broadcast in a plan, down to the next shuffle or join."""
    lines, found = plan.splitlines(), []
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((k for k in range(at + 1, len(lines)) if re.search(r"Exchange|Join", lines[k])), len(lines))
            found.append("\n".join(lines[at:end]))
    return found


@pytest.mark.parametrize("name", QUERIES)
def test_no_repeated_side_is_broadcast(spark, tables, name):
    plan = registry.QUERIES[name].run(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert not [side for side in broadcast(plan) if "Generate explode" in side]


def test_salted_join_shuffles_both_sides(spark):
    from pyspark.sql import functions as F

    from keelson.operators.scale import salted_join

    few = spark.range(10).withColumnRenamed("id", "k")
    plan = salted_join(spark.range(50).withColumn("k", F.col("id") % 10), few, ["k"], "inner", F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
