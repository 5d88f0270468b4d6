"""Databases of several brands share a program: each lacks what the program declares for the others."""

import pytest

from workloads import drift, scripts


@pytest.fixture(scope="module")
def two_brands(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("two_brands"))
    rows = [(1, "red one", "Brand#11", "PROMO", 8), (2, "blue two", "Brand#21", "PROMO", 8), (3, "grey three", "Brand#12", "PROMO", 8)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return folder


def test_missing_columns_of_all_brands_of_a_program(spark, two_brands):
    rows = drift.QUERIES["fleet_missing_columns"].run(spark, two_brands).collect()
    assert {(r.db, r.program_id, r.column_name) for r in rows} == {("brand#11_0", 2, "blue_two"), ("brand#21_0", 2, "red_one")}
    assert len(rows) == 2


def test_statements_for_all_brands_of_a_program(spark, two_brands):
    rows = scripts.QUERIES["ddl_add_fleet"].run(spark, two_brands).collect()
    assert {(r.db, r.table_name, r.column_name) for r in rows} == {("brand#11_0", "PROMO_0", "blue_two"), ("brand#21_0", "PROMO_0", "red_one")}
