"""Refreshes, appends, deep chains and wide ids."""

from keelson.operators.scale import salt_count
from keelson.plans.load_order import load_order
from keelson.sources.dump import parse_programs
from keelson.sources.stores import CatalogStore, FileStore


def test_refresh_keeps_place_and_columns(spark, tmp_path):
    store = FileStore(str(tmp_path))
    for place in ("t.parquet", "u"):
        spark.range(2).selectExpr("id AS k", "'x' AS extra").write.parquet(str(tmp_path / place))
    for table in ("t", "u"):
        store.replace(spark.range(5).selectExpr("id AS K"), table)
        assert sorted(map(tuple, store.read(spark, table).collect())) == [(k, None) for k in range(5)]
        store.append(spark.range(7, 8).selectExpr("id AS k"), table)
        assert store.read(spark, table).count() == 6
    assert store.tables(spark) == ["t", "u"]


def test_append_to_a_single_file(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"k": [1], "extra": ["x"]}), tmp_path / "t.parquet")
    store = FileStore(str(tmp_path))
    store.append(spark.range(2, 3).selectExpr("id AS k"), "t")
    assert sorted(map(tuple, store.read(spark, "t").collect())) == [(1, "x"), (2, None)]


def test_append_to_a_wider_catalog_table(spark):
    spark.range(1).selectExpr("id AS k", "1 AS extra").write.mode("overwrite").saveAsTable("wider")
    CatalogStore().append(spark.range(1, 2).selectExpr("id AS k"), "wider")
    assert sorted(map(tuple, spark.table("wider").collect())) == [(0, 1), (1, None)]
    spark.sql("DROP TABLE wider")


def test_load_order_loses_no_level_and_no_case(spark):
    tables = spark.createDataFrame([("d", n) for n in ("A", "B", "C", *[f"t{i}" for i in range(40)])], "db string, table_name string")
    keys = [("d", "B", "a"), ("d", "b", "c")] + [("d", f"T{i}", f"t{i - 1}") for i in range(1, 40)]
    found = {r.table_name: (r.level, r.reason) for r in load_order(tables, spark.createDataFrame(
        keys, "db string, child_table string, parent_table string"), ["db"]).collect()}
    assert found == {"A": (0, None), "B": (1, None), "C": (0, None), **{f"t{i}": (i, None) for i in range(40)}}


def test_wide_ids_stay(spark):
    lines = spark.createDataFrame([("9000000000\tname\t1",)], "value string")
    assert [r.id for r in parse_programs(lines).collect()] == [9_000_000_000]


def test_salts_follow_the_cluster(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8000")
    assert salt_count(spark) == 1000
    spark.conf.set("spark.sql.shuffle.partitions", before)
