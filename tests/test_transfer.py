from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keelson.functions import types as ty
from keelson.operators.filters import common_columns
from keelson.plans import transfer as job
from keelson.plans.transfer import Rules, Target
from keelson.sources.stores import CatalogStore, FileStore, JdbcStore


def test_common_columns_use_the_targets_spelling():
    assert common_columns(["A", "b", "C"], ["a", "B", "d"]) == [("A", "a"), ("b", "B")]


def test_rows_are_clean_repaired_or_rejected(spark):
    df = spark.createDataFrame([(1, "a", 5), (None, "b", None), (None, "too long", 5), (3, None, 5), (4, "d", 2**40)], "k int, t string, n bigint")
    targets = [Target("K", ty.INT32, True), Target("T", ty.TEXT, False, 3), Target("N", ty.INT32)]
    rows = {(r.K, r.T, r.N, r["_status"], tuple(r["_reasons"] or ())) for r in job.split_rows(df, targets).collect()}
    assert rows == {
        (1, "a", 5, "clean", ()), (0, "b", 0, "repaired", ()), (None, "too long", 5, "rejected", ("length:T",)),
        (3, None, 5, "clean", ()), (4, "d", None, "rejected", ("type:N",))}


def test_a_default_that_does_not_fit_rejects_the_row(spark):
    df = spark.createDataFrame([(None,)], "k string")
    row = job.split_rows(df, [Target("k", ty.INT32, True)]).first()
    assert (row["_status"], row["_reasons"]) == ("rejected", ["null:k"])


def test_every_row_is_accounted_for(spark):
    from workloads import moving

    rows = moving.split_lines(spark, "/root/testdata/sf0.001")
    total = moving.DIRTY.df(spark, "/root/testdata/sf0.001").count()
    assert job.accepted(rows).count() + job.rejected(rows).count() == total == rows.count()


def test_minus_one_becomes_true(spark):
    df = spark.createDataFrame([(-1,), (0,), (None,)], "f int")
    assert [r.f for r in job.split_rows(df, [Target("f", ty.BOOLEAN)]).collect()] == [True, False, None]


def test_legacy_clamp_is_optional(spark):
    df = spark.createDataFrame([(3000000000,)], "n bigint")
    targets = [Target("n", ty.INT64)]
    assert job.split_rows(df, targets).first().n == 3000000000
    assert job.split_rows(df, targets, Rules(legacy_int_clamp=True)).first().n == 2147483647


def test_conversions_are_not_repeated_by_the_filter(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("d"))
    plan = job.accepted(job.split_rows(df, [Target("d", ty.DATE, True)], Rules({"d": ty.DATE})))._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("regexp_replace" in line for line in filters)
    assert "Exchange" not in plan and "Python" not in plan


def test_transfer_over_files(spark, tmp_path):
    source, target, rejects = (FileStore(str(tmp_path / n)) for n in ("source", "target", "rejects"))
    spark.createDataFrame([(1, "a"), (None, "b"), (3, "cccc")], "ID int, t string").write.parquet(f"{source.path}/one")
    spark.range(3).write.parquet(f"{source.path}/two")
    spark.createDataFrame([("old", 9)], "t string, id int").write.parquet(f"{target.path}/one")
    rules = {"one": Rules(targets=[Target("t", ty.TEXT, False, 2), Target("id", ty.INT32, True)]), "two": Rules(targets=[Target("x", ty.INT32)])}
    report = {r.table_name: r for r in job.transfer(spark, source, target, ["one", "two", "gone"], rules, rejects).collect()}
    assert (report["one"].status, report["one"].rows_read, report["one"].rows_repaired, report["one"].rows_rejected) == ("ok", 3, 1, 1)
    assert report["one"].error.startswith("1 row(s) rejected")
    assert report["two"].status == "skipped" and report["gone"].status == "failed"
    assert sorted((r.id, r.t) for r in target.read(spark, "one").collect()) == [(0, "b"), (1, "a")]
    assert [r.first_reason for r in rejects.read(spark, "one").collect()] == ["length:t"]
    assert target.tables(spark) == ["one"]
    job.transfer(spark, source, target, ["one"], rules, append=True)
    assert target.read(spark, "one").count() == 4


def test_a_failed_refresh_keeps_the_old_rows(spark, tmp_path):
    target = FileStore(str(tmp_path))
    target.replace(spark.range(3), "t")
    bad = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):
        target.replace(bad, "t")
    assert target.read(spark, "t").count() == 3


def test_spark_catalog_store(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS moved")
    spark.sql("CREATE TABLE moved.t (a INT, b STRING, c DECIMAL(10,2)) USING parquet")
    store = CatalogStore("moved")
    store.replace(spark.createDataFrame([(1, Decimal("2.50"))], "A int, C decimal(10,2)"), "t")
    store.append(spark.createDataFrame([(2, "x", Decimal("1.00"))], "a int, b string, c decimal(10,2)"), "t")
    assert sorted((r.a, r.b) for r in store.read(spark, "t", ["a", "b"]).collect()) == [(1, None), (2, "x")]
    assert store.tables(spark) == ["t"]
    spark.sql("DROP DATABASE moved CASCADE")


def test_jdbc_settings_split_large_reads():
    store = JdbcStore("Oracle", "jdbc:oracle:thin:@//h/x", {"user": "u"}, {"orders": ("ID", 1, 1000, 8)})
    options = store.read_options("orders")
    assert options["dbtable"] == '"ORDERS"' and options["numPartitions"] == "8" and options["user"] == "u"
    assert "partitionColumn" not in store.read_options("other")
    assert JdbcStore("SqlServer", "jdbc:x").quoted("a]b") == "[a]]b]"
    assert JdbcStore("MySQL", "jdbc:x").write_options("t")["batchsize"] == "10000"


def test_conversions_run_on_a_stream(spark, tmp_path):
    from keelson.functions.convert import canonicalise

    source = str(tmp_path / "in")
    spark.createDataFrame([("15.01.2023", "(5)")], "d string, n string").write.parquet(source)
    stream = spark.readStream.schema("d string, n string").parquet(source)
    out = canonicalise(stream, {"d": ty.DATE, "n": ty.INT32})
    query = out.writeStream.format("memory").queryName("converted").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    row = spark.table("converted").first()
    assert (str(row.d), row.n) == ("2023-01-15", -5)
