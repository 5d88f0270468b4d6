"""dBase files and metadata dumps on disk."""

import struct
from decimal import Decimal

from pyspark.sql import functions as F

from keelson.sources import dbf, dump


def test_file_layout(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("šđ x", 5, Decimal("1.25"), True), (None, None, None, None)],
                               "name string, n int, amount decimal(8,2), flag boolean").coalesce(1)
    dbf.write_dbf(df, path)
    files = list((tmp_path / "t").glob("*.dbf"))
    raw = files[0].read_bytes()
    rows, header, width = struct.unpack_from("<IHH", raw, 4)
    assert (len(files), rows, header) == (1, 2, 32 + 4 * 32 + 1)
    assert len(raw) == header + rows * width + 1 and raw[-1] == 0x1A and raw[header] == 0x20
    assert raw[header + 1: header + 5] == "šđ x".encode("cp1250")
    back = dbf.read_dbf(spark, path).orderBy(F.col("n").asc_nulls_last()).collect()
    assert tuple(back[0]) == ("šđ x", 5, Decimal("1.25"), True)
    assert tuple(back[1]) == ("", None, None, False)


def test_large_files_are_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "t")
    dbf.write_dbf(spark.range(1000).select(F.col("id").cast("int").alias("id")).coalesce(1), path)
    dbf.register(spark)
    df = spark.read.format("dbf").option("rowsPerRange", 100).load(path)
    assert df.rdd.getNumPartitions() == 10
    assert df.agg(F.sum("id"), F.count("*")).first()[:] == (499500, 1000)


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.range(3).select(F.col("id").cast("int").alias("id"))
    dbf.write_dbf(one, path)
    dbf.write_dbf(one, path, mode="append")
    assert dbf.read_dbf(spark, path).count() == 6
    dbf.write_dbf(one, path)
    assert dbf.read_dbf(spark, path).count() == 3
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_temporary")]


def test_names_are_shortened_and_found_again():
    names = ["customer_name", "customer_number", "id"]
    assert dbf.short_names(names) == {"customer_name": "customer_n", "customer_number": "customer_2", "id": "id"}
    assert dbf.match_truncated("CUSTOMER_N", names) == "customer_name"
    assert dbf.match_truncated("nothing", names) is None


def test_dump_folder(spark, tmp_path):
    (tmp_path / "Programi.txt").write_text("id\tname\tversion\n1\t Prog \t1.0 \n\nx\tbad\n2\t\"quoted\n3\n", encoding="utf-8")
    (tmp_path / "Tabele.txt").write_text("id\tprogram\tname\n10\t1\tT1\n11\n12\t9\tT2\tv\n", encoding="utf-8")
    (tmp_path / "Kolone.txt").write_text("h\n100\t10\tc1\t\t\t \tYes\t\tTRUE\n101\t10\tc2\tadLong\td\t20\tNo\ti\n102\tz\tc\n", encoding="utf-8")
    programs, tables, columns = dump.read_dump(spark, str(tmp_path))
    assert sorted(tuple(r) for r in programs.collect()) == [(1, "Prog", "1.0"), (2, '"quoted', None), (3, "", None)]
    assert sorted((tuple(r) for r in tables.collect())) == [(10, 1, "T1", None), (12, 9, "T2", "v")]
    assert sorted(tuple(r) for r in columns.collect()) == [
        (100, 10, "c1", "adVariant", None, None, "YES", None, True), (101, 10, "c2", "adLong", "d", "20", "No", "i", False)]




def test_dbase_rows_that_do_not_fit_come_back(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("short", 12.5, 5, "1.5"), ("much too long", 1.0, 5, "1"), ("\u2192", 2.0, 5, "1"), ("a", 0.123456, 5, "1"), ("b", 1.0, 12345, "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, ratio double, n int, amount string")
    fields = [dbf.Field("name", "C", 6), dbf.Field("ratio", "F", 10, 2), dbf.Field("n", "N", 3), dbf.Field("amount", "N", 8, 1)]
    unfit = {r["name"]: r["reasons"] for r in dbf.write_dbf(df, path, fields).collect()}
    assert unfit == {"much too long": ["length:name"], "\u2192": ["charset:name"], "a": ["scale:ratio"], "b": ["overflow:n", "type:amount"]}
    back = sorted(map(tuple, dbf.read_dbf(spark, path).collect()), key=str)
    assert back == [("", None, None, None), ("short", 12.5, 5, Decimal("1.5"))]


def test_dbase_folder_without_rows_keeps_its_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    dbf.write_dbf(spark.createDataFrame([], "a int, b string"), path)
    back = dbf.read_dbf(spark, path)
    assert back.columns == ["a", "b"] and back.count() == 0
    (tmp_path / "none").mkdir()
    assert dbf.read_dbf(spark, str(tmp_path / "none")).count() == 0


def test_dbase_cells_that_are_no_numbers_read_as_null(spark, tmp_path):
    fields = [dbf.Field("n", "N", 6), dbf.Field("d", "N", 6, 2), dbf.Field("f", "F", 8, 2), dbf.Field("t", "C", 3)]
    cells = [("  12  ", "  1.50", "  1.5e1 ", "\xe9 x"), ("******", "abc   ", "********", "   "), ("  7.00", "   .5 ", "  -2.25 ", "y\0\0")]
    body = b"".join(b" " + "".join(c).encode("latin-1") for c in cells)
    (tmp_path / "t.dbf").write_bytes(dbf.build_header(fields, 3) + body + dbf.FILE_END)
    back = [tuple(r) for r in dbf.read_dbf(spark, str(tmp_path / "t.dbf")).collect()]
    assert back == [(12, Decimal("1.50"), 15.0, "\xe9 x"), (None, None, None, ""), (7, Decimal("0.50"), -2.25, "y")]
