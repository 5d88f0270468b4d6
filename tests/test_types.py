from pyspark.sql import functions as F

from keelson.functions import types as ty


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tables_are_complete():
    known = ty.TYPE_NAMES
    assert set(known) == set(ty.BACKENDS)
    assert all(set(row) == set(ty.CANONICAL) for row in ty.DDL_NAMES.values())
    assert len(ty.VOCABULARY) == 15


def test_resolve(spark):
    cases = [("MySQL", "varchar(20)", ty.TEXT), ("MySQL", "tinyint(1)", ty.INT32), ("SqlServer", "timestamp", ty.BYTES),
             ("Oracle", "DATE", ty.DATETIME), ("Oracle", "NUMBER(10,0)", ty.DECIMAL), ("SQLite", "int", ty.INT64),
             ("MariaDB", "year", ty.INT32), ("DBase", "uuid", ty.UNKNOWN), ("DB2", None, ty.UNKNOWN)]
    for backend, text, wanted in cases:
        assert one(spark, ty.resolve(backend, F.lit(text).cast("string"))) == wanted, (backend, text)
        assert one(spark, ty.resolve(F.lit(backend), F.lit(text).cast("string"))) == wanted, (backend, text)
    assert one(spark, ty.resolve_any(F.lit("INTEGER"))) == ty.INT32
    assert one(spark, ty.resolve_any(F.lit("DATE"))) == ty.DATETIME


def test_ddl(spark):
    assert one(spark, ty.ddl_type("Access", F.lit(ty.TEXT), 300)) == "LONGTEXT"
    assert one(spark, ty.ddl_type("Access", F.lit(ty.TEXT), 255)) == "VARCHAR(255)"
    assert one(spark, ty.ddl_type("Oracle", F.lit(ty.TEXT), 9000)) == "VARCHAR2(4000)"
    assert one(spark, ty.ddl_type(F.lit("DBase"), F.lit(ty.TEXT), 9000)) == "CHARACTER(254)"
    assert one(spark, ty.to_ddl("PostgreSQL", F.lit("AutoNumber"))) == "SERIAL"
    assert one(spark, ty.to_ddl("SqlServer", F.lit("  "))) == "NVARCHAR(MAX)"
    assert one(spark, ty.to_ddl("MariaDB", F.lit("adLong"))) == "INT"


def test_normalise(spark):
    for text, n, wanted in [("bigint", 0, "adLong"), ("varchar(20)", 20, "adWChar"), ("varchar(20)", 0, "adMemo"), ("  ", 0, "adVariant"),
                            ("INT IDENTITY(1,1)", 0, "AutoNumber"), ("adole", 0, "adole"), ("numeric(10,2)", 0, "adDecimal")]:
        assert one(spark, ty.normalise_type(F.lit(text), n)) == wanted, text


def test_codes_and_split(spark):
    assert one(spark, ty.code_to_canonical("firebird", F.lit(261), 1)) == ty.TEXT
    assert one(spark, ty.code_to_canonical("firebird", F.lit(261), 0)) == ty.BYTES
    assert one(spark, ty.code_to_canonical("oledb", F.lit(999))) == ty.TEXT
    base, size = ty.split_type(F.lit("numeric(10,2)"))
    assert (one(spark, base), one(spark, size)) == ("NUMERIC(10,2)", 0)
