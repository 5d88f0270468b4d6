"""One scan, staged commits, keys, first errors and decimals of the transfer job."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions import convert
from keelson.functions import types as ty
from keelson.plans import transfer as job
from keelson.plans.transfer import Rules, Target
from keelson.sources.stores import FileStore


class Failing(FileStore):
    def stage(self, df, table):
        raise OSError("no room")


@pytest.fixture
def stores(tmp_path):
    return [FileStore(str(tmp_path / n)) for n in ("source", "target", "rejects")]


def test_a_failed_reject_write_leaves_the_old_target(spark, stores):
    source, target, rejects = stores
    spark.createDataFrame([(1, "long text"), (2, "b")], "k int, t string").write.parquet(f"{source.path}/a")
    spark.createDataFrame([(9, "old")], "k int, t string").write.parquet(f"{target.path}/a")
    rules = {"a": Rules(targets=[Target("k", ty.INT32), Target("t", ty.TEXT, False, 3)])}
    report = job.transfer(spark, source, target, ["a"], rules, Failing(rejects.path)).first()
    assert report["status"] == "failed" and "no room" in report["error"]
    assert [tuple(r) for r in target.read(spark, "a").collect()] == [(9, "old")]
    report = job.transfer(spark, source, Failing(target.path), ["a"], rules, rejects).first()
    assert report["status"] == "failed" and rejects.path and target.read(spark, "a").count() == 1
    assert job.transfer(spark, source, target, ["a"], rules, rejects).first()["rows_rejected"] == 1
    assert target.read(spark, "a").count() == rejects.read(spark, "a").count() == 1


def test_rejects_of_an_earlier_run_go(spark, stores):
    source, target, rejects = stores
    spark.createDataFrame([("long text",)], "t string").write.parquet(f"{source.path}/a")
    for width, left in ((3, 1), (30, 0)):
        job.transfer(spark, source, target, ["a"], {"a": Rules(targets=[Target("t", ty.TEXT, False, width)])}, rejects)
        assert rejects.read(spark, "a").count() == left and target.read(spark, "a").count() == 1 - left


def test_the_first_row_of_a_hot_key_stays(spark, stores):
    source, target, rejects = stores
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.9 else rng.randrange(300) if rng.random() < 0.9 else None, i) for i in range(20000)]
    spark.createDataFrame(rows, "k int, n int").coalesce(1).write.option("parquet.block.size", 20000).parquet(f"{source.path}/a")
    rules = {"a": Rules(targets=[Target("K", ty.INT32), Target("n", ty.INT32)], keys=("K",))}
    report = job.transfer(spark, source, target, ["a"], rules, rejects).first()
    first = {}
    for k, n in rows:
        if k is not None:
            first.setdefault(k, n)
    want = sorted([(k, n) for k, n in first.items()] + [(None, n) for k, n in rows if k is None], key=str)
    assert sorted(((r.K, r.n) for r in target.read(spark, "a").collect()), key=str) == want
    assert report["rows_rejected"] == len(rows) - len(want) == rejects.read(spark, "a").count()
    assert report["rows_clean"] == len(want) and report["error"].endswith("duplicate:K")


def test_many_repeated_keys_are_joined_by_shuffle(spark, stores, monkeypatch):
    source, target, _ = stores
    spark.range(600).select((F.col("id") % 200).alias("k"), "id").coalesce(1).write.parquet(f"{source.path}/a")
    monkeypatch.setattr(job, "FEW_KEYS", 0)
    job.transfer(spark, source, target, ["a"], {"a": Rules(targets=[Target("k", ty.INT64), Target("id", ty.INT64)], keys=("k",))})
    assert sorted(tuple(r) for r in target.read(spark, "a").collect()) == [(i, i) for i in range(200)]


def test_keys_of_the_target_count_on_append(spark, stores):
    source, target, rejects = stores
    spark.createDataFrame([(1, "new"), (2, "new"), (2, "again"), (3, "new")], "k int, t string").coalesce(1).write.parquet(f"{source.path}/a")
    spark.createDataFrame([(1, "old"), (1, "old")], "k int, t string").write.parquet(f"{target.path}/a")
    rules = {"a": Rules(targets=[Target("k", ty.INT32), Target("t", ty.TEXT)], keys=("k",))}
    job.transfer(spark, source, target, ["a"], rules, rejects, append=True)
    assert sorted(tuple(r) for r in target.read(spark, "a").collect()) == [(1, "old"), (1, "old"), (2, "new"), (3, "new")]
    assert sorted((r.k, r.t) for r in rejects.read(spark, "a").collect()) == [(1, "new"), (2, "again")]


def test_the_first_error_is_the_first_rows(spark, stores):
    source, target, rejects = stores
    rows = [(str(i), "zz" if i == 40 else "aa" if i % 2 else "ok") for i in range(4000)]
    bad = {"zz": "length:t", "aa": "type:n"}
    frame = spark.createDataFrame([(t if t == "zz" else "z", 2**40 if t == "aa" else 1) for _, t in rows], "t string, n bigint")
    frame.coalesce(1).write.option("parquet.block.size", 1000).parquet(f"{source.path}/a")
    rules = {"a": Rules(targets=[Target("t", ty.TEXT, False, 1), Target("n", ty.INT32)])}
    report = job.transfer(spark, source, target, ["a"], rules, rejects).first()
    assert report["error"].endswith(bad[next(t for _, t in rows if t in bad)])


def test_the_source_is_scanned_once(spark, stores):
    source, target, rejects = stores
    spark.createDataFrame([(1, "x"), (None, "long")], "k int, t string").write.parquet(f"{source.path}/a")
    reads = []
    placed = FileStore.placed

    class Counting(FileStore):
        def placed(self, spark, table, columns):
            df = placed(self, spark, table, columns)
            seen = spark.sparkContext.accumulator(0)
            reads.append(seen)
            return df.filter(F.udf(lambda _: bool(seen.add(1)) or True, "boolean")(F.col("t")))

    rules = {"a": Rules(targets=[Target("k", ty.INT32), Target("t", ty.TEXT, False, 2)], keys=("k",))}
    job.transfer(spark, Counting(source.path), target, ["a"], rules, rejects)
    assert [r.value for r in reads] == [2]


def test_missing_required_columns_reject_rows(spark):
    df = spark.createDataFrame([(1,)], "k int")
    targets = [Target("k", ty.INT32), Target("need", ty.TEXT, True), Target("own", ty.INT64, True, filled=True), Target("free", ty.TEXT)]
    row = job.split_rows(df, targets).first()
    assert (row["_status"], row["_reasons"]) == ("rejected", ["missing:need"])


NUMBERS = ["0", "0.000", "12", "-1,234.5600", "1e-12", "12.5E3", "5.0e-3", "(7.25)", "0.123456789012345678", "1234567890123456789.5", "x", None, ""]


def places(text):
    try:
        number = Decimal(text.replace(",", "").strip("()")).normalize()
    except Exception:  # noqa: BLE001 - no number
        return None
    whole = len(str(abs(int(number)))) if abs(number) >= 1 else 0
    return whole, max(-number.as_tuple().exponent, 0)


def test_digits_of_numbers(spark):
    df = spark.createDataFrame([(t,) for t in NUMBERS], "t string").select("t", convert.digit_counts(F.col("t"), T.StringType()).alias("d"))
    for r in df.collect():
        want = places(r["t"]) if r["t"] else None
        assert (tuple(r["d"]) if r["d"] else None) == want, r["t"]


def test_decimals_keep_every_place_or_reject(spark, stores):
    source, target, rejects = stores
    spark.createDataFrame([(t, Decimal("1.123456789012345678"), 0.1, 0.1 + 0.2) for t in NUMBERS], "t string, d decimal(38,18), f float, x double").write.parquet(f"{source.path}/a")
    kinds = {"t": ty.DECIMAL, "d": ty.DECIMAL, "f": ty.DECIMAL, "x": ty.DECIMAL}
    targets = [Target(n, ty.DECIMAL) for n in "tdfx"]
    report = job.transfer(spark, source, target, ["a"], {"a": Rules(kinds, targets, fit_decimals=True)}, rejects).first()
    assert report["rows_rejected"] == 0
    kept = target.read(spark, "a")
    assert kept.schema["t"].dataType == T.DecimalType(37, 18) and kept.schema["d"].dataType == T.DecimalType(19, 18)
    assert {Decimal("0.123456789012345678"), Decimal("1234567890123456789.5"), Decimal("1e-12")} <= {r.t for r in kept.collect()}
    fixed = [Target("t", ty.DECIMAL, decimal=(20, 4)), Target("d", ty.DECIMAL, decimal=(20, 2))]
    frame = spark.createDataFrame([(t, Decimal("1.123456789012345678")) for t in NUMBERS], "t string, d decimal(38,18)").coalesce(1)
    rows = job.split_rows(frame, fixed, Rules(kinds)).collect()
    assert all("scale:d" in r["_reasons"] for r in rows)
    lost = {t for t, r in zip(NUMBERS, rows, strict=True) if "scale:t" in r["_reasons"]}
    assert lost == {t for t in NUMBERS if t and places(t) and places(t)[1] > 4}
