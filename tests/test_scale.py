"""Helpers for large and uneven data."""

from pyspark.sql import functions as F

from keelson.operators import scale


def skewed(spark):
    """A third of the rows share one key."""
    return spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"))


def test_salted_join_equals_plain_join(spark):
    many, few = skewed(spark), spark.range(0, 60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        one = scale.salted_join(many, few, ["k"], how, F.col("id"))
        assert one.exceptAll(many.join(few, "k", how).select(*one.columns)).count() == 0
        assert one.count() == many.join(few, "k", how).count()


def test_heavy_join_equals_plain_join(spark):
    ids = spark.range(20000)
    frames = [
        ids.select("id", F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("k")),  # nine in ten rows share a key
        ids.select("id", F.when(F.col("id") % 3 > 0, None).otherwise(F.col("id") % 9000).alias("k")),  # two in three have none
        ids.select("id", F.col("id").alias("k")), ids.filter("id < 0").select("id", F.col("id").alias("k"))]
    few = spark.range(0, 15000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for many in frames:
        for how in ("inner", "left", "left_semi", "left_anti"):
            one, plain = scale.heavy_join(many, few, ["k"], how, F.col("id")), many.join(few, "k", how)
            assert sorted(map(str, one.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    found = [scale.heavy_keys(many, ["k"]) for many in frames]
    seven = spark.range(1).select(F.xxhash64(F.lit(7).cast("long"))).first()[0]
    assert found[0] == [seven] and len(found[1]) == 1 and found[2] == found[3] == []


def test_numbers_are_consecutive_in_order(spark):
    df = skewed(spark)
    rows = scale.number_rows(df, ["k", "id"], "n", 10).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(10, 3010))
    assert [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)


def test_numbers_within_groups(spark):
    rows = scale.number_within(skewed(spark), ["k"], ["id"], "n").collect()
    by_key = {}
    for r in sorted(rows, key=lambda r: r.id):
        by_key.setdefault(r.k, []).append(r.n)
    assert all(numbers == list(range(1, len(numbers) + 1)) for numbers in by_key.values())


def test_numbering_an_empty_frame(spark):
    assert scale.number_rows(skewed(spark).filter("id < 0"), ["id"], "n").count() == 0


def test_first_per_key_keeps_whole_rows(spark):
    rows = scale.first_per_key(skewed(spark).withColumn("x", F.col("id") * 2), ["k"], ["id"]).collect()
    assert {r.k: (r.id, r.x) for r in rows}[7] == (0, 0)


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scale.shared_folder(spark) == named.rstrip("/")
    assert scale.new_folder(spark, "a") != scale.new_folder(spark, "a")
