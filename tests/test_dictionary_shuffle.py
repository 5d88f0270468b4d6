"""A lookup ships each entry once, but for those whose key owns much of the rows."""

from pyspark.sql import functions as F

from keelson.operators import dictionary


def entries(spark):
    rows = [(k, "en", f" Word {k} ", f"t{k}", None) for k in range(300)] + [(900, "en", "word 7", "later", False), (901, "en", "word 8", "hidden", True)]
    return spark.createDataFrame(rows, "entry_id long, lang_id string, original string, translation string, hidden boolean")


def test_entries_are_not_repeated_without_heavy_keys(spark):
    phrases = spark.range(400).select("id", F.lit("en").alias("lang"), F.concat(F.lit("WORD "), F.col("id")).alias("phrase"))
    out = dictionary.lookup(phrases, entries(spark), "phrase", "lang")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "BroadcastExchange" not in plan
    found = {r.id: r.translated for r in out.collect()}
    assert found == {k: f"t{k}" if k < 300 else f"WORD {k}" for k in range(400)}


def test_heavy_keys_find_their_entry(spark):
    phrases = spark.range(400).select("id", F.lit("en").alias("lang"), F.when(F.col("id") % 4 > 0, "word 7").otherwise(F.concat(F.lit("word "), F.col("id"))).alias("phrase"))
    found = {r.id: r.translated for r in dictionary.lookup(phrases, entries(spark), "phrase", "lang").collect()}
    assert found == {k: "t7" if k % 4 else f"t{k}" if k < 300 else f"word {k}" for k in range(400)}
