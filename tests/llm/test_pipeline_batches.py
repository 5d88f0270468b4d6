"""Stages of the pipeline hand texts to Python workers in batches of a few MB, not 10,000 texts at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_a_stage_bounds_the_bytes_of_a_batch(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    before = spark.conf.get(LIMIT)
    docs = spark.range(0, 9000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 400).alias("text"))
    try:
        stage = dict(corpus_pipeline.STAGES)["sentencepieces"]
        stage(spark, docs, None)
        found = [r["size"] for r in docs.mapInArrow(sizes, "size long").collect()]
        assert sum(found) > 9000 * 2000 and max(found) < 5 << 20
    finally:
        spark.conf.set(LIMIT, before)
