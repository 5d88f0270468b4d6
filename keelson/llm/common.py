"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators.scale import cut_lineage, new_folder

#: Rows of eight-byte keys that may be broadcast: at most some 32 MB once hashed. Beyond it a join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of rows in a batch for a Python worker.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once as Parquet below the folder of ``spark.checkpoint.dir`` and read again.

    Lineage ends there: a lost executor costs only the tasks that read the files.
    """
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.parquet(path)
    free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing refers to: it does so once the driver collects its garbage, which a
    driver with little to do puts off while the files of every step add up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Deletes the files of ``stored`` frames that nothing reads any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Name of a row's own number.
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, written once so that it stays the same in all that reads them."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def release() -> None:
    """Hands the process's freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """A ``mapInArrow`` or ``mapInPandas`` function that hands freed memory back to the system before it begins and when it
    ends: Python workers live on, and what they keep would add up over the stages of a job."""

    def run_and_release(batches: Iterator):
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return run_and_release


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python workers in smaller batches. The default of 10,000 whole texts is some
    tens of MB, and a task holds several copies: Spark's, the one under way, the worker's and that of its result."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def lower_ascii(text: Column) -> Column:
    """Text with A-Z alone lower-cased; NULL becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def join_small(rows: DataFrame, keys: DataFrame, on: list[str], how: str, bound: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Joins wide rows with narrow keys: by broadcast if the counted keys are within the bound, else by shuffle.

    ``weight`` says how many keys a row counts for where rows hold arrays."""
    n = keys.count() if weight is None else keys.agg(F.sum(weight + 1)).first()[0] or 0
    return rows.join(F.broadcast(keys) if n <= bound else keys, on, how)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component_id)`` of every node with a link; the id is the smallest node reachable.

    Alternates large-star and small-star steps, so long chains fold in a logarithmic number of rounds; each round
    is checkpointed. Edges are never gathered in one place.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pairs, last = cut_lineage(pairs), None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(lowest.select("u", F.col("m").alias("v"))).distinct())
        pairs = cut_lineage(small)
        mark = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == last:
            break
        last = mark
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
