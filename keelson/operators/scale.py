"""Helpers that keep large and uneven data spread over the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEWEST_SALTS = 4
#: Heavy keys that a sketch reports, and the counters it may hold per task.
HEAVY_KEYS, COUNTERS = 256, 16_384


def salt_count(spark: SparkSession) -> int:
    """Sub-keys for a hot key: an eighth of the shuffle partitions, so that it follows the cluster's width."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(FEWEST_SALTS, partitions // 8)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Where the cluster names none it lies in the session's warehouse, which all of them share too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return named.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def salted_join(many: DataFrame, few: DataFrame, on: list[str], how: str, spread: Column,
                salts: int | None = None) -> DataFrame:
    """Join where one key may own a large part of ``many``.

    Rows of ``many`` are spread over ``salts`` sub-keys by ``spread``, a value taken
    from the row itself, so that a re-run task places them alike; ``few`` is repeated
    once per sub-key. Exact for inner, left, left_semi and left_anti joins.

    The optimizer sizes the repeated side by its files, packed and before the repeats, and would gather it on
    the driver long after it has outgrown it; so it is always shuffled.
    """
    salts = salts or salt_count(many.sparkSession)
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def heavy_keys(df: DataFrame, on: list[str]) -> list[int]:
    """Hashes of the keys that own more than half of what a shuffle partition gets on average.

    A frequent-items sketch is filled in the tasks and merged: its size does not grow with the rows, and its error is far
    below the share asked for. A key missed or named by mistake costs time only.
    """
    if not on:
        return []
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.call_function(
        "approx_top_k", F.xxhash64(*on), F.lit(HEAVY_KEYS), F.lit(COUNTERS)).alias("top")).first()
    least = found["n"] / (2 * max(partitions, FEWEST_SALTS))
    return [item["item"] for item in found["top"] or [] if item["count"] > least]


def heavy_join(many: DataFrame, few: DataFrame, on: list[str], how: str, spread: Column) -> DataFrame:
    """Join where some keys may own a large part of ``many``: only rows of those keys are spread and repeated.

    ``many`` is read once more for a sketch of its keys, so it should be a stored frame or a plain scan. Rows of other keys
    are joined as they are; without heavy keys the join is an ordinary one. Exact for inner, left, left_semi and left_anti
    joins; NULL keys match nothing, but are spread if heavy.
    """
    heavy = heavy_keys(many, on)
    if not heavy:
        return many.join(few, on, how)
    salts, is_heavy = salt_count(many.sparkSession), F.xxhash64(*on).isin(heavy)
    left = many.withColumn("_salt", F.when(is_heavy, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    right = few.withColumn("_salt", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, order: list[str], name: str, start: int | Column = 1) -> DataFrame:
    """Consecutive numbers over a total order, without a single-task window.

    Rows are placed by range and sorted, each keeps its place within its partition,
    and only the partition sizes (one row per partition) are summed up in order. The
    placement is checkpointed first: later jobs must see the very same partitions.
    """
    start = start if isinstance(start, Column) else F.lit(start)
    placed = (
        df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = cut_lineage(placed)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # One row per partition, so the bound of the broadcast is the partition count.
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, (F.col("_offset") + F.col("_place") + start).cast("bigint")).drop(
        "_part", "_place", "_offset")


def number_within(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers 1, 2, ... inside each group, for groups of any size."""
    numbered = number_rows(df, [*group, *order], "_n", 0)
    firsts = numbered.groupBy(*group).agg(F.min("_n").alias("_first"))
    joined = salted_join(numbered, firsts, group, "inner", F.col("_n"))
    return joined.withColumn(name, F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def first_per_key(df: DataFrame, keys: list[str], order: list[str], largest: bool = False) -> DataFrame:
    """One whole row per key: the first (or last) by ``order``, reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in rest]).alias("_row"))
    picked = df.groupBy(*keys).agg((F.max if largest else F.min)(row).alias("_pick"))
    return picked.select(*keys, "_pick._row.*").select(*df.columns)
