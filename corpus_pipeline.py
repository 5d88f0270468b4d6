"""Stages from raw documents to encoded ones; each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import exact_dedup, mixing, ngram_join, sentencepieces, toxicity
from keelson.llm.common import release, small_batches, stored, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject; it is fitted on the labelled rows of the table."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, Jaccard 0.8 or more."""
    return ngram_join.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of the sources takes them."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids and their number for every row, the hash of the text decoded from them, and whether it is the row's."""
    return sentencepieces.round_trip(docs).select(
        "doc_id", F.size("ids").alias("n_pieces"), "ids", F.sha2("text", 256).alias("text_sha256"), "lossless")


def lean(stage):
    """The stage with small batches for its Python workers: they share their executor's memory with a full heap. The
    driver's Python shares with one too, and hands back what a fitted model leaves behind before the stage's rows are made."""

    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            release()

    return run_lean


STAGES = [(name, lean(stage)) for name, stage in (
    ("toxicity", clean), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("source_mix", mix), ("sentencepieces", encode))]
#: Learnt models, random rounding and sampled segmentations are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents. No rows give no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
