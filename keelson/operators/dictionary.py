"""Translation dictionary: lookup with fallback, clean-up and synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.names import is_blank, is_empty, key, strip
from keelson.operators.filters import visible
from keelson.operators.scale import first_per_key, heavy_join, number_rows


def lookup(df: DataFrame, dictionary: DataFrame, text: str, lang: str, fallback: Column | None = None,
           name: str = "translated") -> DataFrame:
    """Add the translation of a text column.

    Keys match trimmed and without case. Without a translation the original
    spelling is used; without an entry the fallback, or the text when it is empty.
    """
    fallback = F.lit("") if fallback is None else fallback
    entries = visible(dictionary).filter(~is_empty(F.col("original"))).select(
        F.col("lang_id").alias(lang), F.lower(strip(F.col("original"))).alias("_k"), "entry_id",
        F.coalesce("translation", "original").alias("_t"))
    entries = first_per_key(entries, [lang, "_k"], ["entry_id"]).select(lang, "_k", "_t")
    keyed = df.withColumn("_k", F.lower(strip(F.col(text))))
    spread = F.xxhash64(*[F.col(c) for c in df.columns])
    # Entries hold whole texts: only those of heavy keys are repeated, and they are never gathered on the driver.
    joined = heavy_join(keyed, entries.hint("merge"), [lang, "_k"], "left", spread)
    missing = F.when(~is_empty(fallback), fallback).otherwise(F.col(text))
    value = F.when(is_blank(F.col(text)), fallback).otherwise(F.coalesce(F.col("_t"), missing))
    return joined.withColumn(name, value).select(*df.columns, name)


def without_duplicates(dictionary: DataFrame) -> DataFrame:
    """One entry per (language, key): the one with the lowest id."""
    return first_per_key(dictionary, ["lang_id", "original"], ["entry_id"])


def sync(dictionary: DataFrame, lang_id: str | int, entries: DataFrame, updates: DataFrame) -> DataFrame:
    """Dictionary after a synchronisation of one language.

    Duplicates are removed, missing keys (ignoring case) of ``entries(entry_no,
    original, translation)`` are added with the next free ids in entry order, and the
    translations listed in ``updates(original, translation)`` replace differing ones.
    """
    clean = without_duplicates(dictionary)
    known = clean.filter(F.col("lang_id") == lang_id).select(key("original").alias("_k")).distinct()
    wanted = first_per_key(entries.withColumn("_k", key("original")), ["_k"], ["entry_no"])
    next_id = (dictionary.agg(F.max("entry_id")).first()[0] or 0) + 1
    fresh = number_rows(wanted.join(known, "_k", "left_anti"), ["entry_no"], "entry_id", next_id)
    added = fresh.select("entry_id", F.lit(lang_id).alias("lang_id"), "original", "translation",
                         F.lit(False).alias("hidden"))
    merged = clean.select(*added.columns).unionByName(added)
    forced = updates.groupBy("original").agg(F.max("translation").alias("_new")).withColumn(
        "lang_id", F.lit(lang_id))
    return merged.join(forced, ["lang_id", "original"], "left").select(
        "entry_id", "lang_id", "original", F.coalesce("_new", "translation").alias("translation"), "hidden")
