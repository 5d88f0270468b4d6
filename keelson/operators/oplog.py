"""Operation log: append, search, categories, summary, text export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.names import any_of
from keelson.functions.text import limit_len, log_line

# Longest stored text per log column.
LIMITS = {"message": 255, "details": 500, "sql": 500, "backend": 255, "user": 50, "machine": 255}
SEARCHED = ["message", "details", "sql", "backend"]
EVERYTHING = "All"


def fit_log(df: DataFrame) -> DataFrame:
    """Log rows with every text cut to its stored length."""
    return df.withColumns({name: limit_len(F.col(name), n) for name, n in LIMITS.items() if name in df.columns})


def append_log(df: DataFrame, path: str) -> None:
    fit_log(df).write.mode("append").parquet(path)


def _matches(level: str | None, category: str | None, text: str | None) -> Column:
    found = F.lit(True)
    if level not in (None, EVERYTHING):
        found = found & (F.col("level") == level)
    if category not in (None, EVERYTHING):
        found = found & (F.col("category") == category)
    if text and text.strip():
        wanted = text.strip().lower()
        found = found & any_of([F.lower(F.coalesce(F.col(c), F.lit(""))).contains(wanted) for c in SEARCHED])
    return F.coalesce(found, F.lit(False))


def log_search(log: DataFrame, level: str | None = None, category: str | None = None,
               text: str | None = None) -> DataFrame:
    """Rows of a level and category (unless ``All``) holding the text in any searched column, newest first."""
    return newest_first(log.filter(_matches(level, category, text)))


def newest_first(log: DataFrame) -> DataFrame:
    return log.orderBy(F.col("ts").desc(), F.col("id").desc())


def latest(log: DataFrame) -> DataFrame:
    """The last entry."""
    return newest_first(log).limit(1)


def log_categories(log: DataFrame) -> DataFrame:
    return log.select(F.coalesce("category", F.lit("")).alias("category")).distinct().orderBy("category")


def log_summary(log: DataFrame, level: str | None = None, category: str | None = None,
                text: str | None = None) -> DataFrame:
    """One row, in one pass: matches, all entries, time of the latest match."""
    found = _matches(level, category, text)
    return log.agg(
        F.count_if(found).alias("n_found"), F.count(F.lit(1)).alias("n_total"),
        F.max(F.when(found, F.col("ts"))).alias("last_entry"))


def log_lines(log: DataFrame) -> DataFrame:
    """Each entry as text."""
    columns = [F.col(c) for c in ("ts", "level", "category", "message", "details", "sql")]
    return log.select("id", log_line(*columns).alias("line"))
