"""How far the sources of a language differ in the words they use, in exact whole numbers.

The terms of all texts are counted per task by length-bucketed packing (``packed_terms``) and added up by Spark. Shares
of sources are compared in blocks of terms: each block is a table of terms by sources, its sums over the block's terms are
added up, so no term's list of sources is ever expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import giving_back, join_small, stored
from keelson.llm.packed_terms import batch_tables

#: Documents of a language that must hold a term.
FEWEST = 10
SHARE = 1_000_000_000
TOP = 10
#: Cells of a block of terms by sources, and sources whose rows one group works out.
CELLS, STRIPE = 1 << 19, 256


def count_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term and the documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.StructArray.from_arrays([batch["lang"], batch["source"]], ["lang", "source"]).to_pylist()
            numbers = {}
            group = np.fromiter((numbers.setdefault((r["lang"], r["source"]), len(numbers)) for r in names), np.int64, len(names))
            langs, sources = (pa.array([k[i] for k in numbers], pa.string()) for i in (0, 1))
            for groups, terms, n, held in batch_tables(batch["text"], group):
                groups = pa.array(groups)
                yield pa.RecordBatch.from_arrays([langs.take(groups), sources.take(groups), terms, pa.array(n, pa.int64()), pa.array(held, pa.int64())],
                                                 ["lang", "source", "term", "n", "docs"])

    texts = named(docs).select("lang", "source", F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(giving_back(count), "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def share(count: str, total: str, terms: str) -> F.Column:
    """``1 + floor(10^9 * (count + 2) / (total + 2 * terms))``; the product is exact, the quotient fits a long."""
    return F.expr(f"1L + (CAST({count} + 2 AS DECIMAL(38,0)) * {SHARE}BD) div CAST({total} + 2 * {terms} AS DECIMAL(38,0))")


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """The same for a table of counts, in three steps of long division, so that every product stays below 2^63."""
    divisor = totals + 2 * terms
    rest, found = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, divisor)
        found = found * 1000 + step
    return found + 1


def block_sums(counts: pa.Table, sources: pa.Table) -> pa.Table:
    """For one block of a language's terms: per source of the stripe and each other source, the sum over the terms."""
    names = sources["source"].to_pylist()
    lang, terms = sources["lang"][0].as_py(), sources["terms"][0].as_py()
    place = {name: i for i, name in enumerate(names)}
    coded = counts["term"].combine_chunks().dictionary_encode() if counts.num_rows else None
    table = np.zeros((len(names), len(coded.dictionary) if coded is not None else 0), np.int64)
    if coded is not None:
        rows = np.fromiter((place[s] for s in counts["source"].to_pylist()), np.int64, counts.num_rows)
        table[rows, coded.indices.to_numpy()] = counts["n"].to_numpy()
    if table.shape[1]:
        table = shares(table, sources["total"].to_numpy()[:, None], terms)
    mine = np.flatnonzero(sources["own"].to_numpy(zero_copy_only=False))
    left, right, value = [], [], []
    for i in mine:
        apart = table - table[i]
        sums = (apart * apart // np.maximum(table + table[i], 1)).sum(axis=1, dtype=np.int64)
        others = np.flatnonzero(np.arange(len(names)) != i)
        left += [names[i]] * len(others)
        right += [names[j] for j in others]
        value.append(sums[others])
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "source": pa.array(left, pa.string()),
                     "item": pa.array(right, pa.string()), "value": pa.array(np.concatenate(value) if value else [], pa.int64())})


def source_divergence(docs: DataFrame, fewest: int = FEWEST, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each other source of the language is (``pair``), and the
    ``top`` terms that a source uses more than its language does (``term``).

    ``docs`` has text, lang and source; other columns are ignored and NULL counts as ''. Every language and source that
    occurs is a group, with or without terms; a source alone in its language has no pairs, and without kept terms all
    pairs have value 0 and no term is listed. Repeated rows count as often as they stand there. Equal values rank by the
    item's bytes. Without rows there is no result. Terms are never gathered: counts are added up in tasks before they are
    shuffled, blocks of terms by sources hold a bounded number of cells while a language has fewer than ``CELLS`` sources.
    """
    counts = stored(count_terms(docs), "term-counts")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= fewest)
                  .select("lang", "term", "lang_n"), "kept-terms")
    used = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")
    groups = named(docs.select("lang", "source", F.lit("").alias("text"))).select("lang", "source").distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    own = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = stored(groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang")
                    .na.fill(0, ["total", "terms", "lang_total"]), "source-totals")

    shared = join_small(used, totals.drop("sources"), ["lang", "source"], "inner", 50_000).select(
        "lang", "source", F.col("term").alias("item"), share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"))
    leaning = shared.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = leaning.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    blocks = F.greatest(F.ceil(F.col("terms") * F.col("sources") / CELLS), F.lit(1)).cast("int")
    stripes = F.ceil(F.col("sources") / STRIPE).cast("int")
    sized = totals.select("lang", "source", "total", "terms", blocks.alias("blocks"), stripes.alias("stripes"))
    plans = sized.select("lang", "blocks", "stripes").distinct()
    cells = join_small(used, plans, ["lang"], "inner", 50_000).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"), "source", "term", "n")
    sides = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).select(
        "lang", "block", "stripe", "source", "total", "terms", (F.pmod(F.xxhash64("source"), F.col("stripes")) == F.col("stripe")).alias("own"))
    key = ["lang", "block", "stripe"]
    sums = cells.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(block_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranks)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
