"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import ROW, WORD, join_small, numbered, stored
from keelson.operators.scale import number_rows

BLOCK = 2000
NEAR_ONE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``(source, source_size, target)``; sources by code point, NULL last, weigh ``weights`` in turn.

    They share ``share`` times all sizes by weight; no target exceeds ``most`` times its source's size, and what that
    leaves over goes to the others by weight until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    sources = number_rows(sources, ["_null", "source"], "_n", 0)
    picks = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    sources = stored(sources.select("source", "source_size", picks.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1
    # Water level: every round fixes at least one more source at its limit, or ends.
    while True:
        full = F.lit(level) * F.col("weight") > F.col("cap")
        fixed, n_full, open_weight = sources.agg(
            F.sum(F.when(full, F.col("cap"))), F.count(F.when(full, 1)), F.sum(F.when(~full, F.col("weight")))).first()
        if n_full == before or not open_weight:
            break
        before, level = n_full, (budget - (fixed or 0.0)) / open_weight
    target = F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double"))
    return sources.select("source", "source_size", target.alias("target"))


def settle(frame: pd.DataFrame) -> pd.DataFrame:
    """Pivotal steps along the rows of one block: of two open rows, chance moves mass until one is 0 or 1.

    At most one row stays open. Each step draws from the number of the row that joins, so reruns agree.
    """
    frame = frame.sort_values(["size", "draw", "doc_id"], kind="stable", ignore_index=True)
    chance, draws = frame["p"].to_numpy().copy(), frame["draw"].to_numpy()
    held = -1
    for i in range(len(chance)):
        if not NEAR_ONE < chance[i] < 1 - NEAR_ONE:
            chance[i] = round(chance[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = chance[held], chance[i]
        both = a + b
        if both < 1:
            win, lose = (i, held) if draws[i] * both < b else (held, i)
            chance[win], chance[lose], held = both, 0.0, win
        else:
            win, rest = (held, i) if draws[i] * (2 - both) < 1 - b else (i, held)
            chance[win], chance[rest], held = 1.0, both - 1, rest
        if not NEAR_ONE < chance[held] < 1 - NEAR_ONE:
            chance[held], held = round(chance[held]), -1
    frame["p"] = chance
    frame["open"] = np.arange(len(chance)) == held
    # The next level draws anew.
    frame["draw"] = (frame["draw"] * 7919.0) % 1.0
    return frame


def round_pivotal(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """``units`` with ``p`` rounded to 0 or 1: each source's sum is kept to within one, nearby sizes trade first.

    Blocks of one source and size band are settled apart; the single open row of each goes up to the next level.
    """
    band = F.floor(F.log2(F.col("size") + 1) * 4).cast("int")
    counts = units.withColumn("band", band).groupBy("source", "band").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    first = units.withColumn("band", band).alias("u").join(counts.alias("c"), F.expr("u.source <=> c.source and u.band = c.band"))
    first = first.select("u.*", F.pmod(F.xxhash64("u.doc_id", F.lit(17)), F.col("c.parts")).alias("bucket"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema) + ", open boolean"

    def level(rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("source", "band", "bucket").applyInPandas(settle, schema), "pivotal")

    done, now = [], level(first)
    while True:
        done.append(now.filter("not open").drop("open"))
        left = now.filter("open").drop("open")
        widest, bands = left.agg(F.max("bucket"), F.max("band")).first()
        if widest is None:
            break
        if widest > 0:
            left = left.withColumn("bucket", F.floor(F.col("bucket") / block).cast("long"))
        elif bands >= 0:
            left = left.withColumn("band", F.lit(-1))
        else:
            done.append(left.withColumn("p", F.when(F.col("draw") < F.col("p"), 1.0).otherwise(0.0)))
            break
        now = level(left)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("band", "bucket")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, copies, taken, and the columns to ``carry``.

    ``copies`` is the whole part of target / source_size, and one more for the rows that pivotal rounding picks. The size
    of a text is its number of words; NULL and empty texts have size 0 and are taken as often as their source's others,
    at no words. A NULL source is a source of its own. Repeated rows are rounded one by one. No rows give no rows.
    """
    sizes = docs.select(
        *carry, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = stored(sizes, "sizes")
    targets = source_targets(sizes, weights, share, most)
    joined = sizes.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "size", F.lit(seed)), 11) / F.lit(float(1 << 53))
    units = joined.withColumn("base", F.floor(rate).cast("long")).withColumn("p", rate - F.floor(rate)).withColumn("draw", draw)
    rounded = round_pivotal(units)
    copies = F.col("base") + F.col("p").cast("long")
    return rounded.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them; rows that repeat, share a doc_id or have none each have their own number."""
    rows = numbered(docs)
    copies = mix(rows, carry=(ROW,), **options).filter("copies > 0").select(ROW, F.col("copies").cast("int").alias("_copies"))
    taken = join_small(rows, stored(copies, "copies"), [ROW], "inner")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
