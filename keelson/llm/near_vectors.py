"""Near duplicates among embeddings by an inverted multi-index.

The two halves of every unit vector are coded by codebooks of their own; the pairs of codes form a grid of cells. A
query walks the cells by the sum of its two halves' costs, cheapest first, until a radius that reaches the target recall,
and is verified against all vectors of the cells on its way.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import components, stored

#: Vectors from which codebooks and radius are learnt; all vectors are indexed and searched.
SAMPLE = 20_000
#: Vectors in a cell that the grid is sized for, and vectors that a verifying task holds on either side.
CELL, BLOCK = 1024, 2048


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def codebook(rows: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), size=min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        near = distances(rows, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum(0.0, (rows ** 2).sum(1)[:, None] - 2 * rows @ centres.T + (centres ** 2).sum(1))


def costs(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of each row, and for every code the squared distance to the border that a move there must cross."""
    far = distances(rows, centres)
    near = far.argmin(axis=1)
    apart = np.sqrt(distances(centres, centres))[near]
    gap = (far - far[np.arange(len(rows)), near][:, None]) / (2 * np.where(apart > 0, apart, 1.0))
    return near, np.where(apart > 0, gap, 0.0) ** 2


class MultiIndex:
    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float, seed: int = 7) -> None:
        rows = unit_rows(sample)
        self.dim, self.half = rows.shape[1], rows.shape[1] // 2
        self.one, self.two = codebook(rows[:, :self.half], k, seed), codebook(rows[:, self.half:], k, seed + 1)
        # Neighbours at the very threshold, in random directions: the hardest that must be found.
        rng = np.random.default_rng(seed + 2)
        away = rng.standard_normal(rows.shape)
        away -= (away * rows).sum(1, keepdims=True) * rows
        norm = np.linalg.norm(away, axis=1, keepdims=True)
        other = threshold * rows + math.sqrt(max(0.0, 1 - threshold ** 2)) * away / np.where(norm > 0, norm, 1.0)
        (_, a), (_, b) = costs(rows[:, :self.half], self.one), costs(rows[:, self.half:], self.two)
        x, y = distances(other[:, :self.half], self.one).argmin(1), distances(other[:, self.half:], self.two).argmin(1)
        at = np.arange(len(rows))
        self.radius = float(np.quantile(a[at, x] + b[at, y], recall)) + 1e-12

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell of each unit vector, and the cells it visits: two sorted sequences of costs, merged by their sum."""
        (x, a), (y, b) = costs(rows[:, :self.half], self.one), costs(rows[:, self.half:], self.two)
        width, visits = len(self.two), []
        order_a, order_b = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        for r in range(len(rows)):
            first, second = a[r, order_a[r]], b[r, order_b[r]]
            many = np.searchsorted(second, self.radius - first[first <= self.radius], "right")
            left = np.repeat(order_a[r, :len(many)], many)
            right = np.concatenate([order_b[r, :m] for m in many])
            visits.append(np.union1d(left * width + right, [x[r] * width + y[r]]))
        return x * width + y, visits


def coder(index: MultiIndex):
    def run(batches):
        for batch in batches:
            reps, vectors = batch.column("rep"), batch.column("vec").to_pylist()
            own, visits = np.empty(len(vectors), dtype=np.int64), [None] * len(vectors)
            plain = [k for k, v in enumerate(vectors) if len(v) == index.dim]
            if plain:
                cells, ways = index.cells(unit_rows(np.array([vectors[k] for k in plain])))
                own[plain] = cells
                for k, way in zip(plain, ways, strict=True):
                    visits[k] = way
            for k, v in enumerate(vectors):  # a vector of another length has a cell for that length
                if visits[k] is None:
                    own[k], visits[k] = -1 - len(v), np.array([-1 - len(v)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), reps, batch.column("copies"), pa.array([np.asarray(v, np.float64).tobytes() for v in vectors], pa.binary()),
                 pa.array(own), pa.array(visits, pa.list_(pa.int64()))], names=["label", "rep", "copies", "vec", "own", "visits"])

    return run


def verifier(threshold: float):
    """Visitors of a cell (or of a block of it) against its members: counts of links, and each node's class there."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        member = frame["member"].to_numpy()
        if member.all() or not member.any():
            return empty
        cell = frame["cell"].iat[0]
        rows = unit_rows(np.stack([np.frombuffer(v) for v in frame["vec"]]))
        reps, copies, own = (frame[c].to_numpy() for c in ("rep", "copies", "own"))
        v, m = np.flatnonzero(~member), np.flatnonzero(member)
        hit_v, hit_m = np.nonzero(rows[v] @ rows[m].T >= threshold)
        hit_v, hit_m = v[hit_v], m[hit_m]
        other = reps[hit_v] != reps[hit_m]
        hit_v, hit_m = hit_v[other], hit_m[other]
        if not len(hit_v):
            return empty
        nodes, place = np.unique(reps, return_inverse=True)
        found = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(found, place[hit_v], copies[hit_m])
        # A member that does not visit the visitor's cell cannot count the link there, so it does here.
        visits = frame["visits"].to_numpy()
        strange = np.flatnonzero(own[hit_v] != cell)
        for k in strange.tolist():
            if own[hit_v[k]] not in visits[hit_m[k]]:
                found[place[hit_m[k]]] += copies[hit_v[k]]
        label, x, y = np.arange(len(nodes)), place[hit_v], place[hit_m]
        while True:
            low = np.minimum(label[x], label[y])
            after = label.copy()
            np.minimum.at(after, x, low)
            np.minimum.at(after, y, low)
            if (after == label).all():
                break
            label = after
        linked = np.unique(np.concatenate([x, y]))
        return pd.DataFrame({"a": nodes[linked], "b": nodes[label[linked]], "n": found[linked]})

    return run


def vector_classes(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999) -> DataFrame:
    """Per row ``(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Rows of one label link where their cosine in double precision is at least ``threshold``. A row whose vector is NULL,
    empty or all zero, or holds NULL or non-finite numbers, and a row without label, links with nothing. Equal vectors of
    a label are searched once. Vectors of different lengths never link. ``recall`` is aimed at for pairs at the very
    threshold; nearer pairs are found more often. Repeated rows are copies of each other; rows without vec_id are nodes
    of nothing. Extra columns are ignored; no rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    sound = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                       & F.exists("vec", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    same = ["label", "h1", "h2"]
    sane = rows.filter(sound).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    reps = stored(sane.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by("vec", "vec_id").alias("vec")), "vectors")
    size = F.size("vec")
    usual = reps.groupBy(size.alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = reps.filter(size == usual["dim"]).orderBy(F.xxhash64("rep"), "rep").select("vec").limit(SAMPLE).collect()
    k = max(2, round(math.sqrt(usual["count"] / CELL)))
    index = MultiIndex(np.array([r[0] for r in sample]), k, threshold, recall)

    label = reps.schema["label"].dataType.simpleString()
    coded = reps.select("label", "rep", "copies", "vec").mapInArrow(
        coder(index), f"label {label}, rep long, copies long, vec binary, own long, visits array<bigint>")
    coded = stored(coded, "cells")
    ways = coded.select("label", "rep", F.explode("visits").alias("cell"))
    sizes = ways.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("vs")).join(
        coded.groupBy("label", F.col("own").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("ms")), ["label", "cell"])
    none = F.array().cast("array<bigint>")
    coming = coded.select("label", "rep", "copies", "vec", "own", none.alias("visits"), F.explode("visits").alias("cell")).join(sizes, ["label", "cell"])
    block = lambda of: F.pmod(F.xxhash64("rep"), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    shape = ["label", "cell", "v", "m", "rep", "copies", "vec", "own", "visits", "member"]
    coming = coming.withColumn("member", F.lit(False)).withColumn("v", block("vs")).withColumn("m", each("ms")).select(*shape)
    living = coded.withColumn("cell", F.col("own")).join(sizes, ["label", "cell"]).withColumn("member", F.lit(True)).withColumn(
        "m", block("ms")).withColumn("v", each("vs")).select(*shape)
    linked = stored(coming.union(living).groupBy("label", "cell", "v", "m").applyInPandas(
        verifier(threshold), "a long, b long, n long"), "linked")
    counts = linked.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    classes = components(linked.filter("a <> b")).withColumnRenamed("node", "rep")
    told = reps.select(*same, "rep", "copies").join(counts, "rep", "left").join(classes, "rep", "left").select(
        *same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    hashed = rows.withColumns({"h1": F.when(sound, F.xxhash64("vec")), "h2": F.xxhash64(F.lit(1), "vec")}).select("vec_id", *same)
    out = hashed.join(told, same, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))
