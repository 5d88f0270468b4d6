"""Whitening of vectors on their leading components, found by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block of directions Q is improved by passes over the data, each of which adds up
X'(XQ) of the centred vectors in the tasks: a Chebyshev polynomial of the covariance, built by its recurrence of such
passes, damps the part of the spectrum below the block, then QR and a Rayleigh-Ritz step turn the block. Rounds go on
until the residual of every wanted component certifies it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import giving_back, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, BLOCK = 16, 40
#: Residual of a certified component against the largest eigenvalue, rounds at most, and the filter's degree.
TOLERANCE, ROUNDS, DEGREE = 2e-14, 400, 12
#: Residual at which a block that gets no better counts as certified too: rounding sets its floor.
FLOOR = 1e-10
#: Growth that one filter may give the largest eigenvalue over the smallest wanted one.
GROWTH = 1e7
#: Eigenvalues below this share of the trace are no components: the vectors do not vary along them.
FLAT = 1e-12
#: Bytes of partial sums that may come to the driver at once; beyond it Spark adds them up first.
GATHERED = 64 << 20
#: Vectors that a task looks at together, and the entries that still make a long.
ROWS = 4096
LARGEST = float(2**55)


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``: floor(64 * c) + 1000000 of each entry as a long."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST))
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("c")).filter(
        F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", fits))
    return doubles.select("vec_id", F.transform("c", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long")).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in small runs, with their vectors as a matrix of longs."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            yield part, part["x"].flatten().to_numpy().reshape(part.num_rows, dims)


@dataclass
class Fit:
    """The distinct vectors with what their sums say about the centre: ``S = n * base + rest`` per dimension."""

    rows: DataFrame
    dims: int
    tasks: int
    n: int = 0
    base: np.ndarray | None = None
    rest: np.ndarray | None = None

    def total(self, shape: tuple[int, int], add: Callable[[np.ndarray], np.ndarray], kind: type = np.float64) -> np.ndarray:
        """Sum over all vectors of what ``add`` makes of a matrix of them.

        Each task sends one sum, whose size is that of the dimensions and the block. Where the tasks' sums together would
        be too much for the driver, Spark adds them up before, row by row of the result.
        """
        name, typed = ("long", pa.int64()) if kind is np.int64 else ("double", pa.float64())
        dims = self.dims

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(shape, kind)
            for batch in batches:
                for width, cells in zip(batch["width"].to_pylist(), batch["cells"], strict=True):
                    x = np.frombuffer(cells.as_buffer(), f"<i{width}").astype(np.int64).reshape(-1, dims)
                    found += add(x)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, shape[1]), pa.int32()), pa.array(found.ravel(), typed))
            yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), cells], ["row", "cells"])

        partial = self.rows.mapInArrow(sums, f"row int, cells array<{name}>")
        if self.tasks * shape[0] * shape[1] * 8 > GATHERED:
            partial = partial.groupBy("row").agg(F.array(*[F.sum(F.col("cells")[j]) for j in range(shape[1])]).alias("cells"))
        table = partial.toArrow()
        found = np.zeros(shape, kind)
        np.add.at(found, table["row"].to_numpy(), table["cells"].combine_chunks().flatten().to_numpy().reshape(-1, shape[1]))
        return found

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """``x - S/n``: the whole part is taken off exactly, only the fraction is rounded."""
        base, part = self.base, self.rest / self.n
        return lambda x: (x - base) - part


def packer(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of vectors as one binary each, of numbers of four bytes where they fit: passes then read no lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in matrices(batches, dims):
            width = 4 if len(x) and -(2**31) <= x.min() and x.max() < 2**31 else 8
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())], ["width", "cells"])

    return run


def fit(x: DataFrame) -> Fit | None:
    """The fit list of ``x``: its distinct vectors, written once. None without vectors.

    Vectors are of the most frequent number of entries (the larger one of equals).
    """
    most = x.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if most is None:
        return None
    dims = most["dims"]
    own = x.filter(F.size("x") == dims).select("x").distinct()
    rows = stored(own.mapInArrow(giving_back(packer(dims)), "width int, cells binary"), "distinct-vectors")
    found = Fit(rows, dims, rows.rdd.getNumPartitions())
    # Sums of the high and the low halves, so that none leaves the range of a long; the last row counts.
    halves = found.total((3, dims), lambda x: np.stack([(x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0), np.full(dims, len(x))]), np.int64)
    found.n = int(halves[2, 0])
    sums = [(int(high) << 31) + int(low) for high, low in halves[:2].T]
    found.base = np.array([s // found.n for s in sums], np.int64)
    found.rest = np.array([s % found.n for s in sums], np.int64)
    return found


def filter_degree(top: float, low: float, cut: float) -> int:
    """Degree at which the filter lifts the largest eigenvalue by at most ``GROWTH`` over the smallest wanted one."""
    apart = np.arccosh(max(2 * top / cut - 1, 1.0)) - np.arccosh(max(2 * low / cut - 1, 1.0))
    return int(np.clip(np.arccosh(GROWTH) / apart if apart > 0 else DEGREE, 2, DEGREE))


def leading_components(data: Fit, wanted: int = COMPONENTS, block: int = BLOCK, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (as columns) of the covariance, their eigenvalues in falling order, and its trace.

    Directions along which the vectors do not vary are left out. Of equal eigenvalues any basis is as good. Raises when
    no round certifies the components.
    """
    centred, dims, n = data.centred(), data.dims, data.n
    trace = float(data.total((1, dims), lambda x: np.square(centred(x)).sum(axis=0)[None]).sum()) / n
    if trace == 0:
        return np.zeros((dims, 0)), np.zeros(0), trace

    def apply(q: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return data.total(q.shape, add) / n

    width = min(block, dims)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    best, stale = np.inf, 0
    for _ in range(ROUNDS):
        image = apply(q)
        values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        kept = min(wanted, int(np.sum(values > FLAT * trace)))
        worst = float(np.linalg.norm(image - q * values, axis=0)[:kept].max()) / values[0]
        stale = stale + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if worst <= TOLERANCE or (best <= FLOOR and stale >= 3):
            return q[:, :kept], values[:kept], trace
        cut = max(values[-1], 1e-8 * values[0])
        half = cut / 2
        before, now = q, (image - half * q) / half
        for _ in range(filter_degree(values[0], values[min(wanted, width) - 1], cut) - 1):
            before, now = now, 2 * (apply(now) - half * now) / half - before
        q = np.linalg.qr(now / np.maximum(np.linalg.norm(now, axis=0), 1e-300))[0]
    raise RuntimeError(f"components not certified: residual {best} after {ROUNDS} rounds")


def deviations(x: np.ndarray, data_n: int, base: np.ndarray, rest: np.ndarray) -> pa.Array:
    """Sum over dimensions of ``(n*x - S)^2``, exact; NULL where it is beyond the range of a long."""
    apart = (x - base).astype(np.float64)
    rough = np.square(data_n * apart - rest).sum(axis=1)
    small = rough < 2.0**62
    found = np.square(np.where(small[:, None], data_n * (x - base) - rest, 0)).sum(axis=1)
    values = [int(v) if ok else None for v, ok in zip(found, small)]
    for i in np.flatnonzero(~small & (rough < 2.0**64)):
        exact = sum((data_n * (int(v) - int(b)) - int(r)) ** 2 for v, b, r in zip(x[i], base, rest))
        values[i] = exact if exact < 2**63 else None
    return pa.array(values, pa.int64())


OUT = "vec_id {0}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    ``vectors`` has vec_id and embedding; other columns are ignored. Rows whose vector is NULL, empty or holds an entry
    that is NULL, not finite or of 2^55 or more are left out, and so are vectors of another number of entries than the
    most frequent one. Repeated rows count once in the fit and each get their result. There are as many components as
    directions in which the distinct vectors vary, ``wanted`` at most: equal vectors, a single one and an empty table give
    no rows. What reaches the driver is sums of the size of the dimensions times the block.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    x = scaled(vectors)
    data = fit(x)
    q, values, trace = leading_components(data, wanted) if data else (None, np.zeros(0), 0.0)
    if not len(values):
        return spark.createDataFrame([], OUT.format(kind))
    centred, n, base, rest, dims, count = data.centred(), data.n, data.base, data.rest, data.dims, len(values)
    turn = q / np.sqrt(values)

    def outer(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ turn
        return w.T @ w

    error = float(np.abs(data.total((count, count), outer) / n - np.eye(count)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, dims):
            every = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [part["vec_id"].take(every), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(every), n)), deviations(x, n, base, rest).take(every), pa.array((centred(x) @ turn).ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(len(every), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.filter(F.size("x") == dims).mapInArrow(giving_back(project), OUT.format(kind))
