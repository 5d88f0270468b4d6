"""Features of texts and linear models over them, fitted on a bounded sample and applied to all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import giving_back, stored
from keelson.llm.shingles import Hasher, mixed, text_runs

#: Files that a sample comes to the driver in, and rows whose features it spreads out at once: they bound its memory only.
SAMPLE_PARTS, TOGETHER = 8, 256


def word_features(buckets: int, stems: tuple[int, ...] = (4, 5)):
    """Per text, as bucket numbers: distinct words (runs of letters, A-Z lower-cased) and their first bytes, and which
    patterns of equal words in a row occur."""
    code = np.arange(256)
    letters = (code >= 128) | ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)

    def features(hasher: Hasher, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        words, counts = hasher.words(data, bounds)
        mask = np.uint64(buckets - 5)
        kinds = [words % mask, *[mixed(hasher.words(data, bounds, n)[0] + np.uint64(n)) % mask for n in stems]]
        ends = np.cumsum(counts)
        return [np.concatenate([np.unique(np.concatenate([k[e - c:e] for k in kinds])).astype(np.int32), repeats(words[e - c:e], buckets)])
                for c, e in zip(counts, ends, strict=True)]

    return features, lambda: Hasher(~letters)


def repeats(words: np.ndarray, buckets: int) -> np.ndarray:
    """The last four buckets: two, three, four equal words in a row; no words."""
    alike = words[1:] == words[:-1]
    rows = [alike.any(), (alike[1:] & alike[:-1]).any(), (alike[2:] & alike[1:-1] & alike[:-2]).any(), not len(words)]
    return np.flatnonzero(rows).astype(np.int32) + buckets - 4


def gram_features(buckets: int):
    """Distinct three-byte grams, and which of the patterns of equal words in a row occur (two, three, four alike)."""

    def features(hasher: Hasher, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        words, counts = hasher.words(data, bounds)
        ends, out = np.cumsum(counts), []
        wide = data.astype(np.uint64)
        grams = (mixed(wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)) % np.uint64(buckets - 4)) if len(data) > 2 else wide[:0]
        for low, high, c, e in zip(bounds[:-1], bounds[1:], counts, ends, strict=True):
            own = np.unique(grams[low:max(low, high - 2)])
            out.append(np.concatenate([own.astype(np.int32), repeats(words[e - c:e], buckets)]))
        return out

    return features, Hasher


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: list[str], features, hasher, most_rows: int):
    """Feature numbers and labels of at most ``most_rows`` labelled rows, drawn by a hash of their doc_id.

    A doc_id's labels are the largest given; labels that are NULL are left out. The bound is the only one of its kind:
    models are scored over all rows.
    """
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.max(t).cast("int").alias(t) for t in targets]).dropna()
    drawn = one.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most ``most_rows`` rows of a few integers: a proven bound.
    rows = rows.join(F.broadcast(drawn), "doc_id").select("text", "doc_id", *targets)

    def run(batches):
        own = hasher()
        for batch in batches:
            for at, data, bounds in text_runs(batch.column(0)):
                found = features(own, data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.tobytes() for f in found], pa.binary()), *[batch.column(k).slice(at, len(found)) for k in range(1, len(targets) + 2)]],
                    names=["features", "doc_id", *targets])

    kinds = ", ".join(f"{t} int" for t in targets)
    found = rows.mapInArrow(giving_back(run), f"features binary, doc_id long, {kinds}").orderBy("doc_id", *targets).limit(most_rows)
    # The driver's JVM merges nothing and holds one part at a time; its heap would stay as large as the whole sample made it.
    found = stored(found.repartition(SAMPLE_PARTS), "sample").toLocalIterator()
    found = sorted(found, key=lambda r: (r["doc_id"], *[r[t] for t in targets], r["features"]))
    sets = [np.frombuffer(r["features"], dtype=np.int32) for r in found]
    return sets, np.array([[r[t] for t in targets] for r in found]).reshape(len(found), len(targets))


class Rows:
    """Sets of feature numbers as one array; features that few rows have are left out of the fit."""

    def __init__(self, sets: list[np.ndarray], buckets: int, fewest: int) -> None:
        counts = np.zeros(buckets, dtype=np.int64)
        for s in sets:
            np.add.at(counts, s, 1)
        self.used = np.flatnonzero(counts >= fewest)
        place = np.full(buckets, -1, dtype=np.int32)
        place[self.used] = np.arange(len(self.used))
        self.sets = [place[s][place[s] >= 0] for s in sets]
        self.width = len(self.used)

    def of(self, rows) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Few rows at a time: their place in ``rows``, their features one after the other, and the row there of each."""
        for at in range(0, len(rows), TOGETHER):
            own = [self.sets[r] for r in rows[at:at + TOGETHER]]
            yield slice(at, at + len(own)), np.concatenate(own), np.repeat(np.arange(len(own)), [len(s) for s in own])


def ratios(rows: Rows, chosen: np.ndarray, y: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Log of how much more often a feature's indicator falls to class 1 than to class 0.

    It is 0 for features whose chi-squared statistic is below ``least``.
    """
    ones, total, goal = np.zeros(rows.width), np.zeros(rows.width, dtype=np.int64), y[chosen]
    for part, flat, which in rows.of(chosen):
        ones += np.bincount(flat, weights=goal[part][which], minlength=rows.width)
        total += np.bincount(flat, minlength=rows.width)
    good, bad = ones + 1.0, total - ones + 1.0
    out = np.log(good / good.sum()) - np.log(bad / bad.sum())
    share = min(max(float(y[chosen].mean()), 1e-9), 1 - 1e-9)
    chi = (ones - total * share) ** 2 / np.maximum(total * share * (1 - share), 1e-12)
    return np.where(chi >= least, out, 0.0)


def fit_hinge(rows: Rows, chosen: np.ndarray, y: np.ndarray, earlier: np.ndarray | None = None, least: float = 0.0,
              epochs: int = 12, cost: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights per feature (ratio times linear weight), and those of the earlier columns and of the constant.

    Indicators are scaled by their ratios, rows to length 1; the hinge loss falls by dual coordinate descent. The rarer
    class weighs as much as the other in all.
    """
    scale = ratios(rows, chosen, y, least)
    dense = np.column_stack([earlier[chosen] if earlier is not None else np.zeros((len(chosen), 0)), np.ones(len(chosen))])
    sign, target = np.where(y[chosen] == 1, 1.0, -1.0), y[chosen]
    weights, rest, alpha = np.zeros(rows.width), np.zeros(dense.shape[1]), np.zeros(len(chosen))
    share = min(max(float(target.mean()), 1e-9), 1 - 1e-9)
    most_alpha = np.where(target == 1, cost * 0.5 / share, cost * 0.5 / (1 - share))
    own, values = [], []
    for r in chosen:
        row = rows.sets[r][scale[rows.sets[r]] != 0]
        x = scale[row]
        own.append(row)
        values.append(x / max(1e-12, float(np.sqrt(x @ x))))
    square = np.array([float(x @ x) for x in values]) + (dense ** 2).sum(1)
    rng = np.random.default_rng(13)
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(len(chosen)).tolist():
            row, x, s = own[k], values[k], sign[k]
            slack = s * (weights[row] @ x + dense[k] @ rest) - 1
            old = alpha[k]
            step = min(max(old - slack / square[k], 0.0), most_alpha[k]) - old
            if step:
                alpha[k] += step
                weights[row] += step * s * x
                rest += step * s * dense[k]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return weights * scale, rest


def margins(rows: Rows, chosen: np.ndarray, weights: np.ndarray, rest: np.ndarray, earlier: np.ndarray | None = None) -> np.ndarray:
    out = np.full(len(chosen), rest[-1], dtype=float)
    for part, flat, which in rows.of(chosen):
        out[part] += np.bincount(which, weights=weights[flat], minlength=part.stop - part.start)
    return out + earlier[chosen] @ rest[:-1] if earlier is not None else out


def scored(docs: DataFrame, features, hasher, finish, schema: str, keep: list[str]) -> DataFrame:
    """``finish(sets)`` over the feature sets of every row, beside the columns to keep."""

    def run(batches):
        own = hasher()
        for batch in batches:
            for at, data, bounds in text_runs(batch.column(0)):
                found = finish(features(own, data, bounds))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k + 1).slice(at, len(bounds) - 1) for k in range(len(keep))], *[pa.array(c) for c in found.values()]],
                    names=[*keep, *found])

    return docs.select(F.col("text").cast("string").alias("_text"), *keep).mapInArrow(giving_back(run), schema)


def sums(weights: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    counts = np.array([len(s) for s in sets])
    if not counts.sum():
        return np.zeros(len(sets))
    return np.bincount(np.repeat(np.arange(len(sets)), counts), weights=weights[np.concatenate(sets)], minlength=len(sets))


def folds(n: int, k: int = 5) -> np.ndarray:
    return np.random.default_rng(3).permutation(n) % k


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton steps on smoothed targets."""
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margins + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - goal) * margins).sum(), (p - goal).sum()])
        h = np.array([[(w * margins ** 2).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
