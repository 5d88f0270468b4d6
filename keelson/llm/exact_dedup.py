"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each chunk of rows sends the sorted, compressed fingerprints of its texts to the owners of their ranges; owners answer
with bitmaps of those that occur elsewhere too. Only texts marked so, the suspects, are shuffled and compared as bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import giving_back, join_small, lower_ascii, stored

CHUNK_ROWS = 1 << 18
OWNER_ROWS = 1 << 20
FEWEST_OWNERS = 8


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted unsigned numbers as Golomb codes of their gaps, with a power of two as divisor.

    Quotients in unary and remainders in fixed width are kept apart, so both decode as whole arrays.
    """
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = float(values[-1]) / len(values) if len(values) else 0.0
    width = max(0, min(63, int(math.log2(mean * 0.69)))) if mean > 2 else 0
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(values), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    places = np.arange(width, dtype=np.uint64)
    bits = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return width, np.packbits(unary).tobytes(), np.packbits(bits.ravel()).tobytes()


def golomb_decode(n: int, width: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)) == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, dtype=np.uint8))[: n * width].reshape(n, width).astype(np.uint64)
    low = (bits << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(width)) + low, dtype=np.uint64)


CODED = ("chunk string, owner long, n int, start decimal(20,0), width int, unary binary, rest binary, runs binary, "
         "ids binary")


def encoder(owners: int):
    """Rows ``(doc_id, fp)`` to one coded row per chunk and owner; ids stay beside their codes."""

    def code(chunk: str, ids: np.ndarray, prints: np.ndarray):
        order = np.lexsort((ids, prints))
        ids, prints = ids[order], prints[order]
        values, first, runs = np.unique(prints, return_index=True, return_counts=True)
        owner = (((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for at, end in zip(cuts, [*cuts[1:], len(values)], strict=True):
            start = values[at]
            width, unary, rest = golomb_encode(values[at:end] - start)
            begin = first[at]
            yield {"chunk": chunk, "owner": int(owner[at]), "n": int(end - at), "start": int(start), "width": width,
                   "unary": unary, "rest": rest, "runs": runs[at:end].astype(np.int32).tobytes(),
                   "ids": ids[begin:begin + int(runs[at:end].sum())].tobytes()}

    def run(batches):
        part, held, rows, number = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            ids = np.concatenate([b[0] for b in held])
            prints = np.concatenate([b[1] for b in held]).view(np.uint64)
            return pd.DataFrame(list(code(f"{part}-{number}", ids, prints)))

        for frame in batches:
            held.append((frame["doc_id"].to_numpy(np.int64), frame["fp"].to_numpy(np.int64)))
            rows += len(frame)
            if rows >= CHUNK_ROWS:
                yield flush()
                held, rows, number = [], 0, number + 1
        if rows:
            yield flush()

    return run


def answer(frame: pd.DataFrame) -> pd.DataFrame:
    """An owner's part: one bitmap per chunk over its codes, set where another chunk has the same fingerprint."""
    parts = [golomb_decode(n, w, u, r) + np.uint64(int(s)) for n, w, u, r, s in
             zip(frame["n"], frame["width"], frame["unary"], frame["rest"], frame["start"], strict=True)]
    values = np.concatenate(parts)
    _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    again = counts[place] > 1
    ends = np.cumsum([len(p) for p in parts])
    maps = [np.packbits(again[e - len(p):e]).tobytes() for p, e in zip(parts, ends, strict=True)]
    return pd.DataFrame({"chunk": frame["chunk"], "owner": frame["owner"], "bitmap": maps})


def expand(batches):
    """Ids of the rows that the bitmap or their own chunk marks."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            runs = np.frombuffer(row["runs"], dtype=np.int32)
            again = np.unpackbits(np.frombuffer(row["bitmap"], dtype=np.uint8))[: len(runs)].astype(bool) | (runs > 1)
            found.append(np.frombuffer(row["ids"], dtype=np.int64)[np.repeat(again, runs)])
        ids = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["doc_id"])


def suspects(docs: DataFrame) -> DataFrame:
    """Distinct ids whose fingerprint occurs more than once."""
    prints = docs.select(F.col("doc_id").cast("long"), F.xxhash64(lower_ascii(F.col("text"))).alias("fp")).filter("doc_id is not null")
    owners = max(FEWEST_OWNERS, -(-docs.count() // OWNER_ROWS))
    coded = stored(prints.mapInPandas(giving_back(encoder(owners)), CODED), "golomb")
    maps = coded.select("chunk", "owner", "n", "start", "width", "unary", "rest").groupBy("owner").applyInPandas(
        answer, "chunk string, owner long, bitmap binary")
    marked = coded.select("chunk", "owner", "runs", "ids").join(maps, ["chunk", "owner"])
    return stored(marked.select("runs", "ids", "bitmap").mapInArrow(giving_back(expand), "doc_id long").distinct(), "suspects")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after A-Z are lower-cased; NULL counts as the empty text, and empty texts are
    copies of each other. Of equal texts the largest doc_id stays (a tie is the same id). A repeated row is one more row
    of its group and carries the same flag; a row without doc_id is kept if no other row has its text. Extra columns are ignored; no rows give no rows.
    """
    suspect = suspects(docs)
    normal = lower_ascii(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal.alias("bytes"))
    named = join_small(rows.filter("doc_id is not null"), suspect, ["doc_id"], "left_semi")
    # Grouping by the bytes themselves verifies the fingerprints; copies meet before the shuffle first.
    groups = named.union(rows.filter("doc_id is null")).groupBy("bytes").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select(
        F.sha2("bytes", 256).alias("text_sha256"), F.xxhash64("bytes").alias("fp"), "keep_id", "group_size").filter("group_size > 1")
    all_rows = rows.select("doc_id", F.sha2("bytes", 256).alias("text_sha256"), F.xxhash64("bytes").alias("fp"))
    joined = all_rows.join(groups, ["text_sha256", "fp"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                         keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


#: Digests of texts that may be broadcast: some 30 MB once hashed.
COPIED = 200_000


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each text, all columns as they are: of equal texts (but for A-Z) the row with the largest
    doc_id, one without doc_id only where no other has the text, and one row of those that repeat. A row is judged by its
    text alone: others that share its doc_id, or lack one too, do not matter."""
    copied = stored(exact_dedup(docs).filter("group_size > 1").select(F.col("text_sha256").alias("__sha")).distinct(), "copied")
    rows = docs.withColumn("__sha", F.sha2(lower_ascii(F.col("text")), 256))
    kept = join_small(rows, copied, ["__sha"], "left_semi", COPIED).groupBy("__sha").agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct("doc_id", "text")).alias("kept"))
    return join_small(rows, copied, ["__sha"], "left_anti", COPIED).select(*docs.columns).unionByName(kept.select("kept.*"))
