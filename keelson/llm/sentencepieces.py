"""Sampled segmentation into pieces, reproducible per row, and its lossless decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import giving_back
from keelson.llm.pieces import MOST_NODES, UNITS, Decoder, Sampler, Vocabulary, spell
from keelson.llm.token_counts import VOCABULARY

#: Pre-tokens that are sampled together: their draws and pieces are held at once.
TOGETHER = 50_000
KEY = "doc_id long, ids array<int>"


def encoder(vocabulary: Vocabulary, decoded: bool = False):
    def run(batches):
        trie, decoder = Sampler(vocabulary), Decoder(vocabulary) if decoded else None
        for batch in batches:
            texts, seeds = batch.column("text"), batch.column("_seed").to_numpy().view(np.uint64)
            at = 0
            while at < len(texts):
                if trie.size > MOST_NODES:
                    trie.clear()
                units, sizes, begin = [], [], at
                while at < len(texts) and len(units) < TOGETHER:
                    found = UNITS.findall(texts[at].as_py() or "")
                    units.extend(found)
                    sizes.append(len(found))
                    at += 1
                trie.grow(set(units).difference(trie.known))
                nodes = np.fromiter(map(trie.known.__getitem__, units), dtype=np.int64, count=len(units))
                counts = np.array(sizes, dtype=np.int64)
                firsts = np.cumsum(counts) - counts
                places = np.arange(len(nodes)) - np.repeat(firsts, counts)
                pieces, lengths = trie.sample(nodes, np.repeat(seeds[begin:at], counts), places)
                ids, spelt = spell(pieces, vocabulary.bytes)
                # Ends of the texts, from pre-tokens to pieces to ids.
                by_piece = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
                ends = np.concatenate([[0], np.cumsum(spelt)])[by_piece].astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
                columns = {n: batch.column(n).slice(begin, at - begin) for n in batch.schema.names if n not in ("text", "_seed")}
                columns["ids"] = out
                if decoded:
                    columns["text"] = decoder.texts(out)
                    columns["lossless"] = pc.equal(columns["text"], pc.fill_null(texts.slice(begin, at - begin), ""))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def seeded(docs: DataFrame, seed: int) -> DataFrame:
    row_seed = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_seed.alias("_seed"))


def encode(docs: DataFrame, path: str = VOCABULARY, seed: int = 42) -> DataFrame:
    """Per row: doc_id and ids, a segmentation drawn from all those of the text by their probability.

    The draw depends on ``seed``, doc_id and the text, so a rerun gives the same ids on any number of partitions, and
    repeated rows are encoded alike. NULL and empty texts have no ids; a NULL doc_id is a key like others. Extra columns are ignored.
    """
    return seeded(docs, seed).mapInArrow(giving_back(encoder(Vocabulary(path))), KEY)


def round_trip(docs: DataFrame, path: str = VOCABULARY, seed: int = 42) -> DataFrame:
    """Per row: doc_id and ids as ``encode`` gives them, text as decoded from the ids alone, and lossless: whether that is
    the row's text, byte for byte. NULL counts as empty. Encoding and decoding share a task's pass over its rows.
    """
    return seeded(docs, seed).mapInArrow(giving_back(encoder(Vocabulary(path), decoded=True)), f"{KEY}, text string, lossless boolean")


def decode_rows(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per row ``(doc_id, ids)``: doc_id, text. The text is the one that was encoded, NULL as empty; NULL ids give an
    empty text. Ids that no text was encoded to give the bytes of their pieces. Extra columns are ignored."""
    vocabulary = Vocabulary(path)

    def run(batches):
        decoder = Decoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), decoder.texts(batch.column(1))], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        giving_back(run), "doc_id long, text string")
