"""Tokens per text under a unigram model, scored once per shared prefix of the pre-tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.pieces import UNITS, Viterbi, Vocabulary

#: Pre-tokens that are worked on together.
TOGETHER = 200_000
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_units (pre-tokens), n_tokens (pieces of the best segmentations).

    NULL and empty texts have 0 of both. Rows are independent, repeated ones too; extra columns are ignored. Each task
    holds one trie of bounded size, and texts stay where they are read: there is no shuffle.
    """
    vocabulary = Vocabulary(path)

    def run(batches):
        trie = Viterbi(vocabulary)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                units, begin, many = [], at, 0
                while at < batch.num_rows and many < TOGETHER:
                    units.append(UNITS.findall(batch.column(1)[at].as_py() or ""))
                    many, at = many + len(units[-1]), at + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, at - begin), pa.array([len(u) for u in units], pa.int64()), pa.array(trie.counts(units), pa.int64())],
                    names=["doc_id", "n_units", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_units long, n_tokens long")
