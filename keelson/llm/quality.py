"""Quality by naive-Bayes support vectors: indicators scaled by class log-count ratios, hinge loss by dual coordinates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.linear import Rows, fit_hinge, folds, gram_features, labelled_sample, margins, platt, scored, sigmoid, sums

BUCKETS = 1 << 18
#: Labelled rows that the model is fitted on; it scores all rows.
TRAIN_ROWS = 6_000
FEWEST, EPOCHS = 2, 12


class Model:
    def __init__(self, sets: list[np.ndarray], y: np.ndarray) -> None:
        rows = Rows(sets, BUCKETS, FEWEST)
        y = y.astype(float)
        self.used, self.share, self.weights = rows.used, float(y.mean()) if len(y) else 0.5, None
        if len(set(y.tolist())) < 2:
            return
        everyone, fold, out = np.arange(len(sets)), folds(len(sets)), np.zeros(len(sets))
        for f in range(5):
            held = everyone[fold == f]
            if len(held):
                weights, rest = fit_hinge(rows, everyone[fold != f], y, epochs=EPOCHS)
                out[held] = margins(rows, held, weights, rest)
        self.slope, self.offset = platt(out, y)
        self.weights, rest = fit_hinge(rows, everyone, y, epochs=EPOCHS)
        self.constant = rest[-1]

    def scorer(self):
        model, tables = self, []

        def finish(sets):
            if model.weights is None:
                return {"score": np.full(len(sets), model.share)}
            if not tables:
                table = np.zeros(BUCKETS)
                table[model.used] = model.weights
                tables.append(table)
            return {"score": sigmoid(model.slope * (sums(tables[0], sets) + model.constant) + model.offset)}

        return finish


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Labels are learnt from rows whose crc32 of doc_id as text leaves a remainder other than 0 by 5. Only the text is an
    input: three-byte grams, runs of equal words, and whether there are words at all. NULL counts as empty, empty texts
    are scored too; repeated rows are scored alike; a row without doc_id counts as not held out and is never learnt from. Without labels, or with one
    class, the score is the share of label 1 (0.5 without any). Extra columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    features, hasher = gram_features(BUCKETS)
    sets, y = labelled_sample(docs, labels.filter(~held).select("doc_id", F.col("quality")), ["quality"], features, hasher, most_rows)
    model = Model(sets, y[:, 0])
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"))
    out = scored(rows, features, hasher, model.scorer(), "doc_id long, held_out boolean, score double", ["doc_id", "held_out"])
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
