"""Toxicity by a chain of classifiers: each category's linear model also sees the probabilities of those before it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.linear import Rows, fit_hinge, folds, labelled_sample, margins, platt, scored, sigmoid, sums, word_features

BUCKETS = 1 << 21
#: Labelled rows that a model is fitted on; it scores all rows.
TRAIN_ROWS = 8_000
#: A feature must be in so many rows, and tell the classes apart by so much chi-squared.
FEWEST, LEAST, EPOCHS = 3, 8.0, 10


class Chain:
    """Fitted links: per category the features' weights, those of earlier probabilities, slope, offset and threshold.

    A later link is trained on out-of-fold probabilities of the earlier ones, so that it sees them as unsure as they will
    be on new rows. A category with one class only gets the share of that class as its probability.
    """

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, categories: list[str]) -> None:
        self.categories, self.links = categories, []
        rows = Rows(sets, BUCKETS, FEWEST)
        self.used = rows.used
        everyone, fold = np.arange(len(sets)), folds(len(sets))
        earlier = np.zeros((len(sets), 0))
        for k in range(len(categories)):
            y = labels[:, k].astype(float)
            if len(set(y.tolist())) < 2:
                share = float(y.mean()) if len(y) else 0.0
                self.links.append((None, None, share, 0.0, 0.5))
                earlier = np.column_stack([earlier, np.full(len(sets), share)])
                continue
            out = np.zeros(len(sets))
            for f in range(5):
                there, held = everyone[fold != f], everyone[fold == f]
                if len(held):
                    out[held] = margins(rows, held, *fit_hinge(rows, there, y, earlier, LEAST, EPOCHS), earlier)
            slope, offset = platt(out, y)
            weights, rest = fit_hinge(rows, everyone, y, earlier, LEAST, EPOCHS)
            chance = sigmoid(slope * out + offset)
            # The threshold with the best F1 among out-of-fold probabilities; ties go to the highest.
            order = np.argsort(-chance, kind="stable")
            hits = np.cumsum(y[order])
            f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
            best = int(np.argmax(f1))
            below = chance[order[best + 1]] if best + 1 < len(order) else 0.0
            self.links.append((weights, rest, slope, offset, float((chance[order[best]] + below) / 2)))
            earlier = np.column_stack([earlier, chance])

    def scorer(self):
        links, used, categories = self.links, self.used, self.categories

        def finish_for():
            tables = {}

            def finish(sets):
                out, earlier = {}, np.zeros((len(sets), 0))
                for k, (own, rest, slope, offset, threshold) in enumerate(links):
                    if own is None:
                        chance = np.full(len(sets), slope)
                    else:
                        if k not in tables:
                            tables[k] = np.zeros(BUCKETS, dtype=np.float32)
                            tables[k][used] = own
                        chance = sigmoid(slope * (sums(tables[k], sets) + earlier @ rest[:-1] + rest[-1]) + offset)
                    earlier = np.column_stack([earlier, chance])
                    out[f"p_{categories[k]}"] = chance
                    out[f"is_{categories[k]}"] = chance >= threshold
                return out

            return finish

        return finish_for()


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], most_rows: int = TRAIN_ROWS) -> Chain:
    """``categories`` maps each name, in the order of the chain, to an SQL condition over the columns of ``labels``."""
    marked = labels.select("doc_id", *[F.expr(c).cast("int").alias(n) for n, c in categories.items()])
    features, hasher = word_features(BUCKETS)
    sets, y = labelled_sample(docs, marked, list(categories), features, hasher, most_rows)
    return Chain(sets, y, list(categories))


#: The labels tell poor texts from others and toxic ones from others; the second link sees the first one's probability.
CATEGORIES = {"poor": "quality = 0", "toxic": "toxic = 1"}


def toxicity(docs: DataFrame, train: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES,
             most_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: the columns to keep, and ``p_<category>`` and ``is_<category>`` for each category.

    The chain is fitted on the labelled rows of ``train``. NULL and empty texts are scored by the constants alone; the
    last category is never set for a text without words. Rows are scored one by one, repeated ones alike. Without
    labelled rows all probabilities are 0 and nothing is set. Other columns may bear any name.
    """
    chain = fit_chain(train, labels, categories, most_rows)
    features, hasher = word_features(BUCKETS)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"p_{c} double, is_{c} boolean" for c in categories])
    out = scored(docs, features, hasher, chain.scorer(), schema, list(keep))
    return out


def drop_toxic(docs: DataFrame, train: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the chain's last category does not reject, all columns as they are."""
    last = list(options.get("categories", CATEGORIES))[-1]
    verdict = toxicity(docs, train, labels, keep=tuple(c for c in docs.columns), **options)
    return verdict.filter(~F.col(f"is_{last}") | F.coalesce(F.trim("text"), F.lit("")).eqNullSafe("")).select(*docs.columns)
