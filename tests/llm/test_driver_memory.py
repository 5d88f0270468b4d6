"""Fitting on the driver holds the sample, not several copies of it spread out, and leaves nothing behind."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import DataFrame

import corpus_pipeline
from keelson.llm.linear import Rows, gram_features, labelled_sample, margins, ratios

BUCKETS = 1 << 16


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, BUCKETS, rng.integers(0, 1200))).astype(np.int32) for _ in range(4000)]
    return [*sets, np.empty(0, np.int32)], np.append(rng.integers(0, 2, 4000), 1).astype(float)


def test_fit_gives_the_plain_sums(sample):
    sets, y = sample
    rows, chosen = Rows(sets, BUCKETS, 30), np.arange(len(sets))[::2]
    seen = np.bincount(np.concatenate(sets), minlength=BUCKETS)
    assert (rows.used == np.flatnonzero(seen >= 30)).all()
    has = np.zeros((len(sets), rows.width))
    for k, s in enumerate(sets):
        has[k, np.flatnonzero(np.isin(rows.used, s))] = 1
    good, bad = has[chosen][y[chosen] == 1].sum(0) + 1, has[chosen][y[chosen] == 0].sum(0) + 1
    assert np.allclose(ratios(rows, chosen, y), np.log(good / good.sum()) - np.log(bad / bad.sum()), rtol=1e-12)
    weights = np.random.default_rng(6).normal(size=rows.width)
    assert np.allclose(margins(rows, chosen, weights, np.array([0.25])), has[chosen] @ weights + 0.25, rtol=1e-9)


def test_fit_spreads_out_a_part_of_the_sample_at_a_time(sample):
    sets, y = sample
    whole, everyone = sum(s.nbytes for s in sets), np.arange(len(sets))
    rows = Rows(sets, BUCKETS, 1)
    tracemalloc.start()
    try:
        ratios(rows, everyone, y)
        margins(rows, everyone, np.ones(rows.width), np.array([0.0]))
        assert tracemalloc.get_traced_memory()[1] < whole
    finally:
        tracemalloc.stop()


def test_sample_is_not_collected_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"words of text {k}") for k in range(300)] + [(None, "none"), (7, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 200)], "doc_id long, quality int")

    def never(self):
        raise AssertionError("collected")

    monkeypatch.setattr(DataFrame, "collect", never)
    monkeypatch.setattr(type(docs), "collect", never)
    features, hasher = gram_features(BUCKETS)
    sets, y = labelled_sample(docs, labels, ["quality"], features, hasher, 1000)
    assert len(sets) == 201 and y[:9, 0].tolist() == [0, 1, 0, 1, 0, 1, 0, 1, 1]
    assert len(labelled_sample(docs, labels, ["quality"], features, hasher, 50)[0]) == 50


def test_stages_hand_the_drivers_memory_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "release", lambda: calls.append(1), raising=False)
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    corpus_pipeline.lean(lambda spark, docs, sf_dir: docs)(spark, docs, "")
    assert calls
