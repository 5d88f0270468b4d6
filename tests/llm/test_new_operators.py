"""Winnowing, source divergence and whitening: the queries against their SQL, awkward tables against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import divergence, packed_terms, whitening, winnowing

DOCS = "doc_id long, text string, lang string, source string, w string, k1 string, start string, item_id string, term string, n long"
LOWER = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
PASSAGE = "the quick brown fox jumps over the lazy dog near a river bank in May"


def pad(rows):
    return [(*r, "w", "k", "s", "i", "t", 1) for r in rows]


def prose(n, seed, pool=400):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(pool)) for _ in range(n))


TEXTS = [
    (0, None, None, None), (1, "", "en", "a"), (2, " .,\n", "en", "b"), (3, f"Before {PASSAGE.upper()} after", "en", "a"),
    (4, PASSAGE, "en", "c"), (4, PASSAGE, "en", "c"), (4, "other text", "en", "a"), (None, f"x {PASSAGE}", None, "a"),
    (5, "x" * 30000, "en", "a"), (6, " ".join([PASSAGE] * 200), "de", "a"), (7, prose(9000, 3) + " " + PASSAGE[4:], "en", ""),
    (8, "one two", "en", "b"), (9, "漢字 Ärger 🎉 one, TWO! é", "de", None), (10, "one", "en", "b"), (11, "a " * 500, "en", "b"),
    *[(20 + i, PASSAGE if i % 3 == 0 else prose(300, i % 5, 20), "en" if i % 4 else "de", f"s{i % 7}") for i in range(60)],
]
ITEMS = [("q1", PASSAGE), ("q1", PASSAGE), ("q2", PASSAGE + " and more of it"), ("q10", "one Two"), ("q3", None), ("q4", ""), (None, "after"),
         ("q5", "one"), ("q6", "a a a a a a a"), ("q7", "a a a"), ("q8", prose(40, 3)), ("q9", "漢字 ärger"), ("q11", " ".join("abcdefghi"))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(pad(TEXTS), DOCS).repartition(4).cache()


def plain_hits(items, text):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    held = collections.defaultdict(set)
    for item, t in items:
        w = find(LOWER(t))
        m = min(len(w), 10)
        for i in range(len(w) - m + 1 if m else 0):
            held[tuple(w[i:i + m])].add(item)
    w, hit, found = find(LOWER(text)), set(), set()
    for m in {len(k) for k in held}:
        for i in range(len(w) - m + 1):
            if tuple(w[i:i + m]) in held:
                hit.update(range(i, i + m))
                found |= held[tuple(w[i:i + m])]
    return len(w), tuple(sorted(hit)), tuple(sorted(i for i in found if i is not None))


def test_winnowing_equals_every_window_compared(spark, docs):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id string, text string, key string, hash long")
    got = collections.Counter()
    for r in winnowing.contaminated(docs, items).collect():
        hit = tuple(p for s in r["spans"] for p in range(s["start"], s["end"]))
        got[(r["doc_id"], r["n_words"], hit, tuple(r["items"]))] += 1
    assert got == collections.Counter((i, *plain_hits(ITEMS, t)) for i, t, _, _ in TEXTS)


@pytest.mark.parametrize("length", [1, 2, 3, 7, 16])
def test_winnowing_at_other_lengths_keeps_the_guarantee(spark, length):
    rng = random.Random(length)
    texts = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(60)]
    items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randrange(25)))) for i in range(12)]
    find = {}
    for item, t in items:
        w = t.split()
        m = min(length, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            find.setdefault(tuple(w[i:i + m]), set()).add(item)
    found = winnowing.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), length)
    got = {r["doc_id"]: (sorted(p for s in r["spans"] for p in range(s["start"], s["end"])), r["items"]) for r in found.collect()}
    for i, t in texts:
        w, hit, held = t.split(), set(), set()
        for key, owners in find.items():
            for at in range(len(w) - len(key) + 1):
                if tuple(w[at:at + len(key)]) == key:
                    hit.update(range(at, at + len(key)))
                    held |= owners
        assert got[i] == (sorted(hit), sorted(held))


def test_winnowing_without_items_or_documents(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert winnowing.contaminated(docs, empty).filter("size(spans) > 0 OR size(items) > 0").count() == 0
    assert winnowing.contaminated(docs, empty).count() == len(TEXTS)
    assert winnowing.contaminated(docs.limit(0), spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")).count() == 0


def test_winnowing_without_broadcasts(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    want = sorted(map(repr, winnowing.contaminated(docs, items).collect()))
    monkeypatch.setattr(winnowing, "FEW", -1)
    assert sorted(map(repr, winnowing.contaminated(docs, items).collect())) == want


@pytest.mark.parametrize("name", ["op11_benchmark_winnowing", "op12_source_divergence"])
def test_queries_equal_sql(same, name):
    assert same(name) > 0


@pytest.mark.parametrize("name", ["op11_benchmark_winnowing", "op12_source_divergence"])
def test_queries_equal_sql_on_awkward_rows(spark, docs, same, tmp_path, name):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert same(name, str(tmp_path)) > 0


def plain_terms(texts, groups):
    n, held = collections.Counter(), collections.Counter()
    for t, g in zip(texts, groups):
        found = collections.Counter(re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)))
        for term, times in found.items():
            n[(g, term)] += times
            held[(g, term)] += 1
    return {k: (n[k], held[k]) for k in n}


@pytest.mark.parametrize("run_bytes", [7, 64, 5000, 1 << 20])
def test_packed_terms_equal_a_counter(run_bytes):
    import pyarrow as pa

    rng = random.Random(run_bytes)
    letters = [b"a", b"b", b"Z", "é".encode(), "漢".encode(), b"z" * 15]
    texts = [b"", b" ", b"1 2", b"A" * 9000, b"abcdefgh abcdefgh abcdefghi ABCDEFGHI", "é漢字".encode() * 50] + [
        b" ".join(b"".join(rng.choices(letters, k=rng.randrange(1, 14))) for _ in range(rng.randrange(40))) for _ in range(80)] + [b""]
    groups = [rng.randrange(3) + 70000 * rng.randrange(2) for _ in texts]
    got = collections.defaultdict(lambda: (0, 0))
    for g, terms, n, held in packed_terms.batch_tables(pa.array(texts, pa.binary()).slice(0), np.array(groups), run_bytes):
        for key in zip(g.tolist(), terms.to_pylist(), n.tolist(), held.tolist()):
            was = got[key[:2]]
            got[key[:2]] = (was[0] + key[2], was[1] + key[3])
    assert dict(got) == plain_terms(texts, groups)


def test_divergence_in_many_blocks_and_stripes(spark, docs, monkeypatch):
    want = sorted(map(tuple, divergence.source_divergence(docs).collect()))
    monkeypatch.setattr(divergence, "CELLS", 16)
    monkeypatch.setattr(divergence, "STRIPE", 2)
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == want


def test_divergence_of_nothing(spark, docs):
    assert divergence.source_divergence(docs.limit(0)).count() == 0
    found = divergence.source_divergence(docs.filter("doc_id IN (1, 2) OR doc_id IS NULL")).collect()
    assert sorted((r["lang"], r["source"], r["item"], r["value"], r["rank"]) for r in found) == [("en", "a", "b", 0, 1), ("en", "b", "a", 0, 1)]


def test_shares_in_long_division_are_exact():
    counts = np.array([[0, 7, 10**13, 3 * 10**15]])
    total, terms = 4 * 10**15, 11
    want = [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts[0]]
    assert divergence.shares(counts, np.array([[total]]), terms)[0].tolist() == want


VECTORS = "vec_id long, embedding array<float>, label int, x string, c string, dims int"


def dense(rows, wanted=16):
    """Distinct scaled vectors and the plain eigenvectors of their covariance."""
    x = np.floor(64 * np.array(rows, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    own = np.unique(x, axis=0)
    n, s = len(own), own.sum(axis=0)
    c = (n * own - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    held = min(wanted, int((e > 1e-12 * e.sum()).sum()))
    return x, n, s, e, q[:, :held], ((n * x - s) / n) @ q[:, :held] / np.sqrt(e[:held])


def whitened_rows(spark, rows):
    found = whitening.whitened(spark.createDataFrame([(i, r, 1, "x", "c", 0) for i, r in rows], VECTORS).repartition(3)).collect()
    return collections.Counter((r["vec_id"], r["component"]) for r in found), found


@pytest.mark.parametrize("dims,count,scale", [(3, 200, 1.0), (64, 400, 1.0), (64, 30, 1.0), (90, 500, 0.2), (64, 500, 3000.0)])
def test_whitening_equals_a_dense_eigen_decomposition(spark, dims, count, scale):
    rng = np.random.default_rng(dims + count)
    rows = (rng.standard_normal((count, dims)) * scale * np.linspace(1, 3, dims)).astype(np.float32)
    rows[count // 2:count // 2 + 5] = rows[0]
    _, found = whitened_rows(spark, list(enumerate(rows.tolist())))
    x, n, s, e, q, want = dense(rows)
    assert len(found) == count * want.shape[1]
    got = np.zeros(want.shape)
    for r in found:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-9)
        assert r["deviation"] == sum((n * int(v) - int(t)) ** 2 for v, t in zip(x[r["vec_id"]], s))
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-7


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, v) for i, v in enumerate(rng.standard_normal((40, 5)).tolist())]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 0.0, 0.0]), (103, [1.0, float("nan"), 0.0, 0.0, 0.0]),
           (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (0, good[0][1]), (None, good[1][1])]
    counts, found = whitened_rows(spark, good + odd)
    assert counts == collections.Counter({(i, c): 2 if i == 0 else 1 for i in [*range(40), None] for c in range(1, 6)})
    assert {r["n"] for r in found} == {40}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_whitening_without_variation(spark, rows):
    assert whitened_rows(spark, rows)[1] == []


def test_whitening_of_huge_entries_and_equal_eigenvalues(spark):
    rows = [(i, [3e15 if j == i else 0.0 for j in range(6)]) for i in range(6)]
    _, found = whitened_rows(spark, rows)
    assert len(found) == 6 * 5 and {r["identity_error"] < 1e-9 for r in found} == {True}
    assert {r["deviation"] for r in found} == {None}


def test_whitening_adds_up_on_spark_where_sums_are_many(spark, monkeypatch):
    rows = list(enumerate(np.random.default_rng(5).standard_normal((60, 8)).tolist()))
    want = {(r["vec_id"], r["component"]): r["whitened"] for r in whitened_rows(spark, rows)[1]}
    monkeypatch.setattr(whitening, "GATHERED", 0)
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in whitened_rows(spark, rows)[1]}
    for c in range(1, 9):
        sign = np.sign(sum(got[(i, c)] * want[(i, c)] for i in range(60)))
        assert all(abs(got[(i, c)] * sign - want[(i, c)]) < 1e-9 for i in range(60))
