"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.llm import (
    divergence, exact_dedup, mixing, near_vectors, ngram_join, pii, quality, secrets, sentencepieces, spans, token_counts, toxicity, whitening,
    winnowing)
from keelson.llm.common import table


def op1_vector_near_duplicates(spark, sf_dir):
    return near_vectors.vector_classes(table(spark, sf_dir, "embeddings"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"), n=3, num=9, den=10).select(
        "doc_id", "n_shingles", "component_id", "n_links")


def op3_secret_battery(spark, sf_dir):
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[spans.count_kind(F.col("base"), k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
                        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_private_terms(spark, sf_dir):
    found = pii.private_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[spans.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS[:4]],
                        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


def op6_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_quality_nbsvm(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, docs, table(spark, sf_dir, "labels"))


def op9_exact_duplicates(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_sampled_pieces(spark, sf_dir):
    both = sentencepieces.round_trip(table(spark, sf_dir, "documents"))
    return both.select("doc_id", F.size("ids").alias("n_pieces"), "ids", F.sha2("text", 256).alias("text_sha256"), "lossless")


def op11_benchmark_winnowing(spark, sf_dir):
    found = winnowing.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = found.withColumn("n_hit", winnowing.hit_words(F.col("spans")))
    return hit.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_chebyshev_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_vector_near_duplicates, op2_ngram_jaccard_join, op3_secret_battery, op4_token_counts, op5_private_terms, op6_source_mix,
    op7_quality_nbsvm, op8_toxicity_chain, op9_exact_duplicates, op10_sampled_pieces,
    op11_benchmark_winnowing, op12_source_divergence, op13_chebyshev_whitening)}

_COMPONENTS = """
reach(node, seen) AS (SELECT a, a FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""

SQL = {
    "op1_vector_near_duplicates": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
    AND list_sum(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
          AND list_cosine_similarity(p.e, q.e) >= 0.93),{_COMPONENTS}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
       coalesce(least.component_id, e.vec_id) AS component_id, coalesce(least.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least ON least.node = e.vec_id""",
    "op2_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id
          GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),{_COMPONENTS}
SELECT d.doc_id, len(s)::BIGINT AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id,
       (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links
FROM sets d LEFT JOIN least ON least.node = d.doc_id""",
    "op9_exact_duplicates": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)""",
    "op11_benchmark_winnowing": r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS key FROM (
  SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT id, m, i, array_to_string(w[i:i + m - 1], ' ') AS key FROM (
  SELECT id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM windows))),
hits AS (SELECT id, p.m, i, item_id FROM places p JOIN windows USING (m, key)),
covered AS (SELECT id, count(DISTINCT spot) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS spot FROM hits) GROUP BY id),
held AS (SELECT id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id)) AS items FROM hits GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (id) LEFT JOIN held USING (id)""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tokens AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
used AS (SELECT lang, source, term, count(*) AS n, any_value(lang_n) AS lang_n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
totals AS (SELECT g.lang, g.source, coalesce(sum(u.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN used u USING (lang, source) GROUP BY g.lang, g.source),
shares AS (SELECT t.lang, t.source, k.term, coalesce(u.n, 0) AS n,
  1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)) // (t.total + 2 * l.v)::HUGEINT AS p,
  1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.lang_total + 2 * l.v)::HUGEINT AS q
  FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN used u ON u.lang = t.lang AND u.source = t.source AND u.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
leaning AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
both_parts AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM leaning),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, encode(item))::INTEGER AS rank FROM both_parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
