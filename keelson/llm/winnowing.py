"""Passages of a benchmark in documents, found by winnowing.

A window is a run of ``length`` words (a shorter item is one window of its own). Of the k-grams inside a window the one
with the smallest hash, the leftmost of equals, is the window's fingerprint, k being half the window. Equal windows choose
equal k-grams at equal places, so a shared window always shares its fingerprint: documents whose fingerprints meet none
of the benchmark's hold no window. Where fingerprints meet, the hit is extended to every window around it, and windows
are compared as wholes by SHA-256.

All of it is built of DataFrame functions. Every document row gets a result; rows of equal text share one computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import join_small, lower_ascii, stored
from keelson.llm.spans import once

LENGTH = 10
# Fixed value: what stands between words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The low bits of a k-gram's hash hold its place within the window, so windows have at most so many k-grams.
PLACES = 8
#: Rows of a few numbers and a digest that may be broadcast: at most some 50 MB once hashed.
FEW = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def gram_length(length: int) -> int:
    """Words of the k-grams of a window: half of it, more where the window would hold too many."""
    return max((length + 1) // 2, length + 1 - PLACES)


def fingerprints(row_words: Column, row_hashes: Column, length: int) -> Column:
    """``array<struct<length,hash,place>>``: the k-gram chosen in each window, each place once. No window, no entry."""
    k = gram_length(length)
    span = length - k + 1
    n = F.size(row_words)

    def gram_hashes(hashes: Column) -> Column:
        whole = F.lit(~(PLACES - 1)).cast("long")
        return F.transform(F.sequence(F.lit(0), n - k),
                           lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]).bitwiseAND(whole))

    def chosen(grams: Column) -> Column:
        picks = [lambda i, j=j: F.get(grams, i + j).bitwiseOR(F.lit(j).cast("long")) for j in range(span)]
        least = (lambda i: picks[0](i)) if span == 1 else (lambda i: F.least(*[p(i) for p in picks]))
        places = F.array_distinct(F.transform(
            F.sequence(F.lit(0), n - length), lambda i: i + least(i).bitwiseAND(F.lit(PLACES - 1).cast("long")).cast("int")))
        return F.transform(places, lambda p: F.struct(
            F.lit(length).alias("length"), F.get(grams, p).alias("hash"), p.alias("place")))

    empty = F.array().cast("array<struct<length:int,hash:bigint,place:int>>")
    return F.when(n >= length, once(row_hashes, lambda h: once(gram_hashes(h), chosen))).otherwise(empty)


def window_key(row_words: Column, start: Column, length: Column) -> Column:
    """SHA-256 of a window's words; blanks part them, as no word holds one."""
    return F.unhex(F.sha2(F.array_join(F.slice(row_words, start + 1, length), " "), 256))


def benchmark_windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(length, key, hash, item_id)``: the distinct windows of each item, with the fingerprint each one chooses."""
    held = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    own = F.least(F.size("w"), F.lit(length))
    cut = held.select("item_id", own.alias("length"), F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - own), lambda s: F.slice("w", s + 1, own))).alias("w"))
    keyed = cut.select("item_id", "length", "w", window_key(F.col("w"), F.lit(0), F.col("length")).alias("key"))
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    chosen = None
    for m in range(1, length + 1):  # a window is its own only window, so it has a single fingerprint
        pick = fingerprints(F.col("w"), hashes, m)[0]["hash"]
        chosen = F.when(F.col("length") == m, pick) if chosen is None else chosen.when(F.col("length") == m, pick)
    return keyed.select("length", "key", chosen.alias("hash"), "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document row: doc_id, n_words, ``spans`` (word places, end exclusive, ordered, overlapping ones joined) and
    ``items`` (ids of the items with a window in the text, as strings in order).

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. NULL and empty texts have no
    words and no spans. Rows that repeat, or share a doc_id, each get their own result. An item without words has no
    window; one without item_id marks words and is not listed; rows of one item_id are one item. Without items, or
    without documents, nothing is found. Work and shuffles follow the words (fingerprints) and the hits (windows).
    """
    windows = stored(benchmark_windows(items, length), "benchmark-windows")
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most ``length`` numbers
    low = lower_ascii(F.col("text"))
    keyed = docs.select("doc_id", F.xxhash64(low).alias("k1"), F.xxhash64(F.lit(1), low).alias("k2"), words(F.col("text")).alias("w"))
    hashed = keyed.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    marks = [fingerprints(F.col("w"), F.col("h"), m) for m in sorted(lengths)]
    none = F.array().cast("array<struct<length:int,hash:bigint,place:int>>")
    index = stored(hashed.select("doc_id", "k1", "k2", F.size("w").cast("long").alias("n_words"),
                                 (F.concat(*marks) if marks else none).alias("marks")), "fingerprints")

    met = join_small(index.select("k1", "k2", F.explode("marks").alias("m")).select("k1", "k2", "m.*"),
                     windows.select("length", "hash").distinct(), ["length", "hash"], "left_semi", FEW)
    # Copies of a text meet here once per task, before anything is shuffled.
    places = met.select("k1", "k2", "length", "place").distinct().groupBy("k1", "k2").agg(
        F.collect_list(F.struct("length", "place")).alias("places"))
    places = stored(places, "fingerprint-hits")
    again = docs.select(F.xxhash64(low).alias("k1"), F.xxhash64(F.lit(1), low).alias("k2"), low.alias("text"))
    texts = join_small(again, places.select("k1", "k2"), ["k1", "k2"], "left_semi", FEW).groupBy("k1", "k2").agg(F.min("text").alias("text"))
    around = texts.join(places, ["k1", "k2"]).select("k1", "k2", words(F.col("text")).alias("w"), "places")

    def starts(m: int) -> Column:
        own = F.filter("places", lambda x: x["length"] == m)
        every = F.flatten(F.transform(own, lambda x: F.sequence(
            F.greatest(x["place"] - (m - gram_length(m)), F.lit(0)), F.least(x["place"], F.size("w") - m))))
        return F.transform(F.array_distinct(every), lambda s: F.struct(
            F.lit(m).alias("length"), s.alias("start"), window_key(F.col("w"), s, F.lit(m)).alias("key")))

    nothing = F.array().cast("array<struct<length:int,start:int,key:binary>>")
    candidates = around.select("k1", "k2", F.explode(F.concat(*[starts(m) for m in sorted(lengths)]) if lengths else nothing).alias("c"))
    hits = join_small(candidates.select("k1", "k2", "c.*"), windows.select("length", "key").distinct(), ["length", "key"], "left_semi", FEW)
    hits = stored(hits, "window-hits")

    # Windows held by the same items are one class, so a passage is joined with its items once and not once per window.
    # The signature is of the set of items: a count and two sums of hashes that do not wrap.
    one, two = F.xxhash64("item_id").cast("decimal(38,0)"), F.xxhash64(F.lit(1), "item_id").cast("decimal(38,0)")
    signed = windows.filter("item_id IS NOT NULL").groupBy("length", "key").agg(
        F.count(F.lit(1)).alias("s0"), F.sum(one).alias("s1"), F.sum(two).alias("s2"))
    signed = stored(signed, "window-classes")
    sign = ["s0", "s1", "s2"]
    members = windows.filter("item_id IS NOT NULL").join(signed, ["length", "key"]).select(*sign, "item_id").distinct()
    classes = join_small(hits, signed, ["length", "key"], "inner", FEW).select("k1", "k2", *sign).distinct()
    named = classes.join(members, sign).select("k1", "k2", "item_id").distinct().groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list("item_id")).alias("items"))
    spans = joined_spans(hits)
    found = stored(spans.join(named, ["k1", "k2"], "left"), "contaminated")
    no_items, no_spans = F.array().cast("array<string>"), F.array().cast(spans.schema["spans"].dataType)
    return join_small(index.drop("marks"), found, ["k1", "k2"], "left", FEW // 4).select(
        "doc_id", "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items"))


def joined_spans(hits: DataFrame) -> DataFrame:
    """``(k1, k2, spans)``: the windows of each text, ordered, with those that overlap or touch joined."""
    text = Window.partitionBy("k1", "k2").orderBy("start", "end")
    ends = hits.select("k1", "k2", "start", (F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    opened = ends.withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = opened.withColumn("span", F.sum("opens").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("k1", "k2", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def hit_words(spans: Column) -> Column:
    """Words inside any of the joined spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
