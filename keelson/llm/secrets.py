"""Secrets in texts: known forms, and strings that a battery of randomness tests cannot tell from noise."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import stored
from keelson.llm.spans import by_start, matches, of_kind, once

KINDS = ("assign", "access", "hex", "random")
# The forms of known secrets.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
ASSIGNED = 12
#: Strings that are tested: whole runs of these characters.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: The same characters one by one: a class without ranges is looked up, not compared.
SINGLY = string.ascii_letters + string.digits + "+/_=-"
#: Alphabets that an encoding is inferred from, the narrowest first: name, pattern, characters.
ALPHABETS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("letters", "^[a-z]+$", string.ascii_lowercase),
    ("letters", "^[A-Z]+$", string.ascii_uppercase),
    ("base32", "^[A-Z2-7]+=*$", string.ascii_uppercase + "234567"),
    ("base36", "^[0-9a-z]+$", string.digits + string.ascii_lowercase),
    ("letters", "^[A-Za-z]+$", string.ascii_letters),
    ("base64", "^[A-Za-z0-9+/_=-]+$", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
)
#: Letters of one case agree with their narrow alphabet better than other text does: they are held against their like.
ONE_CASE = "^([a-z]+|[A-Z]+)$"
#: Fewest characters of a string that is tested.
LEAST = 20
BANDS = (24, 32, 48, 96)
#: Lengths of the strings that ordinary text is cut into, one for each band; the shorter ones also take what is left.
PROSE = (22, 28, 40, 64, 128)
CUT = "(.{22})(.{28})?(.{40})?(.{64})?(.{128})?"
BINS = 50


def normal_tail(z: Column) -> Column:
    """Chance of a standard normal beyond ``z``; error below 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def agreement(e: Column) -> Column:
    """Fisher's combination of three chances, given the sum of their negative logarithms."""
    return F.exp(-e) * (1 + e + e * e / 2)


def battery(text: Column, alphabet: Column) -> Column:
    """How well a string agrees with random draws from an alphabet: Fisher's combination of three chances.

    Chi-squared of the characters against equal shares, number of runs above and below the middle, and correlation of
    neighbours. All depend on the string's length. Each chance can only lower the agreement, so a string that is in the
    lowest bin after one or two of them is not tested further.
    """
    lowest = lambda e: agreement(e) * BINS < 0.99
    floor = lambda p: F.greatest(p, F.lit(1e-12))
    without = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))

    def same_characters(s: Column) -> Column:
        equal = F.regexp_extract_all(F.array_join(F.sort_array(F.split(s, "")), ""), F.lit(r"(.)\1*"), F.lit(0))
        return F.aggregate(equal, F.lit(0), lambda acc, c: acc + F.length(c) * F.length(c))

    def order(e: Column, s: Column, letters: Column, n: Column, k: Column) -> Column:
        half = F.floor(k / 2).cast("int")
        bits = F.call_function("translate", s, letters, F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), (k - half).cast("int"))))

        def runs(bits: Column) -> Column:
            def chance(n1: Column) -> Column:
                mean = 2 * n1 * (n - n1) / n + 1
                changes = (without(bits, F.lit("01")) + without(bits, F.lit("10"))) / 2
                return once(mean, lambda m: once((m - 1) * (m - 2) / (n - 1), lambda var: F.when(
                    var > 1e-9, 2 * once(F.abs((changes + 1 - m) / F.sqrt(var)), normal_tail)).otherwise(0.0)))

            return once(without(bits, F.lit("1")), chance)

        def serial() -> Column:
            return once(F.transform(F.split(s, ""), lambda c: (F.instr(letters, c) - 1).cast("double")), neighbours)

        def neighbours(x: Column) -> Column:
            total = F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
            square = F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y)
            cross = F.aggregate(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda a, y: a * y), F.lit(0.0),
                                lambda a, y: a + F.coalesce(y, F.lit(0.0)))
            return once(F.struct((total * total / n).alias("mean"), square.alias("square"), cross.alias("cross")), lambda r: once(
                r["square"] - r["mean"], lambda left: F.when(left > 1e-9, 2 * once(
                    F.abs((r["cross"] - r["mean"]) / left * F.sqrt(n)), normal_tail)).otherwise(0.0)))

        return once(e - F.ln(floor(once(bits, runs))), lambda e: F.when(lowest(e), F.lit(0.0)).otherwise(
            once(e - F.ln(floor(serial())), agreement)))

    def test(v: Column) -> Column:
        s, letters, n, k = v["s"], v["letters"], v["n"], v["k"]
        z = (same_characters(s) * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        alone = once(z, lambda z: -F.ln(floor(normal_tail(z))))
        fit = once(alone, lambda e: F.when(lowest(e), F.lit(0.0)).otherwise(order(e, s, letters, n, k)))
        return F.when(n < 2, F.lit(0.0)).otherwise(fit)

    return once(F.struct(text.alias("s"), alphabet.alias("letters"), F.length(text).cast("double").alias("n"),
                         F.length(alphabet).cast("double").alias("k")), test)


def inferred(text: Column) -> Column:
    """The narrowest alphabet that holds all of a string's characters."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(letters)) for _, pattern, letters in ALPHABETS])


def band_of(text: Column) -> Column:
    return sum((F.when(F.length(text) >= b, 1).otherwise(0) for b in BANDS), F.lit(0)).cast("int")


def band_and_bin(text: Column, alphabet: Column | None = None) -> Column:
    """Length band of a string and agreement of its encoding with chance, as a struct with the string's ``alone``:
    whether it is letters of one case. The encoding is inferred unless the alphabet, letters of one case, is given."""
    fit = battery(F.translate(text, "-_=", "+/"), inferred(text)) if alphabet is None else battery(text, alphabet)
    bin_ = F.floor(F.coalesce(F.nanvl(fit, F.lit(0.0)), F.lit(0.0)) * (BINS - 1e-9)).cast("int")
    alone = text.rlike(ONE_CASE) if alphabet is None else F.lit(True)
    return F.struct(alone.alias("alone"), band_of(text).alias("band"), bin_.alias("bin"))


def tested(found: Column) -> Column:
    """Runs with class, length band, and agreement of their inferred encoding with chance."""
    return F.transform(found, lambda m: once(band_and_bin(m["text"]), lambda r: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), r["alone"].alias("alone"), r["band"].alias("band"), r["bin"].alias("bin"))))


def stretches(text: Column) -> Column:
    """The whole text but for its long runs, without spaces, cut into strings: fewer than 22 characters are left over.

    They stand for what text of their length looks like when it is no secret.
    """
    glued = F.regexp_replace(text, f"[{SINGLY}]{{20,}}+|[^{SINGLY}]+", "")
    return F.filter(once(glued, lambda g: F.concat(*[F.regexp_extract_all(g, F.lit(CUT), F.lit(k + 1)) for k in range(len(PROSE))])),
                    lambda s: s != "")


def ordinary(texts: DataFrame, wanted: set[tuple[bool, int]] | None = None) -> DataFrame:
    """``(alone, band, bin, null)``: counts of the strings of all ordinary text, summed up within the tasks first.

    All count for strings of any kind; their letters in one case count for strings of letters of one case. ``wanted``
    names the classes and bands that have strings to judge; the counts of others decide nothing and are left out.
    """
    every = [(alone, band) for alone in (False, True) for band in range(len(BANDS) + 1)]
    bands = {kind: [band for alone, band in sorted(every if wanted is None else wanted) if alone == kind] for kind in (False, True)}
    whole = F.transform(F.filter(F.col("s"), lambda s: band_of(s).isin(bands[False])), lambda s: band_and_bin(s))
    letters = F.transform(F.col("s"), lambda s: F.regexp_replace(F.lower(s), f"[^{string.ascii_lowercase}]+", ""))
    folded = F.transform(F.filter(letters, lambda s: (F.length(s) >= LEAST) & band_of(s).isin(bands[True])),
                         lambda s: band_and_bin(s, F.lit(string.ascii_lowercase)))
    parts = [F.transform(whole, lambda r: F.struct(F.lit(False).alias("alone"), r["band"].alias("band"), r["bin"].alias("bin")))] if bands[False] else []
    parts += [folded] if bands[True] else []
    if not parts:
        return texts.sparkSession.createDataFrame([], "alone boolean, band int, bin int, null long")
    cells = texts.select(stretches(F.col("_t")).alias("s")).select(F.explode(F.concat(*parts)).alias("r"))
    return cells.groupBy("r.alone", "r.band", "r.bin").agg(F.count(F.lit(1)).alias("null"))


def to_judge(rows: DataFrame) -> set[tuple[bool, int]]:
    """Classes and length bands of the runs: at most ten."""
    found = rows.select(F.explode("runs").alias("r")).select("r.alone", "r.band").distinct()
    return {(r["alone"], r["band"]) for r in found.collect()}


def thresholds(rows: DataFrame, nulls: DataFrame, rate: float) -> dict[tuple[bool, int], int]:
    """Lowest bin per class and length band at which the false-discovery rate of Benjamini and Hochberg stays within ``rate``.

    A string's chance is the share of strings of ordinary text of its class and band, taken from all documents, that agree
    with randomness as well as it does; there are at most (classes x bands x bins) rows to look at.
    """
    cell = ["alone", "band", "bin"]
    runs = rows.select(F.explode("runs").alias("r")).groupBy("r.alone", "r.band", "r.bin").agg(F.count(F.lit(1)).alias("some"))
    counts = runs.join(nulls, cell, "full").select(*cell, F.coalesce("null", F.lit(0)).alias("null"), F.coalesce("some", F.lit(0)).alias("some"))
    whole = Window.partitionBy("alone", "band")
    above = whole.orderBy(F.desc("bin"))
    chance = (1 + F.sum("null").over(above)) / (1 + F.sum("null").over(whole))
    ranked = counts.select(*cell, "some", (chance * F.sum("some").over(whole) / F.sum("some").over(above)).alias("fdr"))
    best = ranked.filter((F.col("some") > 0) & (F.col("fdr") <= rate)).groupBy("alone", "band").agg(F.min("bin").alias("bin"))
    return {(r["alone"], r["band"]): r["bin"] for r in best.collect()}


def secret_spans(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Per row: doc_id, base and spans, arrays of (start, number, end, kind) by start, then kind.

    ``base`` holds the known forms; ``spans`` adds random strings (runs of at least 20 characters that pass the battery
    and overlap no known form), whatever their shape. NULL counts as empty; empty texts have none. Rows are judged one by one, repeated ones
    alike, though all count for the shares. Extra columns are ignored. Texts are read twice and not shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= ASSIGNED
    base = F.concat(of_kind(F.filter(matches(F.col("_t"), ASSIGN), value), 0, "assign"), of_kind(matches(F.col("_t"), ACCESS), 1, "access"),
                    of_kind(matches(F.col("_t"), HEX), 2, "hex"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t")).select(
        "doc_id", by_start(base).alias("base"),
        tested(matches(F.col("_t"), RUN)).alias("runs"))
    rows = stored(rows, "secrets")
    limit = thresholds(rows, ordinary(docs.select(text.alias("_t")), to_judge(rows)), rate)

    def flagged(r: Column) -> Column:
        need = F.lit(BINS)
        for (alone, b), v in limit.items():
            need = F.when((r["alone"] == alone) & (r["band"] == b), F.lit(v)).otherwise(need)
        free = ~F.exists("base", lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))
        return (r["bin"] >= need) & free

    extra = F.transform(F.filter("runs", flagged), lambda r: F.struct(
        r["start"].alias("start"), F.lit(3).alias("number"), r["end"].alias("end"), F.lit("random").alias("kind")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("spans"))
