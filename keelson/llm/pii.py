"""Personal data in texts, and terms that give it away though they are not personal data themselves.

How strongly a term reveals an entity is estimated over the corpus: their pointwise mutual information, both looked for in
whole documents, as a share of the information that the entity carries. Terms above a first threshold are generalised,
above a second one removed, wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import join_small, stored
from keelson.llm.spans import KINDED, SPAN, matches, once, replaced

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
# The forms of personal data. A match begins where its first run of characters does, so the look-behind
# loses none and spares the search from starting anew at every character of a long run. What repeats is possessive, as
# nothing follows that it could give back to: the search then runs as a loop and long texts need no stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words that may reveal.
TERM = r"[\p{L}][\p{L}'-]{3,}"
#: Terms that may be broadcast; beyond it their join shuffles.
FEW_TERMS = 100_000


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def small_parts(text: Column) -> Column:
    """All parts of an address are at most 255."""
    return F.forall(F.split(text, r"\."), lambda p: once(F.ltrim(p, F.lit("0")), 
                    lambda s: F.when(F.length(s) > 3, False).when(s == "", True).otherwise(F.try_to_number(s, F.lit("999")) <= 255)))


def luhn(number: Column) -> Column:
    def total(s: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), lambda acc, i: acc + once(
            F.substr(s, i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))))

    return once(F.reverse(number), total) % 10 == 0


def card_like(text: Column) -> Column:
    return once(digits(text), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


def entities(text: Column) -> Column:
    """Known forms, by kind, then start: structs of number, start, end, kind and the matched text."""
    found = (("email", F.when(F.instr(text, "@") > 0, matches(text, EMAIL)), None),
             ("ip", matches(text, IP), lambda m: small_parts(m["text"])),
             ("card", F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), matches(text, CARD)), lambda m: card_like(m["text"])),
             ("phone", matches(text, PHONE), lambda m: F.length(digits(m["text"])).between(9, 15)))

    def part(number: int, kind: str, spans: Column, test) -> Column:
        spans = F.coalesce(spans, F.array().cast(SPAN))
        return F.transform(F.filter(spans, test) if test else spans, lambda m: F.struct(
            F.lit(number).alias("number"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lower(m["text"]).alias("text")))

    return F.array_sort(F.concat(*[part(n, *f) for n, f in enumerate(found)]))


def key(kind: Column, text: Column) -> Column:
    """One name for an entity however it is written: numbers by their digits, addresses without leading zeros."""
    parts = F.array_join(F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), ".")
    plain = (F.when(kind == "email", F.regexp_replace(text, "^[.-]+(?=[^@])", "")).when(kind == "ip", parts)
             .when(kind == "phone", digits(F.regexp_replace(text, r"\(0+\)", ""))).otherwise(digits(text)))
    return F.concat_ws(":", kind, plain)


def blanked(text: Column, found: Column) -> Column:
    """The text with spaces in the place of its entities; all else stays where it is."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    ordered = F.array_sort(F.transform(found, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))
    whole = F.aggregate(ordered, start, lambda acc, e: F.when(e["end"] <= acc["at"], acc).otherwise(once(
        F.greatest(e["start"], acc["at"]), lambda low: F.struct(e["end"].alias("at"), F.concat(acc["out"], F.array(
            F.substr(text, acc["at"] + 1, low - acc["at"]), F.repeat(F.lit(" "), e["end"] - low))).alias("out")))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def revealing(seen: DataFrame, generalise: float, remove: float, fewest: int) -> DataFrame:
    """``(term, number, kind)`` of the terms that reveal an entity, by the entity they reveal most.

    An entity found in few texts carries much information: the logarithm of all texts over those that hold it. What a
    term says about it is their pointwise mutual information. A term reveals the entity as far as the second comes up to
    the first: by all of it where only texts with the entity hold the term. Terms count if at least ``fewest`` different
    texts hold them and the entity. Copies of a text count once; an entity in every text has nothing to reveal.
    """
    held = seen.select("same", F.explode(F.array_distinct(F.transform("_found", lambda e: key(e["kind"], e["text"])))).alias("entity")).distinct()
    # No term stands in more texts with an entity than the entity itself.
    known = stored(held.groupBy("entity").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= fewest), "known")
    named = held.join(known.select("entity"), "entity").groupBy("same").agg(F.collect_list("entity").alias("entities"))
    # Texts of their own are counted within the tasks already; only the words of repeated texts go with their text's key.
    times = stored(seen.groupBy("same").agg(F.count(F.lit(1)).alias("n")), "texts")
    texts = times.count()
    repeated = times.filter("n > 1").select("same", F.col("same").alias("copied"))
    marked = join_small(seen.select("same", "_terms"), repeated, ["same"], "left")
    once_each = F.sum(F.when(F.col("copied").isNull(), F.col("n")).otherwise(1))

    def different(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy("copied", *by).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(once_each.alias("n"))

    words = F.explode("_terms").alias("term")
    pairs = join_small(marked, stored(named, "named"), ["same"], "inner", FEW_TERMS, F.size("entities")).select("copied", "entities", words)
    both = different(pairs.select("copied", "term", F.explode("entities").alias("entity")), "entity", "term").filter(F.col("n") >= fewest)
    both = stored(both.select("entity", "term", F.col("n").alias("both")), "both")
    terms = stored(both.select("term").distinct(), "terms")
    uses = different(join_small(marked.select("copied", words), terms, ["term"], "left_semi", FEW_TERMS), "term")
    information = F.log(F.lit(float(texts)) / F.col("held"))
    mutual = F.log(F.col("both") * F.lit(float(texts)) / (F.col("n") * F.col("held")))
    told = both.join(known, "entity").join(uses, "term").withColumn("told", F.when(information > 0, mutual / information).otherwise(0.0))
    # Logarithms of whole numbers: a term held by texts with the entity alone tells all of it but for rounding.
    found = told.groupBy("term").agg((F.max("told") + 1e-9).alias("told")).filter(F.col("told") >= generalise)
    return found.select("term", F.when(F.col("told") >= remove, 5).otherwise(4).alias("number"),
                        F.when(F.col("told") >= remove, "remove").otherwise("generalise").alias("kind"))


def private_spans(docs: DataFrame, generalise: float = 0.85, remove: float = 0.98, fewest: int = 3, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, base and spans, arrays of (number, start, end, kind) by kind, then start; and clean on demand.

    ``generalise`` and ``remove`` are shares of an entity's information. ``base`` holds the known forms; ``spans`` adds the terms that reveal one, in all their places in all texts, whether
    the text holds the entity or not; words inside of entities are no terms. ``clean`` is the text with each
    entity as its kind in brackets, terms that are generalised as [TERM] and others removed. NULL counts as empty; empty
    texts have no spans. Copies of a text get the same spans and count once in all shares. Rows without doc_id are
    scanned like others. Extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    texts = rows.withColumn("same", F.unhex(F.sha2("_t", 256)))
    keep = ["doc_id", "same", *(["_t"] if with_text else [])]
    words = F.array_distinct(F.regexp_extract_all(F.lower(blanked(F.col("_t"), F.col("_found"))), F.lit(TERM), F.lit(0)))
    seen = stored(texts.withColumn("_found", entities(F.col("_t"))).select(*keep, "_found", words.alias("_terms")), "private")
    found = stored(revealing(seen, generalise, remove, fewest), "revealing")
    hits = join_small(seen.select("same", F.explode("_terms").alias("term")), found, ["term"], "inner", FEW_TERMS).groupBy("same").agg(
        F.map_from_entries(F.collect_set(F.struct("term", F.struct("number", "kind")))).alias("_hits"))
    # Only texts that hold such a term are searched for its places.
    places = lambda t: F.transform(F.filter(matches(t, TERM), lambda m: F.map_contains_key("_hits", F.lower(m["text"]))), lambda m: once(
        F.element_at("_hits", F.lower(m["text"])), lambda h: F.struct(h["number"].alias("number"), m["start"].alias("start"), m["end"].alias("end"), h["kind"].alias("kind"))))
    told = join_small(texts.select("same", "_t"), stored(hits, "hits"), ["same"], "inner", FEW_TERMS, F.size("_hits"))
    extra = told.groupBy("same").agg(F.first(once(once(entities(F.col("_t")), lambda f: blanked(F.col("_t"), f)), places)).alias("extra"))
    base = F.transform("_found", lambda e: F.struct(*[e[c].alias(c) for c in ("number", "start", "end", "kind")])).alias("base")
    out = seen.join(extra, "same", "left").select(*keep, base, "extra")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(KINDED))))
    out = out.select("doc_id", "base", spans.alias("spans"), *(["_t"] if with_text else []))
    if with_text:
        word = lambda kind: F.when(kind == "remove", "").when(kind == "generalise", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))
        out = out.withColumn("clean", replaced(F.col("_t"), F.col("spans"), word)).drop("_t")
    return out
