"""Places of pattern matches in whole texts, as native expressions. Places count code points; ends are exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
STRETCH = 64


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed a single time."""
    return F.transform(F.array(value), body)[0]


def running_sums(steps: Column) -> Column:
    """Sums of the first 1, 2, ... numbers of an array: within stretches, then over their totals, so that the work
    stays far below the square of the length."""

    def sums(numbers: Column) -> Column:
        grown = F.aggregate(numbers, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return grown

    def whole(all_steps: Column) -> Column:
        count = F.ceil(F.size(all_steps) / STRETCH).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                            lambda b: sums(F.slice(all_steps, (b - 1) * STRETCH + 1, STRETCH)))
        return once(parts, lambda own: once(sums(F.transform(own, lambda p: F.element_at(p, -1))), lambda before: F.flatten(
            F.transform(own, lambda p, b: F.transform(F.slice(p, 2, STRETCH), lambda x: x + before[b])))))

    return once(steps, whole)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap, as structs of start, end and text."""

    def place(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
        steps = F.zip_with(gaps, found, lambda gap, m: gap + F.length(m))
        return F.zip_with(running_sums(steps), found, lambda end, m: F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), m.alias("text")))

    return F.when(text.rlike(pattern), once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(
        F.array().cast(SPAN))


def of_kind(found: Column, number: int, kind: str) -> Column:
    """Spans with their kind; ``number`` is the kind's place in the list of kinds."""
    return F.transform(found, lambda m: F.struct(F.lit(number).alias("number"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


KINDED = "array<struct<number:int,start:int,end:int,kind:string>>"


def by_start(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["number"].alias("number"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return ordered


def joined(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, word: Callable[[Column], Column]) -> Column:
    """Text with each span put as ``word(kind)``; a span that overlaps an earlier one is part of it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        by_start(spans), start,
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), word(s["kind"]))).alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))
