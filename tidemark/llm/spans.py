"""Places of regular-expression matches in texts, as DataFrame expressions.

A span is a struct of kind (its place in a list of kinds), start and end in code points, end exclusive.
Patterns are written so that the engine never backtracks over a long run: a pattern that could begin anywhere in a
run is held to the run's beginning or the end of the match before, and repeated groups are possessive.  Neither
changes what they match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import let

#: Long lists are scanned in blocks of so many elements, long texts cut in stretches of so many code points, so that
#: neither takes quadratic time.
BLOCK, STRETCH = 256, 4096

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def scan(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What step makes of the state and each element in turn, as an array; in blocks, so that long arrays are not
    copied for each element.  start: the state before, whose type the states have."""

    def begin(at: Column) -> Column:
        return F.struct(at.alias("at"), F.slice(F.array(start), 1, F.lit(0)).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        return let(step(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out")))

    def by_block(acc: Column, block: Column) -> Column:
        return let(F.aggregate(block, begin(acc["at"]), add), lambda b: F.struct(b["at"].alias("at"), F.concat(acc["out"], b["out"]).alias("out")))

    def whole(held: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int")), lambda k: F.slice(held, k * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(held) == 0, begin(start)["out"]).otherwise(F.aggregate(blocks, begin(start), by_block)["out"])

    return let(values, whole)


def _running(lengths: Column) -> Column:
    """The sum before each element of an array of integers."""
    return let(lengths, lambda held: F.zip_with(scan(held, F.lit(0), lambda at, x: at + x), held, lambda after, x: after - x))


def paragraphs(text: Column) -> Column:
    """text in stretches of STRETCH code points, from which piece() cuts without going through all of it."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{STRETCH}}}"), F.lit(0))


def piece(held: Column, start: Column, end: Column) -> Column:
    """Code points start to end, exclusive, of a text given as paragraphs()."""

    def cut(first: Column) -> Column:
        last = F.floor((end - 1) / STRETCH).cast("int")
        return F.substring(F.array_join(F.slice(held, first + 1, last - first + 1), ""), start - first * STRETCH + 1, end - start)

    return F.when(end > start, let(F.floor(start / STRETCH).cast("int"), cut)).otherwise(F.lit(""))


def matches(text: Column, pattern: str, kind: int, hint: str | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches of pattern, each with what it matched.

    hint: a cheaper pattern that every text with a match contains.
    """

    def build(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def place(starts: Column) -> Column:
            return F.transform(
                hits,
                lambda h, i: F.struct(
                    F.lit(kind).alias("kind"), F.get(starts, i).cast("int").alias("start"), (F.get(starts, i) + F.char_length(h)).cast("int").alias("end"), h.alias("value")
                ),
            )

        # the i-th match begins after the i + 1 gaps and i matches before it
        shift = let(gaps, lambda g: let(_running(F.transform(hits, lambda h, i: F.char_length(F.get(g, i)) + F.char_length(h))), lambda before: F.transform(before, lambda b, i: b + F.char_length(F.get(g, i)))))
        return let(shift, place)

    # most texts have none, which one search tells
    return F.when(text.rlike(hint or pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)).otherwise(none())


def listed(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def disjoint(spans: Column) -> Column:
    """Starts and ends of the stretches that spans cover, in order, with the kind of the first; what touches or
    overlaps is one."""

    def merged(s: Column) -> Column:
        def by_end(most: Column) -> Column:  # the last end so far
            heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] > F.get(most, i - 1)))

            def stretch(h: Column, first: Column, k: Column) -> Column:
                last = F.coalesce(F.get(h, k + 1), F.size(s)) - 1
                return F.struct(F.get(s, first)["start"].alias("start"), F.get(most, last).alias("end"), F.get(s, first)["kind"].alias("kind"))

            return let(heads, lambda h: F.transform(h, lambda first, k: stretch(h, first, k)))

        return let(scan(F.transform(s, lambda x: x["end"]), F.lit(-1), lambda at, x: F.greatest(at, x)), by_end)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return let(ordered, lambda s: F.when(F.size(s) > 0, merged(s)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int>>")))


def replaced(text: Column, stretches: Column, labels: list[str] | None = None) -> Column:
    """text with each stretch replaced by the label of its kind, or by as many blanks where there are no labels."""

    def instead(stretch: Column) -> Column:
        if labels is None:
            return F.coalesce(F.repeat(F.lit(" "), stretch["end"] - stretch["start"]), F.lit(""))
        return F.coalesce(F.get(F.array(*map(F.lit, labels)), stretch["kind"]), F.lit(""))

    def join(s: Column, held: Column) -> Column:
        def between(i: Column) -> Column:
            return piece(held, F.coalesce(F.get(s, i - 1)["end"], F.lit(0)), F.coalesce(F.get(s, i)["start"], F.char_length(text)))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.concat(between(i), instead(F.get(s, i)))), "")

    return let(stretches, lambda s: F.when(F.size(s) == 0, text).otherwise(let(paragraphs(text), lambda held: join(s, held))))
