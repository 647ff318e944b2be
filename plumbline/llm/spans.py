"""Spans of regular expressions in texts, by code points, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "array<struct<kind:string,start:int,end:int,text:string,near:string>>"


#: Elements that running totals and texts are taken in at once: work grows with the matches times this, not their square.
CHUNK = 256
#: Matches that the characters before a span can reach over: each is of 2 characters at least, with one between.
BACK = 14


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named and in whatever lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, zero: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each element, the fold of all that stand before it."""

    def of(v: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: F.aggregate(F.slice(v, 1, k * CHUNK), zero, fold))
        return bound(starts, lambda s: F.transform(v, lambda x, i: F.aggregate(F.slice(v, i - i % CHUNK + 1, i % CHUNK), F.get(s, F.floor(i / CHUNK).cast("int")), fold)))

    return F.when(F.size(values) > 0, bound(values, of)).otherwise(values)


def found(text: Column, kind: str, pattern: str, near: int = 0, keep=None) -> Column:
    """An array of (kind, start, end, text, near) for the leftmost non-overlapping matches; start from 0, end exclusive.

    What is between the matches is had by splitting at them; the lengths of both, summed up, give the places. Most texts
    have no match and are only searched once. Patterns must not match an empty string. ``near`` is what stands within so
    many characters before, and after up to the second next match. Matches for which ``keep(span)`` is false are left out.
    """
    own = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"))

    def spans(s: Column) -> Column:
        both = F.zip_with(F.slice(s["gaps"], 1, F.size(s["hits"])), s["hits"], lambda g, h: F.concat(g, h))
        sizes = F.transform(both, lambda x: F.char_length(x))
        at = F.struct(before(sizes, F.lit(0), lambda a, n: a + n).alias("at"), (both if near else F.array().cast("array<string>")).alias("both"))
        return bound(at, lambda p: F.transform(s["hits"], lambda hit, i: span(s, p, hit, i)))

    def span(s: Column, p: Column, hit: Column, i: Column) -> Column:
        start = F.get(p["at"], i) + F.char_length(F.get(s["gaps"], i))
        if near:
            tail = F.concat(F.array_join(F.slice(p["both"], F.greatest(F.lit(1), i + 1 - BACK), F.least(i, F.lit(BACK))), ""), F.get(s["gaps"], i))
            head = F.concat(F.get(s["gaps"], i + 1), F.coalesce(F.get(s["hits"], i + 1), F.lit("")), F.coalesce(F.get(s["gaps"], i + 2), F.lit("")))
            around = F.concat_ws(" ", F.substring(tail, -near, near), F.substring(head, 1, near))
        else:
            around = F.lit("")
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("text"), around.alias("near"))

    out = bound(own, spans)
    return F.when(text.rlike(pattern), out if keep is None else F.filter(out, keep)).otherwise(F.array().cast(NONE))


def ordered(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by kind as listed, then by end."""
    place = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"), s["near"].alias("near")))
    return F.array_sort(keyed)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
