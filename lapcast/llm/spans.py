"""Spans of pattern matches with code-point positions, in column expressions only.

``regexp_replace`` puts a mark before and after every match and ``split`` cuts there; every second piece is
a match and the lengths before it give its place. Marks that a text itself holds are first replaced by a
third control character, which no pattern here accepts either, so matches and places stay the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapcast.llm.common import let

_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


@dataclass(frozen=True)
class Kind:
    """A kind of span: a pattern whose matches may not overlap, and a test that a match must pass."""

    name: str
    pattern: str
    test: object = field(default=lambda value: F.lit(True))


def starting(characters: str) -> str:
    """Begin where a run of the characters begins, or right after the last match.

    For a pattern that begins with the whole run this finds what a search from every place finds, without
    trying the places inside a run.
    """
    return rf"(?:(?<![{characters}])|\G)"


def unmarked(text: Column) -> Column:
    return F.regexp_replace(text, f"[{_OPEN}{_CLOSE}]", _OTHER)


def matches(text: Column, kind: Kind) -> Column:
    """All matches that pass the kind's test, in order, as ``SPAN``; ``text`` comes from ``unmarked``."""
    marked = F.regexp_replace(text, kind.pattern, f"{_OPEN}$0{_CLOSE}")
    empty = F.array().cast(SPAN)

    def located(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("spans"))

        def step(a: Column, piece: Column) -> Column:
            end = a["at"] + F.char_length(piece)
            span = F.struct(F.lit(kind.name).alias("kind"), a["at"].alias("start"), end.alias("end"), piece.alias("value"))
            # Only matches that pass are kept, so a text of many numbers stays linear.
            added = F.when(a["inside"] & kind.test(piece), F.array_append(a["spans"], span)).otherwise(a["spans"])
            return F.struct(end.alias("at"), (~a["inside"]).alias("inside"), added.alias("spans"))

        return F.aggregate(pieces, start, step, lambda a: a["spans"])

    return let(marked, lambda m: F.when(m.contains(_OPEN), located(F.split(m, f"[{_OPEN}{_CLOSE}]"))).otherwise(empty))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """The digits' check sum is right: every second one from the right doubled, 9 taken off above 9."""
    places = lambda d: F.sequence(F.lit(1), F.greatest(F.char_length(d), F.lit(1)))

    def total(d: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            digit = F.substring(d, i, F.lit(1)).cast("int")
            twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
            return (a + F.when(i % 2 == 0, twice).otherwise(digit)).cast("int")

        return F.aggregate(places(d), F.lit(0), add)

    return let(F.reverse(digits(value)), lambda d: total(d) % 10 == 0)
