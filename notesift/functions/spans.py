"""Spans of text as arrays of structs.

A span is ``text, label, start, end, ord``: code points, end exclusive; ``ord``
is the place of its pattern and settles ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notesift.functions import kernel

SPAN = "struct<text:string,label:string,start:int,end:int,ord:int>"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once, also where ``f`` uses it inside the function of another array."""
    return F.element_at(F.transform(F.array(value), f), 1)


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns worked out once: what follows reads them instead of repeating their expressions.

    Projections are merged by the optimizer, expressions and all; a generator of one row stays between them.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _ordered(spans: Column) -> Column:
    """By start, the longer first, then by pattern."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["ord"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def _fold(ordered: Column, kind: str, better: Callable[[Column, Column], Column]) -> Column:
    """Left to right: what overlaps the last span replaces it only if it is better."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return (
            F.when((F.size(acc) == 0) | (s["start"] >= last["end"]), F.concat(acc, F.array(s)))
            .when(better(s, last), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(s)))
            .otherwise(acc)
        )

    return F.aggregate(ordered, F.array().cast(f"array<{kind}>"), step)


def longest(spans: Column) -> Column:
    """Spans without overlaps; a strictly longer one wins."""
    return _fold(_ordered(spans), SPAN, lambda s, last: (s["end"] - s["start"]) > (last["end"] - last["start"]))


def most_confident(entities: Column, kind: str) -> Column:
    """Entities without overlaps; a strictly more confident one wins."""
    return _fold(_ordered(entities), kind, lambda s, last: s["confidence"] > last["confidence"])


def spliced(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """``text`` with each span replaced, right to left; spans may overlap, as those with a lower place are replaced later."""
    keyed = F.transform(spans, lambda s: F.struct((-s["start"]).alias("a"), s["ord"].alias("b"), s["end"].alias("end"), replacement(s).alias("value")))
    ordered = F.array_sort(keyed)
    return kernel.splice(text, F.transform(ordered, lambda k: -k["a"]), ordered["end"], ordered["value"])
