"""Spans of regular-expression matches as native columns, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = 64
SPAN = "array<struct<start:bigint,end:bigint,value:string,inner:string,before:string,after:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is worked out once however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it where a column is called so."""
    taken = {c.lower() for c in taken}
    while name in taken:
        name = "_" + name
    return name


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _lengths(items: Column) -> Column:
    return F.transform(items, lambda x: F.char_length(x).cast("bigint"))


def matches(text: Column, pattern: str, when: Column, inner: int = 0, context: int = 0) -> Column:
    """All leftmost non-overlapping matches of ``pattern``: ``array<struct<start,end,value,inner,before,after>>``.

    ``when`` is a cheap condition that every text with a match meets; null counts as unmet.
    ``inner`` is the group given beside the whole match, ``before`` and ``after`` are up to
    ``context`` code points of what stands between matches.  Spark's functions give no
    positions: they are running sums of the lengths of what stands between matches and of
    the matches, taken by blocks so that a text with very many matches stays cheap.
    """
    names = ("hits", "inner", "gaps", "heads", "tails")

    def parts(gaps: Column) -> Column:
        cut = lambda f: F.transform(gaps, lambda x: f(x, F.lit(context))) if context else F.lit(None).cast("array<string>")
        return F.struct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
            (F.regexp_extract_all(text, F.lit(pattern), F.lit(inner)) if inner else F.lit(None).cast("array<string>")).alias("inner"),
            _lengths(gaps).alias("gaps"),
            cut(F.left).alias("heads"),
            cut(F.right).alias("tails"),
        )

    def steps(p: Column) -> Column:
        n = F.size(p["hits"])
        step = F.zip_with(F.slice(p["gaps"], F.lit(1), n), _lengths(p["hits"]), lambda g, m: g + m)
        return F.struct(*(p[c].alias(c) for c in names), step.alias("step"))

    def blocks(p: Column) -> Column:
        last = F.floor((F.size(p["hits"]) - 1) / _STEP).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: _total(F.slice(p["step"], b * _STEP + 1, F.lit(_STEP))))
        return F.struct(*(p[c].alias(c) for c in names), p["step"].alias("step"), sums.alias("sums"))

    def spans(p: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            block = F.floor(i / _STEP).cast("int")
            before = _total(F.slice(p["sums"], F.lit(1), block)) + _total(F.slice(p["step"], block * _STEP + 1, i % _STEP))
            start = before + F.get(p["gaps"], i)
            return F.struct(
                start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("value"), F.get(p["inner"], i).alias("inner"),
                F.get(p["tails"], i).alias("before"), F.get(p["heads"], i + 1).alias("after"),
            )

        return F.transform(p["hits"], one)

    empty = F.array().cast(SPAN)
    placed = lambda p: F.when(F.size(p["hits"]) > 0, let(steps(p), lambda q: let(blocks(q), spans))).otherwise(empty)
    return F.when(when, let(F.split(text, pattern, -1), lambda g: let(parts(g), placed))).otherwise(empty)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
