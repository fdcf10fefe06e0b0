"""Places of all matches of a regular expression, with built-in functions only.

Spark gives matches but not their places. Splitting a text at the matches gives
the gaps between them; gap and match lengths summed up are the places. All
places are in characters (code points), from 0, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"
#: Matches whose places are summed up together: a sum appends, which copies what it has.
BLOCK = 64


def find_all(text: Column, pattern: str | Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as structs start, end, match.

    ``keep`` drops matches after matching (no second try). The pattern must not
    match the empty string. A null text gives null.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"))

    def step(state: Column, pair: Column) -> Column:
        gap, hit = pair["gap"], pair["hit"]
        start = state["at"] + F.length(gap)
        end = start + F.coalesce(F.length(hit), F.lit(0))
        good = hit.isNotNull()
        if keep is not None:
            good = good & F.coalesce(keep(hit), F.lit(False))
        more = F.array(F.struct(start.alias("start"), end.alias("end"), hit.alias("match")))
        return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], more)).otherwise(state["out"]).alias("out"))

    def join(state: Column, block: Column) -> Column:
        at = state["at"]
        moved = F.transform(block["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["match"].alias("match")))
        return F.struct((at + block["at"]).alias("at"), F.when(F.size(block["out"]) > 0, F.concat(state["out"], F.array(moved))).otherwise(state["out"]).alias("out"))

    def blocks(every: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        part = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(every, k * BLOCK + 1, BLOCK), begin, step))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(part, first, join, lambda s: F.flatten(s["out"]))

    # Without a match there is one gap, the text.
    return F.element_at(F.transform(F.array(pairs), lambda p: F.when(F.size(p) <= 1, F.array().cast(SPAN)).otherwise(blocks(p))), 1)


def gated(text: Column, gate: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """:func:`find_all` where the cheap test ``gate`` holds, else no spans."""
    return F.when(gate, find_all(text, pattern, keep)).otherwise(F.array().cast(SPAN))


def labelled(found: list[tuple[str, Column]]) -> Column:
    """All spans of several kinds, by start, then by the order of the kinds."""

    def mark(rank: int, kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match"))

    parts = [F.transform(c, mark(k, kind)) for k, (kind, c) in enumerate(found)]
    return F.array_sort(F.concat(*parts))


def listing(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
