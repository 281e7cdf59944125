"""Spans of pattern matches in texts, with DataFrame functions only, in time
that grows with the text's length (a text of many matches takes no more for
each of them).

A span counts code points, from 0, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128  # an array is folded in blocks, since a fold copies what it has
WIDTH = 40  # characters of context before a match
AFTER = 8  # and after it


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """``values`` (array of int, no nulls) folded from the left: the result up
    to and with each entry. ``merge`` is associative (a sum, a maximum)."""
    none = F.array().cast("array<int>")

    def fold(array: Column, last: Callable[[Column], Column]) -> Column:
        """The fold's value before each entry is kept, and after it."""
        empty = F.struct(F.lit(None).cast("int").alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            now = F.coalesce(merge(acc["at"], last(x)), last(x))
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(array, empty, step, lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda a: fold(F.slice(v, a, BLOCK), lambda x: x))

    def joined(parts: Column) -> Column:
        ends = fold(parts, lambda p: F.element_at(p, -1))
        return let(
            ends,
            lambda e: F.flatten(
                F.transform(
                    parts,
                    lambda p, b: F.when(b == 0, p).otherwise(F.transform(p, lambda x: merge(F.get(e, b - 1), x))),
                )
            ),
        )

    return let(
        values,
        lambda v: F.when(F.size(v) == 0, none)
        .when(F.size(v) <= BLOCK, fold(v, lambda x: x))
        .otherwise(let(blocks(v), joined)),
    )


def add(a: Column, b: Column) -> Column:
    return a + b


FOUND = "struct<start:int,end:int,value:string,group:string,before:string,after:string>"


def found(text: Column, pattern: str, group: int = 0, context: bool = True) -> Column:
    """Array of the leftmost non-overlapping matches: start, end, value (the
    match), group (the group of that number), before and after (a few
    characters around it; null without ``context``). A pattern never matches an
    empty string."""
    p = F.lit(pattern)
    none = F.array().cast(f"array<{FOUND}>")

    def placed(hits: Column, groups: Column, gaps: Column) -> Column:
        def around(i: Column) -> dict[str, Column]:
            if not context:
                return dict.fromkeys(("before", "after"), F.lit(None).cast("string"))
            ahead = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(hits, i + 1), F.lit("")))
            behind = F.concat(F.coalesce(_last(F.get(hits, i - 1)), F.lit("")), F.get(gaps, i))
            return {"before": _last(behind), "after": F.substring(ahead, 1, AFTER)}

        steps = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))
        return let(
            running(steps, add),
            lambda ends: F.transform(
                hits,
                lambda h, i: F.struct(
                    (F.get(ends, i) - F.length(h)).alias("start"),
                    F.get(ends, i).alias("end"),
                    h.alias("value"),
                    F.get(groups, i).alias("group"),
                    *[c.alias(n) for n, c in around(i).items()],
                ),
            ),
        )

    hits = F.regexp_extract_all(text, p, F.lit(0))
    groups = F.regexp_extract_all(text, p, F.lit(group))
    gaps = F.split(text, pattern, -1)
    if group:
        out = let(hits, lambda h: let(groups, lambda g: let(gaps, lambda s: placed(h, g, s))))
    else:
        out = let(hits, lambda h: let(gaps, lambda s: placed(h, h, s)))
    return F.when(text.rlike(pattern), out).otherwise(none)


def _last(text: Column) -> Column:
    return F.substring(text, -WIDTH, WIDTH)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its mask. ``spans``: array of
    struct<start:int,end:int,mask:string> in order of start; of spans that
    overlap or touch, the first one's mask stands for all."""
    # (in UTF-32 a code point is four bytes, so a place needs no search)
    wide = F.encode(text, "UTF-32")

    def part(raw: Column, a: Column, b: Column | None = None) -> Column:
        size = F.lit(2**31 - 1) if b is None else 4 * (b - a)
        return F.decode(F.substring(raw, 4 * a + 1, size), "UTF-32")

    def pieces(raw: Column, upto: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(upto, i - 1), F.lit(0))
            opens = (x["start"] > before) | (i == 0)
            return F.when(opens, F.concat(part(raw, before, x["start"]), x["mask"])).otherwise("")

        return F.concat(
            F.array_join(F.transform(spans, piece), ""), part(raw, F.element_at(upto, -1))
        )

    ends = running(F.transform(spans, lambda x: x["end"]), F.greatest)
    out = let(wide, lambda raw: let(ends, lambda upto: pieces(raw, upto)))
    return F.when(F.size(spans) > 0, out).otherwise(text)
