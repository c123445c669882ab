"""Matches of patterns with their places, by built-in expressions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenwatch.llm.common import let, totals_before

SPAN = "struct<kind:string,start:int,end:int,value:string>"


class Kind(NamedTuple):
    """A pattern for ``regexp_extract_all`` and ``split``, and which matches count.

    Patterns are written so that a match never walks back over a long run: possessive, and anchored at the beginning of a run
    or at the end of the match before (``\\G``). ``check`` gets the match and the text of group ``group``.
    """

    name: str
    pattern: str
    check: object = None
    group: int = 0


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The Luhn sum of a string of digits is a multiple of ten."""
    n = F.length(number)

    def weighed(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + weighed(i)) % 10 == 0


def kind_spans(text: Column, kind: Kind) -> Column:
    """Matches of one kind, leftmost and not overlapping, in order, as SPAN structs with code-point places.

    ``split`` gives the text between the same matches, so places follow from sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)

    def placed(pair: Column) -> Column:
        values, between, groups = pair["values"], pair["between"], pair["groups"]
        lengths = F.transform(values, lambda v, i: F.length(v) + F.length(F.get(between, i)))
        every = let(
            totals_before(lengths),
            lambda before: F.transform(
                values,
                lambda v, i: F.struct(
                    F.lit(kind.name).alias("kind"),
                    (F.get(before, i) + F.length(F.get(between, i))).alias("start"),
                    (F.get(before, i) + F.length(F.get(between, i)) + F.length(v)).alias("end"),
                    v.alias("value"),
                    F.get(groups, i).alias("part"),
                ),
            ),
        )
        kept = every if kind.check is None else F.filter(every, lambda s: kind.check(s["value"], s["part"]))
        return F.transform(kept, lambda s: F.struct(*(s[n].alias(n) for n in ("kind", "start", "end", "value"))))

    groups = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else found
    parts = F.struct(found.alias("values"), gaps.alias("between"), groups.alias("groups"))
    return F.when(F.regexp_like(text, F.lit(kind.pattern)), let(parts, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def spans_of(text: Column, kinds: tuple[Kind, ...]) -> Column:
    return F.concat(*(kind_spans(F.coalesce(text, F.lit("")), kind) for kind in kinds))


def count_kind(spans: Column, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == name)).cast("long")


def outside(spans: Column, taken: Column) -> Column:
    """Spans that overlap none of the taken ones."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def said(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """``kind:start:end`` of all spans, comma-joined, ordered by kind as listed and start, or by start and kind."""

    def order(s: Column) -> Column:
        rank, start = F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).cast("int"), s["start"]
        first, second = (rank, start) if by_kind else (start, rank)
        text = F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.struct(first.alias("a"), second.alias("b"), s["end"].alias("c"), text.alias("d"))

    return F.array_join(F.transform(F.array_sort(F.transform(spans, order)), lambda x: x["d"]), ",")


def replaced(text: Column, spans: Column, mark: Column | str) -> Column:
    """The text with each span (sorted by start, none overlapping) replaced by a mark."""
    mark = F.lit(mark) if isinstance(mark, str) else mark
    cuts = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)).alias("a"), s["start"].alias("b")))
    pieces = F.transform(cuts, lambda c: F.concat(F.substring(text, c["a"] + 1, c["b"] - c["a"]), mark))
    tail = F.substring(text, F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0)) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
