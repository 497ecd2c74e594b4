"""Nesting of source text as a monoid over its events, one letter each.

``l`` opens the block of a loop, ``b`` opens another block, ``c`` closes one and ``.`` is a leaf. A
closing event without an open block is ignored. The summary of a stretch of events holds all that
later stretches need: what it leaves open, how many blocks it closes that were opened before it,
and, for each number of such blocks closed so far, the deepest place. Summaries are merged in order,
so a long source is measured by ranges of lines, in tasks of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import arrays as A
from quillmark.functions import patterns as P

SUMMARY = "struct<open:string,pops:int,seen:bigint,tops:array<int>,loops:array<int>>"
#: Loop heads and ``do`` with the brace that opens their block, and other braces.
LOOP_EVENT = (
    r"\b(?:for|while)[ \t]*\([^(){}]*(?:\([^()]*\)[^(){}]*)*\)[\s]*\{|\bdo[\s]*\{|\{|\}"
)
PY_LOOP = r"\A[ \t]*(?:async[ \t]+)?(?:for|while)\b"
PY_INDENT = r"\A[ \t]*"


def _events(found: Column, opens: list[str], closes: list[str], other: str) -> Column:
    return F.transform(found, lambda t: F.when(t.isin(opens), "b").when(t.isin(closes), "c").otherwise(other))


def token_events(code: Column) -> Column:
    """Events of masked source: brackets of any kind are blocks, every other token is a leaf."""
    tokens = F.regexp_extract_all(code, F.lit(P.CODE_TOKEN), F.lit(0))
    return _events(tokens, ["(", "[", "{"], [")", "]", "}"], ".")


def loop_events(code: Column) -> Column:
    """Events of the braces of masked source; those that follow a loop head open a loop."""
    return _events(F.regexp_extract_all(code, F.lit(LOOP_EVENT), F.lit(0)), ["{"], ["}"], "l")


def tag_events(html: Column) -> Column:
    """Events of markup: start tags open, end tags close, void and self-closed tags are leaves."""
    tags = F.regexp_extract_all(html, F.lit(P.TAG), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, r"\A<([A-Za-z][A-Za-z0-9]*)", 1))
    return F.transform(tags, lambda t: F.when(t.startswith("</"), "c").when(t.endswith("/>") | name(t).isin(P.VOID_TAGS), ".").otherwise("b"))


def _last_raised(values: Column, value: Column) -> Column:
    size = F.size(values)
    return F.concat(F.slice(values, 1, size - 1), F.array(F.greatest(F.element_at(values, -1), value)))


def _loops(opened: Column) -> Column:
    return F.length(F.replace(opened, F.lit("b"), F.lit("")))


def summary(events: Column) -> Column:
    """The summary of a stretch of events."""
    zero = F.expr(f"cast(named_struct('open', '', 'pops', 0, 'seen', 0, 'tops', array(0), 'loops', array(0)) AS {SUMMARY})")

    def step(a: Column, e: Column) -> Column:
        depth = F.length(a["open"])
        outer = (e == "c") & (depth == 0)
        opened = F.when(e == "c", F.substring(a["open"], F.lit(1), F.greatest(depth - 1, F.lit(0)))).when(
            e == ".", a["open"]
        ).otherwise(F.concat(a["open"], e))
        place = F.length(opened) + F.when(e == ".", 1).otherwise(0)
        new = F.array(F.lit(0))
        return A.record(
            open=opened,
            pops=a["pops"] + F.when(outer, 1).otherwise(0),
            seen=a["seen"] + F.when(e == "c", 0).otherwise(1),
            tops=F.when(outer, F.concat(a["tops"], new)).when(e == "c", a["tops"]).otherwise(_last_raised(a["tops"], place)),
            loops=F.when(outer, F.concat(a["loops"], new)).when(e == "l", _last_raised(a["loops"], _loops(opened))).otherwise(a["loops"]),
        )

    return F.aggregate(events, zero, step)


def merged(summaries: Column) -> Column:
    """struct<seen, top, loops> of summaries in order: events but closings, deepest place, deepest loop."""
    zero = F.expr("named_struct('open', '', 'seen', 0L, 'top', 0, 'loops', 0)")

    def step(a: Column, s: Column) -> Column:
        held = F.length(a["open"])
        left = lambda k: F.greatest(held - k, F.lit(0))
        return A.record(
            open=F.concat(F.substring(a["open"], F.lit(1), left(s["pops"])), s["open"]),
            seen=a["seen"] + s["seen"],
            top=F.greatest(a["top"], F.array_max(F.transform(s["tops"], lambda t, k: left(k) + t))),
            loops=F.greatest(
                a["loops"], F.array_max(F.transform(s["loops"], lambda t, k: _loops(F.substring(a["open"], F.lit(1), left(k))) + t))
            ),
        )

    return F.aggregate(summaries, zero, step, lambda a: A.record(seen=a["seen"], top=a["top"], loops=a["loops"]))


def indented_summary(segment: Column) -> Column:
    """struct<seen, top, loops> of lines that nest by their indentation.

    A line is a block under the last line before it that is less indented; its tokens are in it, by
    their brackets. Source may be cut before any line that is not indented at all.
    """
    lines = F.filter(F.split(segment, "\n"), lambda s: s.rlike(P.NOT_WS))
    zero = F.expr(
        "cast(named_struct('stack', array(), 'seen', 0, 'top', 0, 'loops', 0)"
        " AS struct<stack:array<struct<indent:int,loop:int>>,seen:bigint,top:int,loops:int>)"
    )

    def step(a: Column, line: Column) -> Column:
        indent = F.length(F.regexp_extract(line, PY_INDENT, 0))
        own = A.record(indent=indent, loop=F.when(line.rlike(PY_LOOP), 1).otherwise(0))
        inner = merged(F.array(summary(token_events(line))))

        def placed(x: Column) -> Column:
            stack = F.concat(F.filter(a["stack"], lambda s: s["indent"] < x["own"]["indent"]), F.array(x["own"]))
            return A.let(stack, lambda s: A.record(
                stack=s,
                seen=a["seen"] + 1 + x["inner"]["seen"],
                top=F.greatest(a["top"], F.size(s) + x["inner"]["top"]),
                loops=F.greatest(a["loops"], F.aggregate(s, F.lit(0), lambda n, y: n + y["loop"])),
            ))

        return A.let(A.record(own=own, inner=inner), placed)

    return F.aggregate(lines, zero, step, lambda a: A.record(seen=a["seen"], top=a["top"], loops=a["loops"]))
