"""Source-text measures by regular expression: masks, lines, tokens, decisions, nesting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import arrays as A
from quillmark.functions import nesting as N
from quillmark.functions import patterns as P
from quillmark.functions.text import rewrite

PY = ["py", "ipynb"]
MARKUP = ["html"]


def by_language(lang: Column, py: Column, markup: Column, other: Column) -> Column:
    return F.when(lang.isin(PY), py).when(lang.isin(MARKUP), markup).otherwise(other)


def masked(src: Column, lang: Column) -> Column:
    """Source without comments, with every string literal as an empty one."""
    return by_language(
        lang, rewrite(src, P.MASK_PY), rewrite(src, P.MASK_HTML), rewrite(src, P.MASK_C)
    )


def uncommented(src: Column, lang: Column) -> Column:
    return by_language(
        lang,
        rewrite(src, P.COMMENTS_PY),
        rewrite(src, P.COMMENTS_HTML),
        rewrite(src, P.COMMENTS_C),
    )


def line_count(src: Column, lang: Column) -> Column:
    """Lines that hold more than blanks, comments and macro definitions."""
    lines = F.split(uncommented(src, lang), "\n")
    uncounted = ~lang.isin(PY + MARKUP)
    return F.size(
        F.filter(lines, lambda s: s.rlike(P.NOT_WS) & ~(uncounted & s.rlike(P.UNCOUNTED_LINE)))
    ).cast("long")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def token_count(src: Column, lang: Column) -> Column:
    """Tokens of the masked text; a preprocessor line counts as one."""
    body = _count(masked(src, lang), P.CODE_TOKEN)
    directives = _count(rewrite(src, P.COMMENTS_C), P.PREPROCESSOR_LINE)
    return body + by_language(lang, F.lit(0), F.lit(0), directives)


def control_blocks(code: Column, lang: Column) -> Column:
    """Control statements of masked source; while and case count twice, do-while once."""
    c_family = (
        _count(code, r"\bif\b")
        + _count(code, r"\bfor\b")
        + 2 * _count(code, r"\bwhile\b")
        - _count(code, r"\bdo[\s]*\{")
        + 2 * _count(code, r"\bcase\b")
        + _count(code, r"\bdefault[\s]*:")
        - F.when(lang == "cpp", _count(code, P.RANGE_FOR)).otherwise(F.lit(0))
    )
    py = (
        _count(code, r"(?m)^[ \t]*(?:async )?for\b")
        + _count(code, r"(?m)^[ \t]*if\b")
        + 2 * _count(code, r"(?m)^[ \t]*while\b")
        + 2 * _count(code, r"(?m)^[ \t]*case\b")
    )
    return by_language(lang, py, F.lit(0).cast("long"), c_family)


def function_count(code: Column, lang: Column) -> Column:
    """Function and method definitions of masked source."""
    c_family = F.greatest(
        _count(code, P.C_FUNCTION) - _count(code, P.C_BLOCK_HEAD), F.lit(0).cast("long")
    )
    py = _count(code, r"(?m)^[ \t]*(?:async[ \t]+)?def\b")
    return by_language(lang, py, F.lit(0).cast("long"), c_family)


def decision_points(code: Column, lang: Column) -> Column:
    """Branches that raise cyclomatic complexity; in Python only those inside functions."""
    c_family = _count(code, r"\b(?:if|for|while|case|catch)\b") + _count(code, r"&&|\|\||\?")
    return by_language(lang, python_decisions(code), F.lit(0).cast("long"), c_family)


def python_decisions(code: Column) -> Column:
    """Branch words on lines inside functions: a definition opens its scope for the lines that
    are indented deeper than itself."""
    lines = F.filter(F.split(code, "\n"), lambda s: s.rlike(P.NOT_WS))
    zero = F.lit(0).cast("long")

    def step(a: Column, line: Column) -> Column:
        def placed(indent: Column) -> Column:
            outside = (a["at"] < 0) | (indent <= a["at"])
            opens = outside & line.rlike(P.PY_DEF)
            return A.record(
                at=F.when(opens, indent).when(outside, -1).otherwise(a["at"]),
                n=a["n"] + F.when(outside, zero).otherwise(_count(line, P.PY_DECISION)),
            )

        return A.let(F.length(F.regexp_extract(line, r"\A[ \t]*", 0)), placed)

    return F.aggregate(lines, A.record(at=F.lit(-1), n=zero), step)["n"]


def mean_complexity(code: Column, lang: Column) -> Column:
    functions = function_count(code, lang)
    return F.when(
        functions > 0, (decision_points(code, lang) + functions) / functions
    ).otherwise(F.lit(0.0))


def name_lengths(code: Column, lang: Column) -> Column:
    """Lengths of assigned or declared names; of attribute names in markup."""
    names = by_language(
        lang,
        F.regexp_extract_all(code, F.lit(P.ASSIGNED_NAME), F.lit(1)),
        F.regexp_extract_all(code, F.lit(P.ATTRIBUTE), F.lit(1)),
        F.regexp_extract_all(code, F.lit(P.ASSIGNED_NAME), F.lit(1)),
    )
    return F.transform(names, F.length)


def nesting(code: Column, lang: Column) -> Column:
    """struct<nodes, depth> of masked source: tags of markup; else blocks and tokens, by indentation
    and brackets in Python and by brackets elsewhere. The root is level 1."""

    def tree(n: Column) -> Column:
        return A.let(n, lambda x: A.record(nodes=x["seen"] + 1, depth=(x["top"] + 1).cast("long")))

    brackets = N.merged(F.array(N.summary(N.token_events(code))))
    return by_language(lang, tree(N.indented_summary(code)), run_depth(tag_steps(code)), tree(brackets))


def tag_steps(html: Column) -> Column:
    """+1 for a start tag, -1 for an end tag, 0 for a void or self-closed one."""
    tags = F.regexp_extract_all(html, F.lit(P.TAG), F.lit(0))
    return F.transform(
        tags,
        lambda t: F.when(t.startswith("</"), -1)
        .when(
            t.endswith("/>")
            | F.lower(F.regexp_extract(t, r"\A<([A-Za-z][A-Za-z0-9]*)", 1)).isin(P.VOID_TAGS),
            0,
        )
        .otherwise(1),
    )


def run_depth(steps: Column) -> Column:
    """One pass over +1, 0 and -1 steps."""
    zero = A.record(now=F.lit(0), top=F.lit(0), seen=F.lit(0))
    end = F.aggregate(
        steps,
        zero,
        lambda a, s: A.record(
            now=a["now"] + s,
            top=F.greatest(a["top"], a["now"] + F.greatest(s, F.when(s == 0, 1).otherwise(0))),
            seen=a["seen"] + F.when(s >= 0, 1).otherwise(0),
        ),
    )
    return A.let(
        end,
        lambda e: A.record(nodes=(e["seen"] + 1).cast("long"), depth=(e["top"] + 1).cast("long")),
    )


def loop_depth(code: Column) -> Column:
    """Deepest nesting of loops of masked source in brace languages; other blocks are transparent."""
    return N.merged(F.array(N.summary(N.loop_events(code))))["loops"].cast("long")
