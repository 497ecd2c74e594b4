"""Depth of nesting of sources of any size, measured by ranges of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import arrays as A
from quillmark.functions import code as C
from quillmark.functions import nesting as N

#: Lines of a range.
LINES = 2000


def _ranges(code: Column, lines: int) -> Column:
    """The lines of a text in ranges; joined again they are the text."""
    each = F.split(code, "\n")
    return A.let(each, lambda a: F.transform(
        F.sequence(F.lit(1), F.size(a), F.lit(lines)), lambda i: F.array_join(F.slice(a, i, lines), "\n")
    ))


def nesting(df: DataFrame, keys: list[str], src: str = "src", lang: str = "lang", lines: int = LINES) -> DataFrame:
    """(keys, n_nodes, max_depth, loop_depth) of every source; ``keys`` name a source and are not null.

    Sources are cut in ranges, each range is summed up in a row of its own, and only the summaries
    meet. A source that nests by indentation is cut before lines that are not indented; markup, whose
    tags may run over lines, is not cut. Blocks and
    tokens below the root are nodes, the root is at depth 1. A null source has no nesting: nulls.
    """
    language = F.col(lang)
    by_indent = language.isin(C.PY)
    masked = df.select(*keys, language.alias("lang"), C.masked(F.col(src), language).alias("code"))
    markup = language.isin(C.MARKUP)
    parts = F.when(by_indent, F.split("code", "\n(?=[^ \t\n])")).when(markup, F.array("code"))
    parts = parts.otherwise(_ranges(F.col("code"), lines))
    each = masked.select(*keys, "lang", F.posexplode_outer(parts).alias("part", "code"))
    # Ranges of large sources are dealt over the tasks; the hash is of ids, not of text.
    each = each.select(
        *keys, "part", F.when(by_indent, N.indented_summary(F.col("code"))).alias("indented"),
        F.when(markup, N.summary(N.tag_events(F.col("code")))).when(~by_indent, N.summary(N.token_events(F.col("code")))).alias("tokens"),
        F.when(~by_indent & ~markup, N.summary(N.loop_events(F.col("code")))).alias("braces"),
    )
    in_order = lambda c: F.transform(F.col("parts"), lambda p: p[c])
    rows = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "indented", "tokens", "braces"))).alias("parts"))
    none = F.expr("named_struct('seen', 0L, 'top', 0, 'loops', 0)")

    def joined(a: Column, x: Column) -> Column:
        return A.record(seen=a["seen"] + x["seen"], top=F.greatest(a["top"], x["top"]), loops=F.greatest(a["loops"], x["loops"]))

    first = F.col("parts")[0]
    total = (
        F.when(first["indented"].isNotNull(), F.aggregate(in_order("indented"), none, joined))
        .when(first["tokens"].isNotNull(), A.let(
            A.record(t=N.merged(in_order("tokens")), b=N.merged(in_order("braces"))),
            lambda x: A.record(seen=x["t"]["seen"], top=x["t"]["top"], loops=F.coalesce(x["b"]["loops"], F.lit(0))),
        ))
    )
    return rows.select(*keys, total.alias("n")).select(
        *keys, (F.col("n.seen") + 1).alias("n_nodes"), (F.col("n.top") + 1).cast("long").alias("max_depth"),
        F.col("n.loops").cast("long").alias("loop_depth"),
    )
