"""Array helpers that stay inside one row: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import sqltext as Q


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it many times, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def record(**fields: Column) -> Column:
    """A struct whose field names hold in every context, also beside a generator."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def run_starts(ordered: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """Positions in a sorted array at which the key changes."""
    marked = F.transform(
        ordered,
        lambda x, i: F.when(
            (i == 0) | ~key(F.get(ordered, i - 1)).eqNullSafe(key(x)), i
        ),
    )
    return F.filter(marked, lambda i: i.isNotNull())


def term_counts(terms: str) -> Column:
    """The array<string> column ``terms`` -> array<struct<term, cnt>> ordered by term.

    One sort of plain strings and one pass over the places where the term changes.
    """
    changes = "transform(s_, (x_, i_) -> if(i_ = 0 OR x_ <> get(s_, i_ - 1), i_, NULL))"
    counted = (
        "transform(at_, (p_, j_) -> named_struct('term', get(s_, p_), "
        "'cnt', CAST(coalesce(get(at_, j_ + 1), size(s_)) - p_ AS BIGINT)))"
    )
    per_run = Q.let(f"filter({changes}, i_ -> i_ IS NOT NULL)", "at_", counted)
    return F.expr(Q.let(f"sort_array({terms})", "s_", per_run))


def placed_term_counts(terms: Column) -> Column:
    """array<string> -> array<struct<term, cnt, first_pos>> ordered by term."""
    tagged = F.sort_array(F.transform(terms, lambda t, i: record(t=t, i=i)))

    def count_runs(s: Column) -> Column:
        return let(
            run_starts(s, lambda x: x["t"]),
            lambda starts: F.transform(
                starts,
                lambda p, j: record(
                    term=F.get(s, p)["t"],
                    cnt=(F.coalesce(F.get(starts, j + 1), F.size(s)) - p).cast("long"),
                    first_pos=F.get(s, p)["i"].cast("long"),
                ),
            ),
        )

    return let(tagged, count_runs)


def distinct_count(terms: Column) -> Column:
    return F.size(F.array_distinct(terms)).cast("long")


def sum_long(values: Column, value_of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + value_of(x).cast("long"))


def moments(values: Column) -> Column:
    """Integer array -> struct<n, s1, s2>: count, sum and sum of squares."""
    zero = F.lit(0).cast("long")
    return record(
        n=F.size(values).cast("long"),
        s1=F.aggregate(values, zero, lambda a, x: a + x.cast("long")),
        s2=F.aggregate(values, zero, lambda a, x: a + x.cast("long") * x.cast("long")),
    )


def mean_of(n: Column, s1: Column) -> Column:
    return F.when(n > 0, s1 / n).otherwise(F.lit(0.0))


def std_of(n: Column, s1: Column, s2: Column) -> Column:
    """Population standard deviation from integer sums."""
    return F.when(n > 0, F.sqrt((n * s2 - s1 * s1).cast("double")) / n).otherwise(F.lit(0.0))


def ngrams(terms: Column, n: int) -> Column:
    """Space-joined n-grams; empty when the array is shorter than n."""
    if n == 1:
        return terms
    return let(
        terms,
        lambda a: F.when(
            F.size(a) >= n,
            F.transform(
                F.sequence(F.lit(0), F.size(a) - n),
                lambda i: F.concat_ws(" ", *[F.get(a, i + k) for k in range(n)]),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
