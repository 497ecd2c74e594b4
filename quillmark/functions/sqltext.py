"""Building blocks for SQL expression text.

Expressions with large word sets are written as text: the JVM parses a set at once, where a
Column call would send every literal on its own.
"""

from __future__ import annotations

from collections.abc import Iterable


def lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(x: float) -> str:
    return f"{float(x)!r}D"


def one_of(expr: str, names: Iterable[str]) -> str:
    return f"{expr} IN ({', '.join(lit(n) for n in names)})"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once under ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def rewrite(expr: str, chain: list[tuple[str, str]]) -> str:
    for pattern, replacement in chain:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(replacement)})"
    return expr


def cases(pairs: Iterable[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"
