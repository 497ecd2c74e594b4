"""String expressions: cleaning, slugs, de-tokenising, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import patterns as P


def rewrite(col: Column, chain: list[tuple[str, str]]) -> Column:
    for pattern, replacement in chain:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def substitute(col: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def strip(col: Column) -> Column:
    return rewrite(col, P.STRIP)


def clean_text(col: Column) -> Column:
    """Normalise quotes and marks; null becomes the empty text."""
    return F.coalesce(rewrite(col, P.CLEAN), F.lit(""))


def detokenise_spaced(col: Column) -> Column:
    return substitute(col, P.DETOK_SPACED)


def detokenise_doubled(col: Column) -> Column:
    return substitute(col, P.DETOK_DOUBLED)


def strip_list_literal(col: Column) -> Column:
    return F.translate(col, "[]',", "")


def list_literal(col: Column) -> Column:
    """Read a bracketed list of quoted strings, either quote style, into array<string>."""
    items = F.regexp_extract_all(col, F.lit(r"""('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")"""), F.lit(1))
    return F.transform(
        items,
        lambda s: F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), r"\\(.)", "$1"),
    )


def write_list_literal(col: Column) -> Column:
    """Write array<string> as a bracketed list, quoting an item that holds ' with \"."""

    def quoted(s: Column) -> Column:
        safe = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        return F.when(
            s.contains("'") & ~s.contains('"'), F.concat(F.lit('"'), safe, F.lit('"'))
        ).otherwise(F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(col, quoted), ", "), F.lit("]"))


def words(col: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(col, P.WS + "+"), lambda w: w != "")


def head_words(col: Column, n: int = 20) -> Column:
    return F.array_join(F.slice(words(col), 1, n), " ")


def slug(col: Column) -> Column:
    return F.coalesce(rewrite(col, P.SLUG), F.lit("untitled"))


def discussion_prompt(topic: Column) -> Column:
    return F.concat(F.lit("Lets discuss "), topic, F.lit(". What are your thoughts?"))


def code_prompt(task: Column, language: Column) -> Column:
    return F.concat(
        F.lit("LANGUAGE:"), language, F.lit("\nTASK:"), task, F.lit("\nONLY OUTPUT RAW CODE")
    )


def prompt_request(request: Column, language: Column) -> Column:
    return F.concat(
        F.lit("Generate a short prompt with instructions to create code"),
        F.coalesce(F.concat(F.lit(" in "), language), F.lit("")),
        F.lit(" based on this request: "),
        request,
    )


def role_instruction(role: Column) -> Column:
    return F.when(role.startswith("you are a"), role).otherwise(
        F.concat(F.lit("you are a(n) "), role)
    )
