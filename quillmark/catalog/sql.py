"""Pieces of SQL shared by the checks, in the dialect of the checking engine."""

from __future__ import annotations

import re

from quillmark.functions import patterns as P
from quillmark.functions.constants import CLOSED_CLASS, CONTENT_TAGS, STOP_WORDS, SUFFIX_TAGS


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(words) -> str:
    return "(" + ", ".join(text(w) for w in words) + ")"


def rewrite(expr: str, chain: list[tuple[str, str]]) -> str:
    for pattern, replacement in chain:
        back = re.sub(r"\$(\d)", r"\\\1", replacement.replace("\\", "\\\\"))
        expr = f"regexp_replace({expr}, {text(pattern)}, {text(back)}, 'g')"
    return expr


def substitute(expr: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, {text(old)}, {text(new)})"
    return expr


def clean(expr: str = "text") -> str:
    return f"coalesce({rewrite(expr, P.CLEAN)}, '')"


def words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {text(P.WS + '+')}), lambda w_: w_ <> '')"


def all_matches(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {text(pattern)}, {group})"


def matches(expr: str, pattern: str) -> str:
    return f"len({all_matches(expr, pattern)})"


def marked(expr: str) -> str:
    return rewrite(expr, P.SENTENCE_BREAKS)


def sentences(expr: str) -> str:
    stripped = rewrite("s_", P.STRIP)
    parts = f"string_split({marked(expr)}, chr(1))"
    return f"list_filter(list_transform({parts}, lambda s_: {stripped}), lambda s_: s_ <> '')"


def sentence_tokens(expr: str) -> str:
    parts = f"string_split({rewrite(marked(expr), P.TOKEN_PADDING)}, chr(1))"
    return f"list_filter(list_transform({parts}, lambda s_: {words('s_')}), lambda t_: len(t_) > 0)"


STOP = names(STOP_WORDS)


def token_tables(body: str = "text", source: str = "documents", key: str = "doc_id") -> str:
    """CTEs d (key, text, toks), tok (key, sent_id, tok_id, word), kept (key, pos, term)."""
    return f"""
    d0 AS MATERIALIZED (SELECT {key}, {body} AS text FROM {source}),
    d AS MATERIALIZED (SELECT {key}, text, {sentence_tokens('text')} AS toks FROM d0),
    tok AS MATERIALIZED (
      SELECT {key}, sent_id, generate_subscripts(ws, 1) AS tok_id, unnest(ws) AS word
      FROM (SELECT {key}, generate_subscripts(toks, 1) - 1 AS sent_id, unnest(toks) AS ws FROM d)),
    kept AS MATERIALIZED (
      SELECT {key}, pos, lower(w) AS term
      FROM (SELECT {key}, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w
            FROM (SELECT {key}, {all_matches('text', P.WORD)} AS ws FROM d0))
      WHERE w NOT IN {STOP})"""


def tag(word: str = "word", first: str = "(tok_id = 1)") -> str:
    closed = "".join(f" WHEN lower({word}) IN {names(ws)} THEN {text(t)}" for t, ws in CLOSED_CLASS.items())
    name = f"NOT {first} AND left({word}, 1) <> left(lower({word}), 1)"
    alpha = f"regexp_matches({word}, {text(r'^\p{L}[\p{L}\-]*$')})"
    suffix = "".join(
        f" WHEN {alpha} AND ends_with(lower({word}), {text(s)}) AND length({word}) > {len(s) + 1} THEN {text(t)}"
        for s, t in SUFFIX_TAGS
    )
    return f"""CASE {closed}
      WHEN {word} IN ('?', '!') THEN '.'
      WHEN {word} IN (';', '--', '…', '—', '–') THEN ':'
      WHEN regexp_matches({word}, '^\\.\\.+$') THEN ':'
      WHEN NOT regexp_matches({word}, '[\\p{{L}}\\p{{N}}]') THEN
        CASE WHEN length({word}) = 1 OR {word} IN ('``', '''''') THEN {word} ELSE 'SYM' END
      WHEN regexp_matches({word}, '^[\\p{{N}}.,]+$') THEN 'CD'
      WHEN {name} THEN 'NNP' {suffix} ELSE 'NN' END"""


CONTENT = names(CONTENT_TAGS)


def coarse(tag_: str = "tag") -> str:
    return (
        f"CASE left({tag_}, 1) WHEN 'J' THEN 'a' WHEN 'V' THEN 'v' WHEN 'R' THEN 'r' ELSE 'n' END"
    )
