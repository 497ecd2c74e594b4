"""Part-of-speech tags by word list, suffix and shape, and the numbers built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import arrays as A
from quillmark.functions import sqltext as Q
from quillmark.functions.constants import CLOSED_CLASS, CONTENT_TAGS, SUFFIX_TAGS

# The two quote tokens; other marks longer than one character are symbols, so the
# set of tags is bounded.
QUOTES = ["``", "''"]


def tag_word_sql(word: str, first: str) -> str:
    """SQL text of the Penn tag of ``word``; ``first`` tells whether it opens its sentence."""
    closed = Q.cases([(Q.one_of("low_", ws), Q.lit(t)) for t, ws in CLOSED_CLASS.items()], "NULL")
    every = [w for members in CLOSED_CLASS.values() for w in members]
    name_like = f"NOT ({first}) AND left({word}, 1) <> left(low_, 1)"
    plain = [(name_like, "'NNP'")] + [
        (f"endswith(low_, {Q.lit(s)}) AND length({word}) > {len(s) + 1}", Q.lit(t)) for s, t in SUFFIX_TAGS
    ]
    other = [
        (Q.one_of(word, "?!"), "'.'"),
        (Q.one_of(word, [";", "--", "…", "—", "–"]), "':'"),
        (f"{word} RLIKE {Q.lit(r'\A\.\.+\z')}", "':'"),
        (f"NOT {word} RLIKE {Q.lit(r'[\p{L}\p{N}]')}", f"if(length({word}) = 1 OR {Q.one_of(word, QUOTES)}, {word}, 'SYM')"),
        (f"{word} RLIKE {Q.lit(r'\A[\p{N}.,]+\z')}", "'CD'"),
        (name_like, "'NNP'"),
    ]
    body = Q.cases(
        [
            (Q.one_of("low_", every), closed),
            (f"{word} RLIKE {Q.lit(r'\A\p{L}[\p{L}\-]*\z')}", Q.cases(plain, "'NN'")),
        ],
        Q.cases(other, "'NN'"),
    )
    return Q.let(f"lower({word})", "low_", body)


def tag_sentences(tokens: str) -> Column:
    """Tags, array<array<string>>, of the word column or expression ``tokens`` of that type."""
    return F.expr(f"transform({tokens}, ts_ -> transform(ts_, (w_, i_) -> {tag_word_sql('w_', 'i_ = 0')}))")


def coarse_class(tag: Column) -> Column:
    """Adjective, verb, noun or adverb by the first letter of the tag; noun otherwise."""
    return (
        F.when(tag.startswith("J"), "a")
        .when(tag.startswith("V"), "v")
        .when(tag.startswith("R"), "r")
        .otherwise("n")
    )


def coarse_class_sql(tag: str) -> str:
    return f"CASE left({tag}, 1) WHEN 'J' THEN 'a' WHEN 'V' THEN 'v' WHEN 'R' THEN 'r' ELSE 'n' END"


def content_count(tags: Column) -> Column:
    return F.size(F.filter(tags, lambda t: t.isin(CONTENT_TAGS))).cast("long")


def lexical_density(tags: Column) -> Column:
    return A.mean_of(F.size(tags).cast("long"), content_count(tags))
