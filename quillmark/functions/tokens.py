"""Sentences, word tokens, kept terms and title words, all within one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import arrays as A
from quillmark.functions import patterns as P
from quillmark.functions import sqltext as Q
from quillmark.functions.constants import LANGUAGE_MARKERS, STOP_WORDS
from quillmark.functions.text import rewrite, words


def is_stop(word: Column) -> Column:
    return word.isin(STOP_WORDS)


def _member_of(names: list[str]):
    return lambda w: w.isin(names)


def regex_tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(P.WORD), F.lit(0))


def marked_sentences(col: Column) -> Column:
    """The text with a mark between sentences."""
    return rewrite(col, P.SENTENCE_BREAKS)


def split_marked(marked: Column) -> Column:
    """Sentences of a marked text, without surrounding white space."""
    stripped = F.transform(F.split(marked, P.MARK), lambda s: rewrite(s, P.STRIP))
    return F.filter(stripped, lambda s: s != "")


def sentence_pieces(col: Column) -> Column:
    """array<struct<size, lead, length, n_words>>: the pieces of a text between sentence breaks.

    ``size`` characters with the white space around, ``lead`` of it before; ``length`` is that of the
    sentence, 0 for a piece that holds none. The sizes add up to the text's length.
    """

    def measured(p: Column) -> Column:
        bare = rewrite(p, P.STRIP)
        return A.record(
            size=F.length(p),
            lead=F.length(p) - F.length(rewrite(p, P.STRIP[:1])),
            length=F.length(bare),
            n_words=F.size(words(bare)),
        )

    return F.transform(F.split(rewrite(col, P.SENTENCE_SPANS), P.MARK), measured)


def tokenise_marked(marked: Column) -> Column:
    """Word tokens of each sentence of a marked text: array<array<string>>."""
    per_sentence = F.transform(F.split(rewrite(marked, P.TOKEN_PADDING), P.MARK), words)
    return F.filter(per_sentence, lambda t: F.size(t) > 0)


def sentences(col: Column) -> Column:
    return split_marked(marked_sentences(col))


def sentence_tokens(col: Column) -> Column:
    return tokenise_marked(marked_sentences(col))


def word_tokens(col: Column) -> Column:
    return F.flatten(sentence_tokens(col))


def kept_tokens(text: str, fold_case: bool = False) -> Column:
    """Lower-cased word terms of the text column that are no stop words.

    The stop-word test looks at the original case, so a capitalised stop word is kept, unless
    ``fold_case`` asks for the test on the lower-cased word.
    """
    found = f"regexp_extract_all({text}, {Q.lit(P.WORD)}, 0)"
    kept = f"NOT {Q.one_of('w_', STOP_WORDS)}"
    if fold_case:
        return F.expr(f"filter(transform({found}, w_ -> lower(w_)), w_ -> {kept})")
    return F.expr(f"transform(filter({found}, w_ -> {kept}), w_ -> lower(w_))")


def document_profile(kept: Column, tokens: Column) -> Column:
    """struct<m, s1, s2>: number of distinct tokens, sum and sum of squares of their counts
    among the kept terms.

    Kept terms and distinct tokens are sorted together, each token with a zero byte at its end,
    so it follows the kept terms equal to it; one pass then reads off every count.
    """
    end = "\x00"

    def one_pass(types: Column) -> Column:
        zero = F.lit(0).cast("long")
        start = A.record(t=F.lit(""), run=zero, s1=zero, s2=zero)

        def step(a: Column, x: Column) -> Column:
            count = F.when(F.concat(a["t"], F.lit(end)) == x, a["run"]).otherwise(zero)
            return F.when(
                x.endswith(end),
                A.record(t=a["t"], run=a["run"], s1=a["s1"] + count, s2=a["s2"] + count * count),
            ).otherwise(
                A.record(
                    t=x,
                    run=F.when(x == a["t"], a["run"] + 1).otherwise(F.lit(1).cast("long")),
                    s1=a["s1"],
                    s2=a["s2"],
                )
            )

        marked = F.transform(types, lambda t: F.concat(t, F.lit(end)))
        return A.record(
            m=F.size(types).cast("long"),
            sums=F.aggregate(F.sort_array(F.concat(kept, marked)), start, step),
        )

    return A.let(F.array_distinct(tokens), one_pass)


def types_of_sentences(tokens: Column) -> Column:
    """Distinct word tokens of each sentence, the sentence being the group."""
    return F.flatten(
        F.transform(
            tokens,
            lambda ts, g: F.transform(
                F.array_distinct(ts), lambda t: A.record(t=t, g=g)
            ),
        )
    )


def type_profile(kept: Column, types: Column) -> Column:
    """Sums of term counts over types, per group.

    ``kept``: array<string>, the counted terms. ``types``: array<struct<t, g>>, distinct types of
    each group. Returns array<struct<m, s1, s2>>, one per group in group order: number of types,
    sum and sum of squares of the counts of the types. Occurrences and types are sorted together
    once, so each run of equal terms holds its count and the groups that ask for it.
    """
    occurrences = F.transform(
        kept, lambda w: A.record(t=w, g=F.lit(-1))
    )
    merged = F.sort_array(F.concat(occurrences, types))

    def per_run(s: Column) -> Column:
        def counts(starts: Column) -> Column:
            def one_run(p: Column, j: Column) -> Column:
                stop = F.coalesce(F.get(starts, j + 1), F.size(s))
                return A.let(
                    F.slice(s, p + 1, stop - p),
                    lambda run: A.let(
                        F.size(F.filter(run, lambda x: x["g"] < 0)).cast("long"),
                        lambda c: F.transform(
                            F.filter(run, lambda x: x["g"] >= 0),
                            lambda x: A.record(g=x["g"], c=c),
                        ),
                    ),
                )

            return F.sort_array(F.flatten(F.transform(starts, one_run)))

        return A.let(A.run_starts(s, lambda x: x["t"]), counts)

    def per_group(pairs: Column) -> Column:
        starts = A.run_starts(pairs, lambda x: x["g"])
        return A.let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: A.let(
                    F.slice(pairs, p + 1, F.coalesce(F.get(st, j + 1), F.size(pairs)) - p),
                    lambda run: A.record(
                        m=F.size(run).cast("long"),
                        s1=A.sum_long(run, lambda x: x["c"]),
                        s2=A.sum_long(run, lambda x: x["c"] * x["c"]),
                    ),
                ),
            ),
        )

    return A.let(A.let(merged, per_run), per_group)


def title_words(col: Column) -> Column:
    """Lower-cased words of a text that are no stop words, from which its title is chosen."""
    return F.filter(regex_tokens(F.lower(col)), lambda w: ~is_stop(w))


def title_by_lemma(col: Column, lemmas: Column, top: int = 5) -> Column:
    """Words of the text that are among its most frequent lemmas, joined by underscores.

    ``lemmas`` are those of ``title_words``. A text of fewer than six words keeps its words that are no
    stop words.
    """
    short = F.replace(
        F.regexp_replace(
            F.lower(F.array_join(F.filter(words(col), lambda w: ~is_stop(F.lower(w))), " ")),
            r"[^\p{L}\p{N}_\s\-]",
            "",
        ),
        F.lit(" "),
        F.lit("_"),
    )

    def long_title(ws: Column) -> Column:
        return A.let(
            top_terms(A.placed_term_counts(lemmas), top),
            lambda best: F.array_join(F.filter(ws, lambda w: F.array_contains(best, w)), "_"),
        )

    title = F.when(F.size(words(col)) < 6, short).otherwise(
        A.let(regex_tokens(F.lower(col)), long_title)
    )
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("untitled")).otherwise(title)


def top_terms(counts: Column, n: int) -> Column:
    """The n most frequent terms, ties by first appearance; input from ``placed_term_counts``."""
    ranked = F.sort_array(
        F.transform(
            counts,
            lambda c: A.record(k=-c["cnt"], p=c["first_pos"], t=c["term"]),
        )
    )
    return F.transform(F.slice(ranked, 1, n), lambda x: x["t"])


def title_by_frequency(col: Column, top: int = 5, width: int = 5) -> Column:
    """Most frequent longer words, joined by underscores and cut to ``width`` characters."""
    plain = F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]", "")
    kept = F.filter(words(plain), lambda w: ~is_stop(w) & (F.length(w) > 2))
    title = F.substring(F.array_join(top_terms(A.placed_term_counts(kept), top), "_"), 1, width)
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("untitled")).otherwise(title)


def chat_title(col: Column) -> Column:
    """Title from a first prompt: longer prompts lose their stop words (case kept)."""
    ws = words(col)
    return F.when(
        F.size(ws) > 3, F.array_join(F.filter(ws, lambda w: ~is_stop(w)), "_")
    ).otherwise(F.array_join(ws, "_"))


def detect_natural_language(col: Column) -> Column:
    """Language whose marker words weigh most in the text; null when none occurs."""
    every = [w for words_ in LANGUAGE_MARKERS.values() for w in words_]

    def best(ws: Column) -> Column:
        scores = []
        for lang, markers in LANGUAGE_MARKERS.items():
            weight = None
            for value in sorted(set(markers.values())):
                hit = [w for w, v in markers.items() if v == value]
                count = F.size(F.filter(ws, _member_of(hit))) * F.lit(value)
                weight = count if weight is None else weight + count
            scores.append(A.record(score=weight, lang=F.lit(lang)))
        return A.let(F.array_max(F.array(*scores)), lambda b: F.when(b["score"] > 0, b["lang"]))

    return A.let(F.filter(regex_tokens(F.lower(col)), lambda w: w.isin(every)), best)
