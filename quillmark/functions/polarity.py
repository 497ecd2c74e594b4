"""Lexicon polarity of a text in [-1, 1], after the published valence rules.

A word or phrase of the lexicon counts with its score, raised when written in capitals in a text of mixed
case, moved by degree words among the three words before it, turned by a negation there, halved
before and raised by half after "but"; exclamation and question marks add to the sum, which is
then squashed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import patterns as P
from quillmark.functions import sqltext as Q

CONTRACTED_NOT = "n't"
_OUTER = r"[^\p{L}\p{N}\s\x0B\x1C-\x1F\x85\p{Z}]"
EDGE_MARKS = [
    (rf"(\A|{P.WS}){_OUTER}+", "$1"),
    (rf"{_OUTER}+({P.WS}|\z)", "$1"),
]


# The same where a blank is the only white space, and a line end parts sentences.
_NO_BLANK = rf"[{P.WS}&&[^ ]]"
_EDGES = [(r"(\A|[ \n])[^\p{L}\p{N} \n]+", "$1"), (r"[^\p{L}\p{N} \n]+([ \n]|\z)", "$1")]


def words_sql(text: str) -> str:
    """array<struct<w, shout>>: lower-cased words without outer marks, and whether they are in
    capitals. Words of one character are dropped."""
    found = f"split({Q.rewrite(text, EDGE_MARKS)}, {Q.lit(P.WS + '+')})"
    fields = "named_struct('w', low_, 'shout', w_ <> low_ AND w_ = upper(w_))"
    return f"transform(filter({found}, w_ -> length(w_) > 1), w_ -> {Q.let('lower(w_)', 'low_', fields)})"


def items_sql(words: str, found: str) -> str:
    """array<struct<w, shout, v>>: the words of a sentence, each term of the lexicon as one of them.

    ``found``: map<place, struct<size, score>>, or null; ``v`` is null outside the lexicon.
    """
    plain = "named_struct('w', {x}.w, 'shout', {x}.shout, 'v', CAST(NULL AS DOUBLE))"
    covered = f"exists(map_entries({found}), e_ -> e_.key < y_.i AND y_.i < e_.key + e_.value.size)"
    term = Q.let(
        f"slice({words}, y_.i + 1, h_.size)",
        "run_",
        "named_struct('w', array_join(transform(run_, z_ -> z_.w), ' '), 'shout', forall(run_, z_ -> z_.shout), 'v', h_.score)",
    )
    item = Q.let(f"{found}[y_.i]", "h_", f"if(h_ IS NULL, {plain.format(x='y_.x')}, {term})")
    placed = f"transform({words}, (x_, i_) -> named_struct('x', x_, 'i', i_))"
    return (
        f"if({found} IS NULL, transform({words}, x_ -> {plain.format(x='x_')}), "
        f"transform(filter({placed}, y_ -> NOT {covered}), y_ -> {item}))"
    )


def _boost(word: str) -> str:
    return Q.cases(
        [
            (Q.one_of(word, K.BOOSTERS_UP), Q.number(K.BOOST)),
            (Q.one_of(word, K.BOOSTERS_DOWN), Q.number(-K.BOOST)),
        ],
        "0D",
    )


def _word_score(words: str, mixed: str, x: str, i: str) -> str:
    sign = f"if({x}.v < 0, -1D, 1D)"
    score = f"({x}.v + if({mixed} AND {x}.shout, {sign} * {Q.number(K.CAPS_BOOST)}, 0D))"
    for back, damping in enumerate(K.DAMPING, start=1):
        prev = f"get({words}, {i} - {back})"
        counts = f"({prev} IS NOT NULL AND {prev}.v IS NULL)"
        moved = f"if({counts}, {sign} * {_boost(f'{prev}.w')} * {Q.number(damping)}, 0D)"
        negated = f"{Q.one_of(f'{prev}.w', K.NEGATIONS)} OR contains({prev}.w, {Q.lit(CONTRACTED_NOT)})"
        score = f"(({score} + {moved}) * if({counts} AND ({negated}), {Q.number(K.NEGATION)}, 1D))"
    degree = Q.one_of(f"{x}.w", K.BOOSTERS_UP + K.BOOSTERS_DOWN)
    return f"CASE WHEN {x}.v IS NULL OR {degree} THEN 0D ELSE {score} END"


def _emphasis(text: str) -> str:
    def occurrences(mark: str) -> str:
        return f"(length({text}) - length(replace({text}, '{mark}', '')))"

    asks = occurrences("?")
    return (
        f"(least({occurrences('!')}, 4) * {Q.number(K.EXCLAIM)} + "
        f"CASE WHEN {asks} <= 1 THEN 0D WHEN {asks} <= 3 THEN {asks} * 0.18D ELSE 0.96D END)"
    )


def squashed_sql(text: str, total: str) -> str:
    """Polarity of ``text`` from the sum of its scored words, rounded to four places."""
    amplified = f"CASE WHEN sum_ > 0 THEN sum_ + {_emphasis(text)} WHEN sum_ < 0 THEN sum_ - {_emphasis(text)} ELSE 0D END"
    rounded = Q.let(amplified, "t_", f"round(t_ / sqrt(t_ * t_ + {Q.number(K.NORMALISER)}), 4)")
    return Q.let(total, "sum_", Q.let(rounded, "r_", "if(r_ = 0, 0D, r_)"))


def compound_sql(text: str, scored_words: str) -> str:
    """Polarity of ``text`` from its scored words, rounded to four places."""
    context = (
        "named_struct('mixed', size(filter(ws_, y_ -> y_.shout)) BETWEEN 1 AND size(ws_) - 1, "
        "'but', array_position(transform(ws_, y_ -> y_.w), 'but') - 1)"
    )
    weight = "CASE WHEN c_.but < 0 OR i_ = c_.but THEN 1D WHEN i_ < c_.but THEN 0.5D ELSE 1.5D END"
    scores = f"transform(ws_, (x_, i_) -> {_word_score('ws_', 'c_.mixed', 'x_', 'i_')} * {weight})"
    total = Q.let(context, "c_", f"aggregate({scores}, 0D, (a_, y_) -> a_ + y_)")
    return Q.let(scored_words, "ws_", f"if(exists(ws_, y_ -> y_.v IS NOT NULL), {squashed_sql(text, total)}, 0D)")


def plain_words(sentences: str) -> Column:
    """The words of an array of sentences between blanks, as in ``words_sql`` but with those of one character;
    a line end stands as a word between two sentences."""
    # White space other than blanks becomes blanks, so that a line end is free to part the sentences.
    joined = f"replace(regexp_replace(array_join({sentences}, {Q.lit(P.MARK)}), {Q.lit(_NO_BLANK)}, ' '), {Q.lit(P.MARK)}, '\n')"
    return F.expr(f"replace({Q.rewrite(joined, _EDGES)}, '\n', ' \n ')")


def score_sentences(sentences: str, found: str) -> Column:
    """Items of each sentence of an array column; ``found``: map of a sentence's terms, or null."""
    words = f"transform({sentences}, s_ -> {words_sql('s_')})"
    items = Q.let(f"{found}[n_]", "m_", items_sql("o_", "m_"))
    return F.expr(f"transform({words}, (o_, n_) -> {items})")


def document_polarity(text: str, sentence_words: str) -> Column:
    """Polarity of a text from the scored words of its sentences."""
    return F.expr(compound_sql(text, f"flatten({sentence_words})"))


def sentence_polarities(sentences: str, sentence_words: str) -> Column:
    pairs = f"zip_with({sentences}, {sentence_words}, (s_, o_) -> {compound_sql('s_', 'o_')})"
    return F.expr(pairs)
