"""Annotation of prose: one row per document or per sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import arrays as A
from quillmark.functions import tagging, text, tokens
from quillmark.operators import lexical, opinion, syntax
from quillmark.sources.shared import settle

#: Syntax columns of a document and of a sentence, with their types.
DOCUMENT_SYNTAX = {
    "depth": "double", "head": "double", "sub_clauses": "double", "coord_clauses": "double", "branching": "double", "balanced": "double",
}
SENTENCE_SYNTAX = DOCUMENT_SYNTAX | {"depth": "long", "sub_clauses": "long", "coord_clauses": "long", "balanced": "boolean"}


#: Two hashes of a row's id and text: rows that agree in them have the same words and lemmas.
KEY = ["_k1", "_k2"]


def _texts(df: DataFrame, label: Column, text_col: str, clean: bool) -> DataFrame:
    """(doc_id, label, text, keys): the text that is analysed."""
    body = text.clean_text(F.col(text_col)) if clean else F.coalesce(text_col, F.lit(""))
    rows = df.select("doc_id", label.alias("label"), body.alias("text"))
    return rows.withColumns({"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64(F.lit(1), "text", "doc_id")})


def _analysed(rows: DataFrame) -> DataFrame:
    """Rows with ``sents``, ``toks`` and ``tags`` of their text, computed within the row."""
    return (
        rows.withColumn("_marked", tokens.marked_sentences(F.col("text")))
        .withColumn("sents", tokens.split_marked(F.col("_marked")))
        .withColumn("toks", tokens.tokenise_marked(F.col("_marked")))
        .drop("_marked")
        .withColumn("tags", tagging.tag_sentences("toks"))
    )


def words_of(df: DataFrame, text_col: str = "text", clean: bool = True) -> DataFrame:
    """(word): the vocabulary that the texts give."""
    return lexical.word_table(_texts(df, F.lit(None), text_col, clean), "text")


def candidates_of(df: DataFrame, text_col: str = "text", clean: bool = True) -> DataFrame:
    """(doc_id, candidate): what the words of each document may change to, if it is a known word."""
    each = _tokens(_analysed(_texts(df, F.lit(None), text_col, clean)), ["doc_id"])
    found = each.select("doc_id", F.explode(lexical.detached(F.col("word"), F.col("class"))).alias("_c"))
    return found.select("doc_id", F.col("_c.candidate").alias("candidate")).distinct()


def _tokens(analysed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sent_id, tok_id, word, class) of every token."""
    return (
        analysed.select(*keys, F.posexplode(F.arrays_zip("toks", "tags")).alias("sent_id", "_s"))
        .select(*keys, "sent_id", F.posexplode(F.arrays_zip("_s.toks", "_s.tags")).alias("tok_id", "_t"))
        .select(*keys, "sent_id", "tok_id", F.col("_t.toks").alias("word"), tagging.coarse_class(F.col("_t.tags")).alias("class"))
    )


def lemmatised(
    df: DataFrame, label: Column, text_col: str = "text", clean: bool = True, vocabulary: DataFrame | None = None,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, label, text, sents, toks, tags, lemmas): the analysis that all jobs share.

    ``vocabulary`` (word) holds the words that may be lemmas; without one, the words of the texts. The
    tokens that may change are joined with it by what they change to, and only the changes come back
    to their row: the analysed texts are written once and shuffled once, by row. Ids may be
    null or repeated. Null and empty texts have no sentences. With a ``lexicon`` (term, score) there
    are columns ``sentiment`` and ``sentence_sentiments``, as in ``opinion.scored``.
    """
    return _lemmatised(df, label, text_col, clean, vocabulary, lexicon)[0].drop(*KEY)


def _lemmatised(
    df: DataFrame, label: Column, text_col: str, clean: bool, vocabulary: DataFrame | None, lexicon: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """As ``lemmatised``, with the keys by which the rows are dealt; and the texts as they were written, with these keys."""
    # Splitting and tagging are the costly part: done once, and every pass reads the columns it needs.
    rows = _analysed(_texts(df, label, text_col, clean))
    if lexicon is not None:
        rows = opinion.scored(rows, lexicon, KEY)
    rows = settle(rows, "analysed")
    if vocabulary is None:
        vocabulary = rows.select(F.explode(F.array_distinct(F.flatten("toks"))).alias("word")).distinct()
    changed = lexical.changed_lemmas(_tokens(rows, KEY), [*KEY, "sent_id", "tok_id"], vocabulary, KEY)
    by_sentence = changed.groupBy(*KEY, "sent_id").agg(F.map_from_entries(F.collect_list(F.struct("tok_id", "lemma"))).alias("_m"))
    by_row = by_sentence.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("sent_id", "_m"))).alias("_changed"))
    # Words and tags of a sentence hold no blank and are never empty: as one text they take half the room in a shuffle.
    found = rows.withColumns({c: F.transform(c, lambda t: F.array_join(t, " ")) for c in ("toks", "tags")}).join(by_row, KEY, "left")
    found = found.withColumns({c: F.transform(c, lambda t: F.split(t, " ")) for c in ("toks", "tags")})
    lemmas = (
        "transform(toks, (ts_, s_) -> get(transform(array(_changed[s_]), m_ -> "
        "if(m_ IS NULL, ts_, transform(ts_, (w_, i_) -> coalesce(m_[i_], w_)))), 0))"
    )
    return found.withColumn("lemmas", F.expr(lemmas)).drop("_changed"), rows.select("doc_id", "text", *KEY)


def _population_std(values: Column) -> Column:
    """Population standard deviation of a small array of doubles, two passes."""

    def around(mean: Column, xs: Column) -> Column:
        return F.sqrt(
            F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(xs)
        )

    return F.when(
        F.size(values) > 0,
        A.let(
            values,
            lambda xs: A.let(
                F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs),
                lambda m: around(m, xs),
            ),
        ),
    ).otherwise(F.lit(0.0))


def _no_syntax(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})


def annotate_documents(
    df: DataFrame,
    label: Column,
    text_col: str = "text",
    clean: bool = True,
    normalise_head: bool = True,
    lexicon: DataFrame | None = None,
    vocabulary: DataFrame | None = None,
    parses: DataFrame | None = None,
) -> DataFrame:
    """One row per document with its lexical, sentiment and syntax numbers.

    An empty text keeps its row with zero numbers. ``parses`` is a dependency-edge table (see
    ``operators.syntax``) whose offsets are into the analysed text; the syntax columns of documents
    without a parse, and of all without ``parses``, are null. A table holds one parse of an id:
    rows that repeat an id are all aligned with it. ``vocabulary`` as in ``lemmatised``; ``lexicon``
    is a table (term, score) of words and phrases, by default a small one.
    """
    lexicon = opinion.built_in(df.sparkSession) if lexicon is None else lexicon
    doc, texts = _lemmatised(df, label, text_col, clean, vocabulary, lexicon)
    staged = (
        doc.withColumn("_w", F.flatten("toks"))
        .withColumn("_k", tokens.kept_tokens("text"))
        .withColumn("_n", F.size("_k").cast("long"))
        .withColumn("_nw", F.size("_w").cast("long"))
        .withColumn("_len", A.moments(F.transform("toks", lambda t: F.size(t))))
        .withColumn("_prof", tokens.document_profile(F.col("_k"), F.col("_w")))
    )
    m, s1, s2 = F.col("_prof.m"), F.col("_prof.sums.s1"), F.col("_prof.sums.s2")
    out = staged.select(
        *KEY,
        "doc_id",
        "text",
        F.flatten("tags").alias("pos"),
        F.flatten("lemmas").alias("lemmas"),
        A.mean_of(F.col("_len.n"), F.col("_len.s1")).alias("mean_sentence_length"),
        A.std_of(F.col("_len.n"), F.col("_len.s1"), F.col("_len.s2")).alias("std_sentence_length"),
        tagging.lexical_density(F.flatten("tags")).alias("lexical_density"),
        *lexical.frequency_columns(m, F.col("_n"), s1, s2),
        "sentiment",
        _population_std(
            F.transform("sentence_sentiments", lambda s: F.abs(s - F.col("sentiment")))
        ).alias("sentiment_deviation"),
        A.mean_of(F.col("_nw"), A.distinct_count(F.col("_w"))).alias("ttr"),
        "label",
        (F.col("_nw") == 0).alias("is_empty"),
    )
    names = [*out.columns[2:-2], *DOCUMENT_SYNTAX, *out.columns[-2:]]
    if parses is None:
        return _no_syntax(out, DOCUMENT_SYNTAX).select(*names)
    # Joined by the keys by which the rows lie already, so that they are not shuffled again.
    spans = syntax.sentence_spans(texts, carry=KEY)
    parsed = syntax.document_syntax(syntax.sentence_syntax(spans, parses), normalise_head, KEY)
    parsed = parsed.withColumn("depth", F.col("depth").cast("double"))
    return out.join(parsed, KEY, "left").select(*names)


def annotate_sentences(
    df: DataFrame,
    label: Column,
    text_col: str = "text",
    clean: bool = False,
    lexicon: DataFrame | None = None,
    vocabulary: DataFrame | None = None,
    parses: DataFrame | None = None,
) -> DataFrame:
    """One row per sentence; type frequencies are looked up in the whole document.

    ``parses`` and ``vocabulary`` as in ``annotate_documents``.
    """
    lexicon = opinion.built_in(df.sparkSession) if lexicon is None else lexicon
    rows, texts = _lemmatised(df, label, text_col, clean, vocabulary, lexicon)
    if parses is None:
        of_sentences = F.lit(None).cast(f"map<long, struct<{', '.join(f'{c}: {t}' for c, t in SENTENCE_SYNTAX.items())}>>")
        rows = rows.withColumn("_syntax", of_sentences)
    else:
        # Numbers come to the document's row, by the keys by which it lies already: no sentence is shuffled.
        spans = syntax.sentence_spans(texts, carry=KEY)
        parsed = syntax.sentence_syntax(spans, parses).select(*KEY, "sent_id", F.struct(*SENTENCE_SYNTAX).alias("_s"))
        by_row = parsed.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("sent_id", "_s"))).alias("_syntax"))
        rows = rows.join(by_row, KEY, "left")
    doc = (
        rows.withColumn("_k", tokens.kept_tokens("text"))
        .withColumn("_w", F.flatten("toks"))
        .withColumn("_ttr", A.mean_of(F.size("_w").cast("long"), A.distinct_count(F.col("_w"))))
        .withColumn("_n", F.size("_k").cast("long"))
        .withColumn("_prof", tokens.type_profile(F.col("_k"), tokens.types_of_sentences(F.col("toks"))))
        .withColumn("_tree", F.transform("sents", lambda _, i: F.try_element_at("_syntax", i.cast("long"))))
    )
    rows = doc.select(
        "doc_id",
        "label",
        "_ttr",
        "_n",
        F.col("sentiment").alias("_doc"),
        F.posexplode(F.arrays_zip("sents", "toks", "tags", "lemmas", "_prof", "sentence_sentiments", "_tree")).alias("sent_id", "_s"),
    ).select("*", F.col("_s.sentence_sentiments").alias("sentiment"))
    prof = F.col("_s._prof")
    return rows.select(
        "doc_id",
        F.col("sent_id").cast("long").alias("sent_id"),
        F.col("_s.sents").alias("sentence"),
        F.col("_s.tags").alias("pos"),
        F.col("_s.lemmas").alias("lemmas"),
        tagging.lexical_density(F.col("_s.tags")).alias("lexical_density"),
        *lexical.frequency_columns(prof["m"], F.col("_n"), prof["s1"], prof["s2"]),
        "sentiment",
        F.abs(F.col("sentiment") - F.col("_doc")).alias("sentiment_deviation"),
        F.col("_ttr").alias("document_ttr"),
        F.size("_s.toks").alias("sentence_length"),
        *[F.col(f"_s._tree.{c}").alias(c) for c in SENTENCE_SYNTAX],
        "label",
    )
