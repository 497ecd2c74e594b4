"""Valence of words and phrases from a lexicon table (term, score).

Terms have one word or several, in lower case and with single blanks. The longest term at a place counts, from
left to right, and the words that it covers count no more. Tasks hold a lexicon of bounded size and score
strips of texts (``functions.valence``). For a larger one, a table of prefixes, first words with the length of
the longest term that begins so, tells where a term may begin; only there are terms put together and looked up.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import polarity, tokens, valence
from quillmark.functions import text as T
from quillmark.operators.scale import table_bytes
from quillmark.sources.shared import settle

#: Bytes of a lexicon that tasks hold as a whole; as words of Python it takes some four times as much.
LEXICON_BYTES = 8 * 1024 * 1024


def built_in(spark: SparkSession) -> DataFrame:
    """The small lexicon that is used without a table of one's own."""
    return spark.createDataFrame(list(K.POLARITY.items()), "term string, score double")


def normal(lexicon: DataFrame) -> DataFrame:
    """(term, score, size): terms in lower case with single blanks; of repeated ones the highest score."""
    terms = lexicon.select(T.words(F.lower("term")).alias("_w"), F.col("score").cast("double").alias("score"))
    terms = terms.where((F.size("_w") > 0) & F.col("score").isNotNull())
    return terms.groupBy(F.array_join("_w", " ").alias("term"), F.size("_w").alias("size")).agg(F.max("score").alias("score"))


def prefixes(terms: DataFrame) -> DataFrame:
    """(first, longest): first words of terms and the words of the longest term that begins so."""
    return terms.groupBy(F.substring_index("term", " ", 1).alias("first")).agg(F.max("size").alias("longest"))


def found_terms(texts: DataFrame, keys: list[str], sentences: str, lexicon: DataFrame) -> DataFrame:
    """(keys, found): map<sentence, map<place, struct<size, score>>> of the terms in each text.

    ``sentences`` is an array column. Texts without a term have no row. Texts with equal keys must be
    equal. Words are counted from 0 within a sentence. The lexicon may be of any size: both look-ups
    are joins.
    """
    terms = normal(lexicon)
    longest = terms.agg(F.max("size")).first()[0] or 1
    each = texts.select(*keys, F.posexplode(sentences).alias("sent_id", "_s"))
    words = each.select(*keys, "sent_id", F.expr(polarity.words_sql("_s")).alias("_w"))
    ahead = F.expr(f"transform(_w, (x_, i_) -> transform(slice(_w, i_ + 1, {longest}), y_ -> y_.w))")
    each = words.select(*keys, "sent_id", F.posexplode(ahead).alias("pos", "_ahead"))
    begun = each.withColumn("first", F.col("_ahead")[0]).join(prefixes(terms), "first")
    sizes = F.sequence(F.lit(1), F.least("longest", F.size("_ahead")))
    candidates = begun.select(*keys, "sent_id", "pos", "_ahead", F.explode(sizes).alias("size")).select(
        *keys, "sent_id", "pos", "size", F.array_join(F.slice("_ahead", F.lit(1), F.col("size")), " ").alias("term")
    )
    met = candidates.join(terms.select("term", "score"), "term")
    best = met.groupBy(*keys, "sent_id", "pos").agg(F.max(F.struct("size", "score")).alias("_t"))
    by_sentence = best.groupBy(*keys, "sent_id").agg(F.sort_array(F.collect_list(F.struct("pos", "_t"))).alias("_t"))
    kept = F.expr(
        "aggregate(_t, named_struct('end', 0, 'kept', cast(array() AS array<struct<pos:int,t:struct<size:int,score:double>>>)),"
        " (a_, x_) -> if(x_.pos < a_.end, a_, named_struct('end', x_.pos + x_._t.size,"
        " 'kept', concat(a_.kept, array(named_struct('pos', x_.pos, 't', x_._t))))), a_ -> map_from_entries(a_.kept))"
    )
    return by_sentence.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("sent_id", kept))).alias("found"))


def scored(rows: DataFrame, lexicon: DataFrame, keys: list[str], sentences: str = "sents", text: str = "text") -> DataFrame:
    """The rows with ``sentiment``, the polarity of each text, and ``sentence_sentiments``, those of its sentences.

    ``sentences`` is an array column, ``keys`` follow from the row's id and text, null texts are not
    allowed. A lexicon within ``LEXICON_BYTES`` is sent to the tasks, which look words up where
    the texts are; nothing is shuffled. Beyond it terms are found by joins. Both give the same numbers.
    """
    terms = normal(lexicon)
    if table_bytes(terms) > LEXICON_BYTES:
        return _joined_scores(rows, keys, lexicon, sentences, text)
    return _scored_in_place(rows, terms, sentences, text)


def _joined_scores(rows: DataFrame, keys: list[str], lexicon: DataFrame, sentences: str, text: str) -> DataFrame:
    rows = settle(rows, "sentences")
    found = found_terms(rows, keys, sentences, lexicon)
    items = rows.join(found, keys, "left").withColumn("_o", polarity.score_sentences(sentences, "found"))
    return items.withColumns({
        "sentiment": polarity.document_polarity(text, "_o"), "sentence_sentiments": polarity.sentence_polarities(sentences, "_o"),
    }).drop("found", "_o")


def _scored_in_place(rows: DataFrame, terms: DataFrame, sentences: str, text: str) -> DataFrame:
    held = valence.Lexicon(tuple(r) for r in terms.select("term", "score", "size").collect())
    shared = rows.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("struct<total: double, sums: array<double>>")
    def sums(plain: pa.Array, low: pa.Array, up: pa.Array) -> pa.Array:
        return valence.sums_of(plain, low, up, shared.value)

    words = rows.withColumn("_plain", polarity.plain_words(sentences))
    found = words.withColumn("_v", sums("_plain", F.lower("_plain"), F.upper("_plain")))
    return found.withColumns({
        "sentiment": F.expr(polarity.squashed_sql(text, "_v.total")),
        "sentence_sentiments": F.expr(f"transform({sentences}, (s_, n_) -> {polarity.squashed_sql('s_', 'get(_v.sums, n_)')})"),
    }).drop("_plain", "_v")


def sentiment(df: DataFrame, lexicon: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(doc_id, sentiment, sentences): polarity of every text and of each of its sentences.

    Null and empty texts have polarity 0 and no sentences. Ids may be null or repeated.
    """
    keys = ["_k1", "_k2"]
    hashes = [F.xxhash64("doc_id", text).alias("_k1"), F.xxhash64(F.lit(1), text, "doc_id").alias("_k2")]
    rows = df.select("doc_id", F.coalesce(text, F.lit("")).alias("text"), *hashes)
    rows = rows.withColumn("sents", tokens.sentences(F.col("text")))
    found = scored(rows, built_in(df.sparkSession) if lexicon is None else lexicon, keys)
    return found.select("doc_id", "sentiment", F.col("sentence_sentiments").alias("sentences"))
