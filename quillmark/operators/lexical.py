"""Token and type statistics as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import arrays as A
from quillmark.functions import constants as K
from quillmark.functions import tagging, tokens
from quillmark.operators.scale import lookup_join
from quillmark.sources.shared import settle


def explode_tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, sent_id, tok_id, word): word tokens numbered from 1 within their sentence."""
    return (
        df.select(*keys, F.posexplode(tokens.sentence_tokens(F.col(text))).alias("sent_id", "_t"))
        .select(*keys, "sent_id", F.posexplode("_t").alias("_i", "word"))
        .select(*keys, "sent_id", (F.col("_i") + 1).alias("tok_id"), "word")
    )


def term_frequency(df: DataFrame, keys: list[str], text: str, fold_case: bool = False) -> DataFrame:
    """(keys, term, cnt, n): counts of kept terms and the total of the text."""
    return (
        df.select(*keys, tokens.kept_tokens(text, fold_case).alias("_k"))
        .select(*keys, F.size("_k").cast("long").alias("n"), F.explode(A.term_counts("_k")).alias("_c"))
        .select(*keys, F.col("_c.term").alias("term"), F.col("_c.cnt").alias("cnt"), "n")
    )


def frequency_columns(m: Column, n: Column, s1: Column, s2: Column) -> list[Column]:
    """Mean, population variance and burstiness of type frequencies, from integer sums."""
    spread = (m * s2 - s1 * s1).cast("double")
    cells = (m * n).cast("double")
    seen = (n > 0) & (m > 0)
    return [
        F.when(seen, s1 / cells).otherwise(F.lit(0.0)).alias("saliency"),
        F.when(seen, spread / (cells * cells)).otherwise(F.lit(0.0)).alias("variance"),
        F.when(seen & (s1 > 0), F.sqrt(spread) / s1).otherwise(F.lit(0.0)).alias("burstiness"),
    ]


def type_frequency_profile(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per text: type and kept-term counts, saliency, variance, burstiness."""
    m, s1, s2 = F.col("_prof.m"), F.col("_prof.sums.s1"), F.col("_prof.sums.s2")
    return (
        df.select(
            *keys,
            tokens.word_tokens(F.col(text)).alias("_w"),
            tokens.kept_tokens(text).alias("_k"),
        )
        .select(
            *keys,
            F.size("_w").cast("long").alias("n_tokens"),
            F.size("_k").cast("long").alias("n_kept"),
            tokens.document_profile(F.col("_k"), F.col("_w")).alias("_prof"),
        )
        .select(
            *keys,
            "n_tokens",
            m.alias("n_types"),
            "n_kept",
            *frequency_columns(m, F.col("n_kept"), s1, s2),
            F.when(F.col("n_tokens") > 0, m / F.col("n_tokens")).otherwise(F.lit(0.0)).alias("ttr"),
        )
    )


def type_frequency_shuffled(term_freq: DataFrame, types: DataFrame, keys: list[str]) -> DataFrame:
    """The same profile from long tables: types left-joined to counts, a missing one being 0."""
    joined = types.join(term_freq.select(*keys, "term", "cnt"), [*keys, "term"], "left")
    return joined.withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))


def stop_words(spark) -> DataFrame:
    """The stop-word list as a table (179 rows)."""
    return spark.createDataFrame([(w,) for w in K.STOP_WORDS], "word string")


def without_stop_words(tokens_df: DataFrame, word: str = "word") -> DataFrame:
    stops = stop_words(tokens_df.sparkSession).withColumnRenamed("word", word)
    return tokens_df.join(F.broadcast(stops), word, "left_anti")


def tags(tokens_df: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Tag a token table; a (word, tag) lexicon overrules the built-in rules."""
    ruled = F.expr(tagging.tag_word_sql("word", "tok_id = 1"))
    if lexicon is None:
        return tokens_df.withColumn("tag", ruled)
    known = lexicon.select("word", F.col("tag").alias("_known"))
    return (
        lookup_join(tokens_df, known, ["word"])
        .withColumn("tag", F.coalesce("_known", ruled))
        .drop("_known")
    )


def detached(word: Column, cls: Column) -> Column:
    """array<struct<rule, candidate>>: what is left of a word when a suffix of its class is detached."""
    candidates = F.array(
        *[
            F.when(
                (cls == c) & word.endswith(suffix) & (F.length(word) > len(suffix) + 1),
                F.struct(
                    F.lit(i).alias("rule"),
                    F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(new)).alias("candidate"),
                ),
            )
            for i, (c, suffix, new) in enumerate(K.DETACHMENTS)
        ]
    )
    return F.filter(candidates, lambda c: c.isNotNull())


def irregular(word: Column, cls: Column) -> Column:
    """The lemma of an irregular form, else null."""
    forms = [((word == w) & (cls == c), F.lit(lemma)) for w, c, lemma in K.LEMMA_EXCEPTIONS]
    return F.coalesce(*[F.when(condition, lemma) for condition, lemma in forms])


def changed_lemmas(tokens_df: DataFrame, keys: list[str], vocabulary: DataFrame, near: list[str] | None = None) -> DataFrame:
    """(keys, lemma) of the tokens whose lemma is not the word itself.

    ``tokens_df``: keys, word, class, any multiplicity; ``vocabulary``: (word), the words that may be
    lemmas. Only tokens with an irregular form or a suffix that may be detached are joined, by what
    is left of them. An irregular form comes first, then the first rule with a known result. ``near``
    are those keys by which the result is grouped later: it is dealt by them, once.
    """
    # Most words end in no suffix of any rule, and go at once.
    ends = "|".join(sorted({suffix for _, suffix, _ in K.DETACHMENTS}))
    forms = [w for w, _, _ in K.LEMMA_EXCEPTIONS]
    tokens_df = tokens_df.where(F.col("word").rlike(f"(?:{ends})$") | F.col("word").isin(forms))
    special = irregular(F.col("word"), F.col("class"))
    rules = F.when(special.isNull(), detached(F.col("word"), F.col("class"))).otherwise(
        F.array(F.struct(F.lit(-1).alias("rule"), special.alias("candidate")))
    )
    open_ = tokens_df.select(*keys, "word", F.explode(rules).alias("_c")).select(*keys, "word", "_c.rule", "_c.candidate")
    known = vocabulary.select(F.col("word").alias("candidate"), F.lit(True).alias("_known")).distinct()
    met = open_.join(known, "candidate", "left").where("_known OR rule = -1")
    if near:
        met = met.repartition(*near)
    best = met.groupBy(*keys).agg(F.min(F.struct("rule", "candidate")).alias("_b"), F.first("word").alias("word"))
    return best.where(F.col("_b.candidate") != F.col("word")).select(*keys, F.col("_b.candidate").alias("lemma"))


def word_table(df: DataFrame, text: str) -> DataFrame:
    """(word): the distinct word tokens of the texts, the vocabulary that they give."""
    return df.select(F.explode(F.array_distinct(tokens.word_tokens(F.col(text)))).alias("word")).distinct()


def lemma_titles(df: DataFrame, key: str, text: str, vocabulary: DataFrame, top: int = 5) -> DataFrame:
    """(key, title): the words of each text that are among its most frequent lemmas.

    Words are tagged and lemmatised as in the annotation jobs, with the same vocabulary table (word).
    Keys may be null or repeated; a text without words is ``untitled``.
    """
    keys = ["_k1", "_k2"]
    rows = df.select(
        key, F.coalesce(text, F.lit("")).alias("_t"), F.xxhash64(key, text).alias("_k1"), F.xxhash64(F.lit(1), text, key).alias("_k2")
    )
    found = rows.select(*keys, tokens.title_words(F.col("_t")).alias("_w"))
    tagged = found.withColumn("_s", F.array("_w")).withColumn("_g", tagging.tag_sentences("_s")[0])
    each = tagged.select(*keys, F.posexplode(F.arrays_zip("_w", "_g")).alias("pos", "_x")).select(
        *keys, "pos", F.col("_x._w").alias("word"), tagging.coarse_class(F.col("_x._g")).alias("class")
    )
    changed = changed_lemmas(each, [*keys, "pos"], vocabulary).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "lemma"))).alias("_m")
    )
    lemmas = A.let(tokens.title_words(F.col("_t")), lambda ws: F.transform(ws, lambda w, i: F.coalesce(F.try_element_at("_m", i), w)))
    return rows.join(changed, keys, "left").select(key, tokens.title_by_lemma(F.col("_t"), lemmas, top).alias("title"))


def lemma_dictionary(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, class, lemma) for words whose lemma differs from them.

    ``words``: (word, class), any multiplicity. ``vocabulary``: (word). An irregular form comes
    first; otherwise the first suffix detachment whose result is in the vocabulary.
    """
    spark = words.sparkSession
    distinct = words.select("word", "class").distinct()
    irregular = F.broadcast(spark.createDataFrame(K.LEMMA_EXCEPTIONS, "word string, class string, irregular string"))
    ruled = (
        distinct.select("word", "class", F.explode(detached(F.col("word"), F.col("class"))).alias("_c"))
        .select("word", "class", "_c.rule", "_c.candidate")
        .join(vocabulary.select(F.col("word").alias("candidate")).distinct(), "candidate", "left_semi")
        .groupBy("word", "class")
        .agg(F.min_by("candidate", "rule").alias("ruled"))
    )
    exceptional = distinct.join(irregular, ["word", "class"])
    return (
        ruled.join(exceptional, ["word", "class"], "full")
        .select("word", "class", F.coalesce("irregular", "ruled").alias("lemma"))
        .where(F.col("lemma") != F.col("word"))
    )


def lemmas(tagged: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Add ``class`` and ``lemma`` to a tagged token table; case is kept."""
    classed = tagged.withColumn("class", tagging.coarse_class(F.col("tag")))
    words = settle(classed.select("word", "class").distinct(), "words")
    dictionary = lemma_dictionary(words, words if vocabulary is None else vocabulary)
    return lookup_join(classed, dictionary, ["word", "class"]).withColumn(
        "lemma", F.coalesce("lemma", "word")
    )
