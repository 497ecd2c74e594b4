"""Queries on n-gram features, scaling and the classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.catalog import sql as S
from quillmark.catalog.annotated import SENTENCE_SQL, cleaned_edges, conversation_texts, lexicon, places6, sentence_rows
from quillmark.catalog.lexical import LEMMATISED, TAGGED
from quillmark.catalog.registry import query
from quillmark.catalog.texts import documents
from quillmark.functions import constants as K
from quillmark.functions import patterns as P
from quillmark.functions import tagging, text, tokens
from quillmark.operators import features, labels, models, rollup, sampling
from quillmark.plans import prose
from quillmark.sources.shared import new_path, settle
from quillmark.sources.tables import table

SEED = 42


def _grams_sql(chars: str) -> str:
    parts = []
    for n in (2, 3, 4):
        joined = " || ".join(f"{chars}[i + {k}]" if k else f"{chars}[i]" for k in range(n))
        parts.append(f"CASE WHEN len({chars}) >= {n} THEN list_transform(range(1, len({chars}) - {n} + 2), lambda i: {joined}) ELSE [] END")
    return f"list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]})"


def tfidf_sql(counts: str, top: int) -> str:
    """Unit-length weights per document from a query of (doc_id, term, cnt)."""
    return f"""c AS MATERIALIZED ({counts}),
        v AS (SELECT term, sum(cnt) AS cf, count(*) AS df FROM c GROUP BY term ORDER BY cf DESC, term LIMIT {top}),
        w AS (SELECT doc_id, term, cnt * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term)),
        nn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
        weights AS (SELECT doc_id, term, w / norm AS weight FROM w JOIN nn USING (doc_id))"""


CHARS = f"""SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest({_grams_sql('cs')}) AS term FROM (
    SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), {S.text(P.WS + '{2,}')}, ' ', 'g'), '(?s).') AS cs FROM documents))
    GROUP BY ALL"""
WORDS = f"""SELECT doc_id, term, count(*) AS cnt FROM (
    SELECT doc_id, unnest({S.all_matches('lower(text)', features.WORD2)}) AS term FROM documents) GROUP BY ALL"""


def summary(weights):
    """One row per document that depends on every weight."""
    return weights.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"),
        F.round(F.sum("weight"), 6).alias("weight_sum"),
        F.round(F.max("weight"), 6).alias("weight_max"),
    )


SUMMARY = "SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS weight_max FROM weights GROUP BY doc_id"


@query("char_ngram_tfidf", f"WITH {tfidf_sql(CHARS, 5000)} {SUMMARY}")
def _(spark, folder):
    return summary(features.char_tfidf(documents(spark, folder), F.col("text"), 5000))


@query("word_tfidf", f"WITH {tfidf_sql(WORDS, 5000)} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def _(spark, folder):
    weights = features.tfidf(documents(spark, folder), features.word_terms(F.col("text")), 5000)
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


_POS = f"""{S.token_tables()}, {TAGGED}, ps AS (SELECT doc_id, string_agg(tag, ' ' ORDER BY sent_id, tok_id) AS pos FROM tagged GROUP BY 1),
    pw AS (SELECT doc_id, {S.all_matches('lower(pos)', features.WORD2)} AS ws FROM ps),
    pg AS (SELECT doc_id, unnest(list_concat(list_concat(ws,
        CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE [] END),
        CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [] END)) AS term FROM pw)"""


@query("pos_ngram_counts", f"WITH {_POS} SELECT doc_id, term, count(*) AS cnt FROM pg GROUP BY ALL")
def _(spark, folder):
    toks = documents(spark, folder).select("doc_id", tokens.sentence_tokens(F.col("text")).alias("toks"))
    tags = F.flatten(tagging.tag_sentences("toks"))
    pos = toks.select("doc_id", F.array_join(tags, " ").alias("pos"))
    return features.document_terms(pos, features.word_terms(F.col("pos"), 1, 3))


@query(
    "lemma_counts",
    f"""WITH {S.token_tables()}, {TAGGED}, {LEMMATISED},
        ls AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY sent_id, tok_id) AS lemmas FROM lemmatised GROUP BY 1),
        c AS (SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest({S.all_matches('lower(lemmas)', features.WORD2)}) AS term FROM ls) GROUP BY ALL)
        SELECT term, CAST(sum(cnt) AS BIGINT) AS cf, count(*) AS df FROM c GROUP BY term ORDER BY cf DESC, term LIMIT 3000""",
)
def _(spark, folder):
    docs = prose.lemmatised(documents(spark, folder), F.lit("LLM"), clean=False)
    lemmas = docs.select("doc_id", F.array_join(F.flatten("lemmas"), " ").alias("lemmas"))
    return features.vocabulary(features.document_terms(lemmas, features.word_terms(F.col("lemmas"))), 3000)


@query(
    "standard_scale",
    """WITH f AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks FROM documents)
       SELECT doc_id, round((n_chars - (SELECT avg(n_chars) FROM f)) / (SELECT stddev_pop(n_chars) FROM f), 6) AS n_chars,
         round((blanks - (SELECT avg(blanks) FROM f)) / (SELECT stddev_pop(blanks) FROM f), 6) AS blanks FROM f""",
)
def _(spark, folder):
    frame = documents(spark, folder).select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("blanks"),
    )
    scaled = features.standard_scale(frame, ["n_chars", "blanks"])
    return scaled.withColumns({c: F.round(c, 6) for c in ("n_chars", "blanks")})


@query(
    "feature_join",
    f"""WITH {S.token_tables()}, a AS (SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY 1),
        b AS (SELECT doc_id, count(DISTINCT term) AS n_terms FROM kept GROUP BY 1)
        SELECT doc_id, n_tokens, n_terms, quality FROM a JOIN b USING (doc_id) JOIN labels USING (doc_id)""",
)
def _(spark, folder):
    docs = documents(spark, folder)
    a = docs.select("doc_id", F.size(tokens.word_tokens(F.col("text"))).cast("long").alias("n_tokens"))
    b = docs.select("doc_id", F.size(F.array_distinct(tokens.kept_tokens("text"))).cast("long").alias("n_terms"))
    quality = table(spark, folder, "labels").select("doc_id", "quality")
    return features.feature_join([a, b.where("n_terms > 0"), quality])


_LABEL = "CASE WHEN doc_id % 2 = 0 THEN 'LLM' ELSE 'HUMAN' END"


@query(
    "training_matrix",
    f"""WITH r AS ({SENTENCE_SQL}), f AS (SELECT *, {S.substitute('sentence', P.DETOK_SPACED)} AS clean FROM r),
        k AS (SELECT * FROM f WHERE length({S.rewrite('clean', P.STRIP)}) > 3),
        g AS (SELECT doc_id, {_LABEL} AS label, string_agg(clean, ' ' ORDER BY sent_id) AS text,
                string_agg(pos, ' ' ORDER BY sent_id) AS pos, string_agg(lemmas, ' ' ORDER BY sent_id) AS lemmas,
                avg(lexical_density) AS lexical_density, avg(sentence_length) AS mean_sentence_length,
                floor(avg(CAST(balanced AS INTEGER))) AS balanced FROM k GROUP BY 1, 2)
        SELECT doc_id, CASE label WHEN 'LLM' THEN 0 ELSE 1 END AS y, CAST(len({S.all_matches('lower(text)', features.WORD2)}) AS BIGINT) AS n_words,
          CAST(len({S.all_matches('lower(pos)', features.WORD2)}) AS BIGINT) AS n_pos, CAST(len({S.all_matches('lower(lemmas)', features.WORD2)}) AS BIGINT) AS n_lemmas,
          round(lexical_density + 1e-9, 6) AS lexical_density, round(mean_sentence_length + 1e-9, 6) AS mean_sentence_length, CAST(balanced AS INTEGER) AS balanced FROM g""",
)
def _(spark, folder):
    rows = sentence_rows(spark, folder).withColumns(
        {
            "label": labels.label_of(F.col("doc_id") % 2 == 0),
            "text": text.detokenise_spaced(F.col("sentence")),
            "mean_sentence_length": F.col("sentence_length"),
        }
    )
    kept = rows.where(F.length(text.strip(F.col("text"))) > 3)
    means = ["lexical_density", "mean_sentence_length", "balanced"]
    docs = rollup.rollup_mean(kept, ["doc_id", "label"], means, texts=["text", "pos", "lemmas"])

    def n(col):
        return F.size(features.word_terms(F.col(col))).cast("long")

    return docs.select(
        "doc_id", labels.encode_label(F.col("label")).alias("y"), n("text").alias("n_words"), n("pos").alias("n_pos"),
        n("lemmas").alias("n_lemmas"), *[places6(F.col(m)).alias(m) for m in means[:2]], F.col("balanced").cast("int").alias("balanced"),
    )


def labelled_turns(spark, folder):
    """Annotated user and assistant turns with ``y`` and a stratified split, which is drawn by keys."""
    texts = conversation_texts(spark, folder).withColumn("label", labels.label_of(F.col("role") == "assistant"))
    annotated = prose.annotate_documents(texts, F.col("label"), lexicon=lexicon(spark, folder), parses=cleaned_edges(texts))
    sides = sampling.split(texts.select("doc_id", "label"), "doc_id", 0.2, SEED, ["label"]).select("doc_id", "split")
    return annotated.join(sides, "doc_id").withColumn("y", labels.encode_label(F.col("label")).cast("double"))


def _fitted(spark, folder, blocks, metrics, classifier, scaled=False):
    rows = settle(models.with_terms(labelled_turns(spark, folder), blocks), "training")
    return rows, models.fit(rows.where(F.col("split") == "train"), blocks, metrics, classifier, scaled)


def _forest(spark, folder):
    return _fitted(spark, folder, models.forest_blocks(), K.METRICS, models.random_forest())


def _svm(spark, folder):
    """The margin classifier on scaled metrics; scale and vocabularies are those of the training rows."""
    return _fitted(spark, folder, models.margin_blocks(), K.SCALED_METRICS, models.linear_svm(), True)


def _test_predictions(rows, model):
    test = rows.where(F.col("split") == "test")
    return models.predict(model, test).select(
        "doc_id", "label", labels.decode_label(F.col("prediction")).alias("predicted")
    )


def _verdict(rows, model):
    """Sizes of both sides, and whether the model beats the more frequent label of the test rows."""
    called = _test_predictions(rows, model).agg(
        F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("label") == F.col("predicted")).alias("right"),
        F.greatest(F.count_if(F.col("label") == "LLM"), F.count_if(F.col("label") == "HUMAN")).alias("majority"),
    )
    return called.select("n_test", (F.col("right") > F.col("majority")).alias("beats_majority"))


# The split of the turns: the first fifth of each label in the order of the seeded hash.
_KEY = f"md5('{SEED}:' || doc_id), doc_id"
SPLIT = f"""t AS (SELECT conv_id || '-' || turn AS doc_id, CASE role WHEN 'assistant' THEN 'LLM' ELSE 'HUMAN' END AS label FROM conversations WHERE role <> 'system'),
    sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_KEY}) <= ceil(round(0.2 * count(*) OVER (PARTITION BY label), 6)) AS test FROM t)"""


@query("random_forest_predictions")
def _(spark, folder):
    return _test_predictions(*_forest(spark, folder))


@query("random_forest_check", f"WITH {SPLIT} SELECT count(*) AS n_test, true AS beats_majority FROM sp WHERE test")
def _(spark, folder):
    return _verdict(*_forest(spark, folder))


@query("linear_svm_predictions")
def _(spark, folder):
    return _test_predictions(*_svm(spark, folder))


@query(
    "linear_svm_certificate",
    f"WITH {SPLIT} SELECT count(*) AS n_test, true AS beats_majority, true AS solved, 0.001::DOUBLE AS tolerance FROM sp WHERE test",
)
def _(spark, folder):
    """Whether the duality gap is within the tolerance, beside the verdict on the test rows."""
    rows, model = _svm(spark, folder)
    last = model.stages[-1]
    return _verdict(rows, model).withColumns(
        {"solved": F.lit(last.solved), "tolerance": F.lit(last.getOrDefault("tolerance"))}
    )


@query("model_roundtrip", f"WITH {SPLIT} SELECT doc_id, label, true AS same FROM sp WHERE test")
def _(spark, folder):
    """Whether a model that was saved and read again calls every test row as before."""
    rows, model = _svm(spark, folder)
    again = models.load(models.save(model, new_path(spark, "model")))
    before = _test_predictions(rows, model).withColumnRenamed("predicted", "before")
    after = _test_predictions(rows, again).select("doc_id", F.col("predicted").alias("after"))
    return before.join(after, "doc_id").select("doc_id", "label", F.col("before").eqNullSafe(F.col("after")).alias("same"))


def unseen_calls(spark, folder):
    """(doc_id, predicted): documents, unseen in training, called by the model of the turns.

    The documents are annotated with the words of the training texts as vocabulary.
    """
    rows, model = _svm(spark, folder)
    docs = documents(spark, folder)
    unseen = prose.annotate_documents(
        docs, F.lit("HUMAN"), lexicon=lexicon(spark, folder), parses=cleaned_edges(docs), vocabulary=prose.words_of(rows, clean=False)
    )
    called = models.predict(model, models.with_terms(unseen, models.margin_blocks()))
    return called.select("doc_id", labels.decode_label(F.col("prediction")).alias("predicted"))


@query("classify_unseen", "SELECT doc_id, true AS called FROM documents")
def _(spark, folder):
    """One call, of the two that there are, for every document."""
    return unseen_calls(spark, folder).select("doc_id", F.col("predicted").isin("LLM", "HUMAN").alias("called"))


@query(
    "detect_natural_language",
    "WITH mk AS ("
    + " UNION ALL ".join(
        f"SELECT '{lang}' AS l, unnest({list(ws)}) AS term, unnest({list(ws.values())})::DOUBLE AS w"
        for lang, ws in K.LANGUAGE_MARKERS.items()
    )
    + f"""), t AS (SELECT doc_id, unnest({S.all_matches('lower(text)', P.WORD)}) AS term FROM documents),
        s AS (SELECT doc_id, l, sum(w) AS s FROM t JOIN mk USING (term) GROUP BY ALL),
        b AS (SELECT doc_id, max((s, l)) AS best FROM s GROUP BY 1)
        SELECT doc_id, lang, struct_extract_at(best, 2) AS detected FROM documents LEFT JOIN b USING (doc_id)""",
)
def _(spark, folder):
    return documents(spark, folder).select(
        "doc_id", "lang", tokens.detect_natural_language(F.col("text")).alias("detected")
    )
