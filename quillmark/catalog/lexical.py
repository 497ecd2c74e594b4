"""Queries on tokens, term frequencies, tags and lemmas."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.catalog import sql as S
from quillmark.catalog.registry import query
from quillmark.catalog.texts import documents
from quillmark.functions import arrays as A
from quillmark.functions import constants as K
from quillmark.functions import patterns as P
from quillmark.functions import tagging, text, tokens
from quillmark.operators import features, lexical
from quillmark.operators import sentence_model as M
from quillmark.sources.shared import settle

@query(
    "regex_tokens",
    f"""SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, array_to_string(ws, ' ') AS tokens
        FROM (SELECT doc_id, {S.all_matches('text', P.WORD)} AS ws FROM documents)""",
)
def _(spark, folder):
    toks = documents(spark, folder).select("doc_id", tokens.regex_tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(
    "word_tokens",
    f"""WITH {S.token_tables()} SELECT doc_id, sent_id, count(*) AS n,
        string_agg(word, ' ' ORDER BY tok_id) AS tokens FROM tok GROUP BY doc_id, sent_id""",
)
def _(spark, folder):
    toks = documents(spark, folder).select(
        "doc_id", F.posexplode(tokens.sentence_tokens(F.col("text"))).alias("sent_id", "t")
    )
    return toks.select(
        "doc_id", F.col("sent_id").cast("long").alias("sent_id"),
        F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"),
    )


@query(
    "sentences",
    f"""SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_id, unnest(s) AS sentence
        FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)""",
)
def _(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.posexplode(tokens.sentences(F.col("text"))).alias("sent_id", "sentence")
    ).withColumn("sent_id", F.col("sent_id").cast("long"))

# The split that learns: words by what is left of them without marks, and the counts of their stops.
def _plain(w: str) -> str:
    return f"regexp_replace(regexp_replace(lower({w}), {S.text(M.OPENING)}, ''), {S.text('[.?!,;:]*' + M.CLOSING + '$')}, '')"


def _likelihood(n: str, of: str, p: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE {n} * ln({p}) END + CASE WHEN {of} - {n} = 0 THEN 0 ELSE ({of} - {n}) * ln(1 - {p}) END)"


SENTENCE_MODEL = f"""w0 AS MATERIALIZED (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT doc_id, {S.words('text')} AS ws FROM documents)),
    w1 AS MATERIALIZED (SELECT *, {_plain('word')} AS type, regexp_matches(word, {S.text('\\.' + M.CLOSING + '$')}) AS stop, regexp_matches(word, {S.text(M.END)}) AS ends,
      lag(word) OVER o AS before, lead(word) OVER o AS next FROM w0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    ty AS (SELECT type, count(*) AS n, count(*) FILTER (stop) AS k, count(*) FILTER (regexp_matches(coalesce(before, ''), {S.text(M.END)})) AS s
      FROM w1 WHERE regexp_matches(type, '\\p{{L}}') GROUP BY type),
    al AS (SELECT *, sum(n) OVER () AS n_all, sum(k) OVER () / sum(n) OVER () AS chance, sum(s) OVER () AS s_all, length(replace(type, '.', '')) AS bare FROM ty),
    sc AS (SELECT type, k, 2 * ({_likelihood('k', 'n', str(M.STOPPED))} - {_likelihood('k', 'n', 'chance')}) * exp(-bare) * (length(type) - bare + 1)
        * pow(bare, -(n - k)) AS abbr,
      CASE WHEN s_all > 0 AND n_all > s_all AND s / s_all > (n - s) / (n_all - s_all) THEN 2 * ({_likelihood('s', 's_all', '(s / s_all)')}
        + {_likelihood('(n - s)', '(n_all - s_all)', '((n - s) / (n_all - s_all))')} - {_likelihood('s', 's_all', '(n / n_all)')}
        - {_likelihood('(n - s)', '(n_all - s_all)', '(n / n_all)')}) ELSE 0 END AS start FROM al),
    model AS MATERIALIZED (SELECT type, 'abbreviation' AS kind, abbr AS score FROM sc WHERE k > 0 AND abbr >= {M.ABBREVIATION}
      UNION ALL SELECT type, 'starter', start FROM sc WHERE start >= {M.STARTER})"""


@query("sentence_model", f"WITH {SENTENCE_MODEL} SELECT type, kind, round(score, 4) AS score FROM model")
def _(spark, folder):
    return M.train(documents(spark, folder)).select("type", "kind", F.round("score", 4).alias("score"))


@query(
    "learned_sentences",
    f"""WITH {SENTENCE_MODEL}, br AS (SELECT *, next IS NULL OR (ends AND NOT (stop AND type IN (SELECT type FROM model WHERE kind = 'abbreviation')
          AND NOT ({_plain('next')} IN (SELECT type FROM model WHERE kind = 'starter')
            AND left(regexp_replace(next, {S.text(M.OPENING)}, ''), 1) <> lower(left(regexp_replace(next, {S.text(M.OPENING)}, ''), 1))))) AS b FROM w1),
        sg AS (SELECT *, coalesce(sum(b::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_id FROM br)
        SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, string_agg(word, ' ' ORDER BY i) AS sentence FROM sg GROUP BY ALL""",
)
def _(spark, folder):
    docs = documents(spark, folder)
    cut = M.split(docs, settle(M.train(docs), "sentence-model"))
    return cut.select("doc_id", F.posexplode("sentences").alias("sent_id", "sentence")).withColumn("sent_id", F.col("sent_id").cast("long"))



@query("word_count", f"SELECT doc_id, CAST(len({S.words('text')}) AS BIGINT) AS n_words FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n_words"))


@query(
    "kept_tokens",
    f"""WITH {S.token_tables()} SELECT d0.doc_id, count(term) AS n,
          coalesce(string_agg(term, ' ' ORDER BY pos), '') AS kept
        FROM d0 LEFT JOIN kept USING (doc_id) GROUP BY d0.doc_id""",
)
def _(spark, folder):
    kept = documents(spark, folder).select("doc_id", tokens.kept_tokens("text").alias("k"))
    return kept.select("doc_id", F.size("k").cast("long").alias("n"), F.array_join("k", " ").alias("kept"))


@query(
    "term_frequency",
    f"""WITH {S.token_tables()} SELECT doc_id, term, count(*) AS cnt,
          CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS BIGINT) AS n FROM kept GROUP BY doc_id, term""",
)
def _(spark, folder):
    return lexical.term_frequency(documents(spark, folder), ["doc_id"], "text")


PROFILE = """
    n AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY 1),
    tf AS (SELECT doc_id, term, count(*) AS c FROM kept GROUP BY 1, 2)"""
NUMBERS = """
    CASE WHEN n > 0 THEN s1 / CAST(m * n AS DOUBLE) ELSE 0 END AS saliency,
    CASE WHEN n > 0 THEN CAST(m * s2 - s1 * s1 AS DOUBLE) / (CAST(m * n AS DOUBLE) * CAST(m * n AS DOUBLE))
      ELSE 0 END AS variance,
    CASE WHEN n > 0 AND s1 > 0 THEN sqrt(CAST(m * s2 - s1 * s1 AS DOUBLE)) / s1 ELSE 0 END AS burstiness"""


def profile_sql(body: str = "text", source: str = "documents") -> str:
    return f"""WITH {S.token_tables(body, source)}, {PROFILE},
        types AS (SELECT DISTINCT doc_id, word FROM tok),
        g AS (SELECT t.doc_id, count(*) AS m, CAST(sum(coalesce(c, 0)) AS BIGINT) AS s1,
                CAST(sum(coalesce(c, 0) * coalesce(c, 0)) AS BIGINT) AS s2
              FROM types t LEFT JOIN tf ON tf.doc_id = t.doc_id AND tf.term = t.word GROUP BY t.doc_id),
        w AS (SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY 1),
        x AS (SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(m, 0) AS m, coalesce(n, 0) AS n,
                coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2
              FROM d LEFT JOIN w USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN n USING (doc_id))
        SELECT doc_id, n_tokens, m AS n_types, n AS n_kept, {NUMBERS},
          CASE WHEN n_tokens > 0 THEN m / n_tokens ELSE 0 END AS ttr FROM x"""


@query("type_frequency_profile", profile_sql(S.clean()))
def type_profile(spark, folder):
    cleaned = documents(spark, folder).select("doc_id", text.clean_text(F.col("text")).alias("text"))
    return lexical.type_frequency_profile(cleaned, ["doc_id"], "text")


@query(
    "sentence_frequency_profile",
    f"""WITH {S.token_tables()}, {PROFILE},
        types AS (SELECT DISTINCT doc_id, sent_id, word FROM tok),
        g AS (SELECT t.doc_id, sent_id, count(*) AS m, CAST(sum(coalesce(c, 0)) AS BIGINT) AS s1,
                CAST(sum(coalesce(c, 0) * coalesce(c, 0)) AS BIGINT) AS s2
              FROM types t LEFT JOIN tf ON tf.doc_id = t.doc_id AND tf.term = t.word GROUP BY t.doc_id, sent_id),
        x AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (doc_id))
        SELECT doc_id, sent_id, m AS n_types, n AS n_kept, {NUMBERS} FROM x""",
)
def _(spark, folder):
    docs = documents(spark, folder).select(
        "doc_id",
        tokens.sentence_tokens(F.col("text")).alias("toks"),
        tokens.kept_tokens("text").alias("k"),
    )
    rows = docs.select(
        "doc_id", F.size("k").cast("long").alias("n"),
        F.posexplode(tokens.type_profile(F.col("k"), tokens.types_of_sentences(F.col("toks")))).alias("sent_id", "p"),
    )
    return rows.select(
        "doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("p.m").alias("n_types"),
        F.col("n").alias("n_kept"),
        *lexical.frequency_columns(F.col("p.m"), F.col("n"), F.col("p.s1"), F.col("p.s2")),
    )


@query(
    "type_token_ratio",
    f"""WITH {S.token_tables()} SELECT d.doc_id, count(word) AS n_tokens, count(DISTINCT word) AS n_types,
        coalesce(count(DISTINCT word) / nullif(count(word), 0), 0) AS ttr FROM d LEFT JOIN tok USING (doc_id) GROUP BY d.doc_id""",
)
def _(spark, folder):
    toks = documents(spark, folder).select("doc_id", tokens.word_tokens(F.col("text")).alias("w"))
    n, m = F.size("w").cast("long"), A.distinct_count(F.col("w"))
    return toks.select("doc_id", n.alias("n_tokens"), m.alias("n_types")).withColumn(
        "ttr", A.mean_of(F.col("n_tokens"), F.col("n_types"))
    )


@query(
    "sentence_length_stats",
    f"""WITH {S.token_tables()}, l AS (SELECT doc_id, sent_id, count(*) AS n FROM tok GROUP BY 1, 2)
        SELECT d.doc_id, count(n) AS n_sentences, round(coalesce(avg(n), 0) + 1e-9, 6) AS mean_sentence_length,
          round(coalesce(sqrt(CAST(count(n) * sum(n * n) - sum(n) * sum(n) AS DOUBLE)) / nullif(count(n), 0), 0) + 1e-9, 6) AS std_sentence_length
        FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id""",
)
def _(spark, folder):
    lengths = documents(spark, folder).select(
        "doc_id", F.transform(tokens.sentence_tokens(F.col("text")), lambda t: F.size(t)).alias("l")
    )
    m = lengths.select("doc_id", A.moments(F.col("l")).alias("m"))
    return m.select(
        "doc_id", F.col("m.n").alias("n_sentences"),
        F.round(A.mean_of(F.col("m.n"), F.col("m.s1")) + 1e-9, 6).alias("mean_sentence_length"),
        F.round(A.std_of(F.col("m.n"), F.col("m.s1"), F.col("m.s2")) + 1e-9, 6).alias("std_sentence_length"),
    )


TAGGED = f"tagged AS MATERIALIZED (SELECT *, {S.tag()} AS tag FROM tok)"


@query(
    "pos_tags",
    f"""WITH {S.token_tables()}, {TAGGED} SELECT d.doc_id, coalesce(string_agg(tag, ' ' ORDER BY sent_id, tok_id), '') AS pos
        FROM d LEFT JOIN tagged USING (doc_id) GROUP BY d.doc_id""",
)
def _(spark, folder):
    toks = documents(spark, folder).select("doc_id", tokens.sentence_tokens(F.col("text")).alias("toks"))
    tags = tagging.tag_sentences("toks")
    return toks.select("doc_id", F.array_join(F.flatten(tags), " ").alias("pos"))


@query(
    "coarse_pos",
    f"""WITH {S.token_tables()}, {TAGGED} SELECT doc_id, {S.coarse()} AS class, count(*) AS n
        FROM tagged GROUP BY ALL""",
)
def _(spark, folder):
    toks = lexical.tags(lexical.explode_tokens(documents(spark, folder), ["doc_id"], "text"))
    return toks.groupBy("doc_id", tagging.coarse_class(F.col("tag")).alias("class")).agg(F.count("*").alias("n"))


@query(
    "lexical_density",
    f"""WITH {S.token_tables()}, {TAGGED} SELECT d.doc_id,
        coalesce(count(*) FILTER (tag IN {S.CONTENT}) / nullif(count(tag), 0), 0) AS lexical_density
        FROM d LEFT JOIN tagged USING (doc_id) GROUP BY d.doc_id""",
)
def _(spark, folder):
    toks = documents(spark, folder).select("doc_id", tokens.sentence_tokens(F.col("text")).alias("toks"))
    tags = F.flatten(tagging.tag_sentences("toks"))
    return toks.select("doc_id", tags.alias("t")).select(
        "doc_id", tagging.lexical_density(F.col("t")).alias("lexical_density")
    )


def _values(rows, names) -> str:
    body = ", ".join("(" + ", ".join(S.text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {names}"


def lemmatised_sql(tagged: str = "tagged", vocabulary: str = "words", out: str = "lemmatised") -> str:
    """CTEs ending in ``out``: the rows of ``tagged`` with class and lemma; ``vocabulary``: table of the words."""
    return f"""
    words AS (SELECT DISTINCT word, {S.coarse()} AS class FROM {tagged}),
    ruled AS (
      SELECT word, class, arg_min(candidate, rule) AS ruled FROM (
        SELECT w.word, w.class, r.rule,
               left(w.word, length(w.word) - length(r.suffix)) || r.new AS candidate
        FROM words w JOIN {_values([(i, *d) for i, d in enumerate(K.DETACHMENTS)], 'r(rule, class, suffix, new)')}
          ON r.class = w.class AND ends_with(w.word, r.suffix) AND length(w.word) > length(r.suffix) + 1)
      WHERE candidate IN (SELECT word FROM {vocabulary}) GROUP BY word, class),
    {out} AS (
      SELECT t.*, coalesce(e.lemma, ruled, t.word) AS lemma FROM (SELECT *, {S.coarse()} AS class FROM {tagged}) t
      LEFT JOIN ruled USING (word, class)
      LEFT JOIN {_values(K.LEMMA_EXCEPTIONS, 'e(word, class, lemma)')} ON e.word = t.word AND e.class = t.class)"""


LEMMATISED = lemmatised_sql()


@query(
    "lemmas",
    f"""WITH {S.token_tables()}, {TAGGED}, {LEMMATISED}
        SELECT word, class, lemma, count(*) AS n FROM lemmatised GROUP BY ALL""",
)
def _(spark, folder):
    toks = lexical.tags(lexical.explode_tokens(documents(spark, folder), ["doc_id"], "text"))
    counts = settle(toks.groupBy("word", "tag").agg(F.count("*").alias("n")), "word-counts")
    return lexical.lemmas(counts).groupBy("word", "class", "lemma").agg(F.sum("n").alias("n"))


@query(
    "stopword_anti_join",
    f"""WITH {S.token_tables()} SELECT doc_id, sent_id, tok_id, word FROM tok WHERE word NOT IN {S.STOP}""",
)
def _(spark, folder):
    toks = lexical.explode_tokens(documents(spark, folder), ["doc_id"], "text")
    return lexical.without_stop_words(toks).select(
        "doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("tok_id").cast("long").alias("tok_id"), "word"
    )


@query(
    "type_count_lookup",
    f"""WITH {S.token_tables()}, tf AS (SELECT doc_id, term, count(*) AS c FROM kept GROUP BY 1, 2)
        SELECT t.doc_id, t.word AS term, coalesce(c, 0) AS cnt FROM (SELECT DISTINCT doc_id, word FROM tok) t
        LEFT JOIN tf ON tf.doc_id = t.doc_id AND tf.term = t.word""",
)
def _(spark, folder):
    docs = documents(spark, folder)
    types = docs.select("doc_id", F.explode(F.array_distinct(tokens.word_tokens(F.col("text")))).alias("term"))
    return lexical.type_frequency_shuffled(
        lexical.term_frequency(docs, ["doc_id"], "text"), types, ["doc_id"]
    ).select("doc_id", "term", "cnt")


@query(
    "distinct_types",
    f"WITH {S.token_tables()} SELECT DISTINCT doc_id, word FROM tok",
)
def _(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.explode(F.array_distinct(tokens.word_tokens(F.col("text")))).alias("word")
    )


@query(
    "vocabulary",
    f"""WITH {S.token_tables()} SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM kept GROUP BY term""",
)
def _(spark, folder):
    return features.vocabulary(
        features.document_terms(documents(spark, folder), tokens.kept_tokens("text"))
    )


TOP = f"""{S.token_tables()},
    ranked AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS r
               FROM kept GROUP BY doc_id, term)"""


@query("top_terms", f"WITH {TOP} SELECT doc_id, coalesce(string_agg(term, ' ' ORDER BY r), '') AS terms FROM documents LEFT JOIN (SELECT * FROM ranked WHERE r <= 5) b USING (doc_id) GROUP BY doc_id")
def _(spark, folder):
    kept = A.placed_term_counts(tokens.kept_tokens("text"))
    return documents(spark, folder).select(
        "doc_id", F.array_join(tokens.top_terms(kept, 5), " ").alias("terms")
    )


@query(
    "title_semi_join",
    f"""WITH {TOP} SELECT kept.doc_id, string_agg(kept.term, '_' ORDER BY kept.pos) AS title
        FROM kept SEMI JOIN (SELECT doc_id, term FROM ranked WHERE r <= 5) b USING (doc_id, term) GROUP BY kept.doc_id
        UNION ALL SELECT doc_id, '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept)""",
)
def _(spark, folder):
    kept = documents(spark, folder).select("doc_id", tokens.kept_tokens("text").alias("k"))
    title = A.let(
        F.col("best"),
        lambda best: F.array_join(F.filter("k", lambda w: F.array_contains(best, w)), "_"),
    )
    best = tokens.top_terms(A.placed_term_counts(F.col("k")), 5)
    return kept.withColumn("best", best).select("doc_id", title.alias("title"))


# Titles look at the first 20 words; the vocabulary of their lemmas is that of all documents.
_HEAD = f"array_to_string(list_slice({S.words('text')}, 1, 20), ' ')"


@query(
    "title_slug",
    f"""WITH {S.token_tables()}, h AS (SELECT doc_id, {_HEAD} AS head FROM documents),
        ws AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS w
               FROM (SELECT doc_id, {S.all_matches('lower(head)', P.WORD)} AS l FROM h WHERE len({S.words('head')}) >= 6)),
        kw AS (SELECT doc_id, pos, w AS word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS tok_id FROM ws WHERE w NOT IN {S.STOP}),
        kt AS (SELECT *, {S.tag()} AS tag FROM kw), {lemmatised_sql('kt', 'tok', 'kl')},
        best AS (SELECT doc_id, lemma FROM (
            SELECT doc_id, lemma, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS r
            FROM kl GROUP BY doc_id, lemma) WHERE r <= 5),
        long AS (SELECT ws.doc_id, string_agg(w, '_' ORDER BY pos) AS title FROM ws JOIN best
                 ON best.doc_id = ws.doc_id AND best.lemma = ws.w GROUP BY ws.doc_id),
        short AS (SELECT doc_id, replace(regexp_replace(lower(array_to_string(
                    list_filter({S.words('head')}, lambda x: lower(x) NOT IN {S.STOP}), ' ')),
                    '[^\\p{{L}}\\p{{N}}_\\s\\-]', '', 'g'), ' ', '_') AS title FROM h WHERE len({S.words('head')}) < 6)
        SELECT h.doc_id, coalesce(nullif(coalesce(long.title, short.title), ''), 'untitled') AS title
        FROM h LEFT JOIN long USING (doc_id) LEFT JOIN short USING (doc_id)""",
)
def _(spark, folder):
    docs = documents(spark, folder)
    head = docs.select("doc_id", text.head_words(F.col("text")).alias("head"))
    return lexical.lemma_titles(head, "doc_id", "head", lexical.word_table(docs, "text"))


@query(
    "short_title",
    f"""WITH ws AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS w FROM (
          SELECT doc_id, list_filter({S.words("regexp_replace(lower(text), " + S.text(r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]") + ", '', 'g')")},
            lambda x: x NOT IN {S.STOP} AND length(x) > 2) AS l FROM documents)),
        r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS r
              FROM ws GROUP BY doc_id, w),
        t AS (SELECT doc_id, left(string_agg(w, '_' ORDER BY r), 5) AS title FROM r WHERE r <= 5 GROUP BY doc_id)
        SELECT doc_id, coalesce(title, 'untitled') AS title FROM documents LEFT JOIN t USING (doc_id)""",
)
def _(spark, folder):
    return documents(spark, folder).select("doc_id", tokens.title_by_frequency(F.col("text")).alias("title"))
