"""Queries on sentiment, syntax and the prose annotation jobs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.catalog import sql as S
from quillmark.catalog.lexical import LEMMATISED, NUMBERS, PROFILE, TAGGED
from quillmark.catalog.registry import query
from quillmark.catalog.texts import documents, turns
from quillmark.functions import constants as K
from quillmark.functions import patterns as P
from quillmark.functions import parses, polarity, text, tokens, trees
from quillmark.functions.constants import SUBORDINATE_DEPS
from quillmark.operators import lexical, opinion, syntax
from quillmark.operators.labels import label_of
from quillmark.plans import corpora, prose
from quillmark.sources.shared import settle
from quillmark.sources.tables import spread, table

# The lexicon is a table made from the benchmark items: words of 4, 8, ... characters, and runs of two
# and three words at every fifth and seventh place, scored by their length.
_WORDS = f"list_filter(string_split_regex({S.rewrite('{0}', polarity.EDGE_MARKS)}, {S.text(P.WS + '+')}), lambda x: length(x) > 1)"
LEXICON = f"""bg AS (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT {_WORDS.replace('{0}', 'text')} AS ws FROM benchmark)),
    lexicon AS MATERIALIZED (SELECT DISTINCT term, (length(term) % 7 - 3)::DOUBLE / 2 + 0.25::DOUBLE AS v FROM (
      SELECT lower(ws[i]) AS term FROM bg WHERE length(ws[i]) % 4 = 0
      UNION ALL SELECT lower(ws[i] || ' ' || ws[i + 1]) FROM bg WHERE i % 5 = 0 AND i < len(ws)
      UNION ALL SELECT lower(ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) FROM bg WHERE i % 7 = 0 AND i + 1 < len(ws)))"""


def lexicon(spark, folder):
    """The lexicon as a table in the shared folder."""
    words = F.transform(F.expr(polarity.words_sql("text")), lambda x: x["w"])
    each = table(spark, folder, "benchmark").select(words.alias("ws")).select("ws", F.posexplode("ws").alias("p", "w"))
    i = F.col("p") + 1
    run = lambda n: F.array_join(F.slice("ws", i, n), " ")
    terms = F.array(
        F.when(F.length("w") % 4 == 0, F.col("w")),
        F.when((i % 5 == 0) & (i < F.size("ws")), run(2)),
        F.when((i % 7 == 0) & (i + 1 < F.size("ws")), run(3)),
    )
    found = each.select(F.explode(terms).alias("term")).where("term is not null").distinct()
    return settle(found.select("term", ((F.length("term") % 7 - 3) / 2 + 0.25).alias("score")), "lexicon")


def places6(col):
    """Six places, after a shift far below a place: averages that end in 5 at the seventh place
    are frequent, and must fall the same way whatever the order of summation."""
    return F.round(col + 1e-9, 6)


def _double(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def _boost_sql(w: str) -> str:
    return (
        f"CASE WHEN {w} IN {S.names(K.BOOSTERS_UP)} THEN {_double(K.BOOST)} "
        f"WHEN {w} IN {S.names(K.BOOSTERS_DOWN)} THEN {_double(-K.BOOST)} ELSE {_double(0.0)} END"
    )


# Terms of the lexicon in each sentence: the longest at a place, from left to right; a term is one item.
ITEMS = f"""{LEXICON},
    sw AS MATERIALIZED (SELECT doc_id, sent_id, i, w, lower(w) AS low, (w <> lower(w) AND w = upper(w)) AS shout FROM (
      SELECT doc_id, sent_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT doc_id, sent_id, {_WORDS.replace('{0}', 's')} AS ws FROM sents))),
    sn AS (SELECT *, lead(low, 1) OVER o AS n1, lead(low, 2) OVER o AS n2 FROM sw WINDOW o AS (PARTITION BY doc_id, sent_id ORDER BY i)),
    sm AS (SELECT doc_id, sent_id, i, max(n) AS n, arg_max(v, n) AS v FROM (
        SELECT doc_id, sent_id, i, 1 AS n, v FROM sn JOIN lexicon ON term = low
        UNION ALL SELECT doc_id, sent_id, i, 2, v FROM sn JOIN lexicon ON term = low || ' ' || n1
        UNION ALL SELECT doc_id, sent_id, i, 3, v FROM sn JOIN lexicon ON term = low || ' ' || n1 || ' ' || n2) GROUP BY doc_id, sent_id, i),
    sr AS (SELECT doc_id, sent_id, list_reduce(list_prepend({{'i': 0::BIGINT, 'n': 0::BIGINT, 'v': 0::DOUBLE, 'kept': []::STRUCT(i BIGINT, n BIGINT, v DOUBLE)[]}},
          list({{'i': i::BIGINT, 'n': n::BIGINT, 'v': v, 'kept': []::STRUCT(i BIGINT, n BIGINT, v DOUBLE)[]}} ORDER BY i)),
        lambda a, b: CASE WHEN b.i < a.i + a.n THEN a ELSE {{'i': b.i, 'n': b.n, 'v': b.v, 'kept': list_append(a.kept, {{'i': b.i, 'n': b.n, 'v': b.v}})}} END).kept AS kept
      FROM sm GROUP BY ALL),
    sk AS (SELECT doc_id, sent_id, k.i AS k, k.n AS n, k.v AS v FROM (SELECT doc_id, sent_id, unnest(kept) AS k FROM sr)),
    items AS MATERIALIZED (SELECT s.doc_id, s.sent_id, coalesce(k, i) AS i, string_agg(low, ' ' ORDER BY i) AS low, bool_and(shout) AS shout, any_value(v) AS v
      FROM sw s LEFT JOIN sk ON sk.doc_id = s.doc_id AND sk.sent_id = s.sent_id AND s.i >= k AND s.i < k + n GROUP BY s.doc_id, s.sent_id, coalesce(k, i))"""


def scores_sql(name: str, unit: list[str], source: str, body: str) -> str:
    """CTEs ending in ``name`` (unit..., score): polarity of ``body`` for each row of ``source``, from ``items``."""
    by, on = ", ".join(unit), ", ".join(unit)
    e = f"(v + CASE WHEN mixed AND shout THEN sign * {_double(K.CAPS_BOOST)} ELSE 0.0 END)"
    for k, damping in enumerate(K.DAMPING, start=1):
        counts = f"(l{k} IS NOT NULL AND v{k} IS NULL)"
        e = (
            f"(({e} + CASE WHEN {counts} THEN sign * ({_boost_sql(f'l{k}')}) * {_double(damping)} ELSE 0.0 END)"
            f" * CASE WHEN {counts} AND (l{k} IN {S.names(K.NEGATIONS)} OR contains(l{k}, 'n''t'))"
            f" THEN {_double(K.NEGATION)} ELSE 1.0::DOUBLE END)"
        )
    lags = ", ".join(f"lag(low, {k}) OVER g AS l{k}, lag(v, {k}) OVER g AS v{k}" for k in (1, 2, 3))
    own = f"body_.{body}"
    asks = f"(length({own}) - length(replace({own}, '?', '')))"
    shouts = f"(length({own}) - length(replace({own}, '!', '')))"
    return f"""
    {name}_v AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY sent_id, i) AS i, low, shout, v FROM items),
    {name}_g AS (SELECT *, {lags}, CASE WHEN v < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign,
        (count(*) FILTER (shout) OVER p) BETWEEN 1 AND (count(*) OVER p) - 1 AS mixed,
        min(CASE WHEN low = 'but' THEN i END) OVER p AS b
      FROM {name}_v WINDOW g AS (PARTITION BY {by} ORDER BY i), p AS (PARTITION BY {by})),
    {name}_t AS (SELECT {by}, sum(CASE WHEN low IN {S.names(K.BOOSTERS_UP + K.BOOSTERS_DOWN)} THEN 0.0::DOUBLE
          ELSE {e} END * CASE WHEN b IS NULL OR i = b THEN 1.0::DOUBLE WHEN i < b THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END
          ORDER BY i) AS s
      FROM {name}_g WHERE v IS NOT NULL GROUP BY {by}),
    {name}_a AS (SELECT {on}, coalesce({name}_t.s, 0.0::DOUBLE) AS s, least({shouts}, 4) * {_double(K.EXCLAIM)} +
        CASE WHEN {asks} <= 1 THEN 0.0::DOUBLE WHEN {asks} <= 3 THEN {asks} * 0.18::DOUBLE ELSE 0.96::DOUBLE END AS amp
      FROM {source} AS body_ LEFT JOIN {name}_t USING ({by})),
    {name}_q AS (SELECT {by}, CASE WHEN s > 0 THEN s + amp WHEN s < 0 THEN s - amp ELSE 0.0::DOUBLE END AS s FROM {name}_a),
    {name}_r AS (SELECT {by}, round(s / sqrt(s * s + 15.0::DOUBLE), 4) AS score FROM {name}_q),
    {name} AS (SELECT {by}, CASE WHEN score = 0 THEN 0.0::DOUBLE ELSE score END AS score FROM {name}_r)"""


def _sents(body: str = "text", source: str = "documents", key: str = "doc_id") -> str:
    return f"""sents AS (SELECT {key}, generate_subscripts(ss, 1) - 1 AS sent_id, unnest(ss) AS s
        FROM (SELECT {key}, {S.sentences(body)} AS ss FROM {source}))"""


DOC_SCORES = scores_sql("ds", ["doc_id"], "documents", "text")
SENT_SCORES = scores_sql("ss", ["doc_id", "sent_id"], "sents", "s")


@query("document_sentiment", f"WITH {_sents()}, {ITEMS}, {DOC_SCORES} SELECT doc_id, score AS sentiment FROM ds")
def _(spark, folder):
    return opinion.sentiment(documents(spark, folder), lexicon(spark, folder)).drop("sentences")


def sentence_scores(spark, folder):
    """(doc_id, sent_id, sentiment, document): scores of sentences beside their document's."""
    scored = opinion.sentiment(documents(spark, folder), lexicon(spark, folder))
    # Without "outer" Spark asks first whether there are sentences, and works them out twice for it, once before texts are dealt.
    rows = scored.select("doc_id", F.col("sentiment").alias("document"), F.posexplode_outer("sentences").alias("sent_id", "sentiment"))
    return rows.where(F.col("sent_id").isNotNull()).withColumn("sent_id", F.col("sent_id").cast("long"))


@query("sentence_sentiment", f"WITH {_sents()}, {ITEMS}, {SENT_SCORES} SELECT doc_id, sent_id, score AS sentiment FROM ss")
def _(spark, folder):
    return sentence_scores(spark, folder).drop("document")


@query(
    "sentiment_deviation_sentence",
    f"""WITH {_sents()}, {ITEMS}, {SENT_SCORES}, {DOC_SCORES}
        SELECT doc_id, sent_id, round(abs(ss.score - ds.score), 4) AS sentiment_deviation FROM ss JOIN ds USING (doc_id)""",
)
def _(spark, folder):
    return sentence_scores(spark, folder).select(
        "doc_id", "sent_id", F.round(F.abs(F.col("sentiment") - F.col("document")), 4).alias("sentiment_deviation")
    )


@query(
    "sentiment_deviation_document",
    f"""WITH {_sents()}, {ITEMS}, {SENT_SCORES}, {DOC_SCORES}
        SELECT doc_id, round(stddev_pop(abs(ss.score - ds.score)) + 1e-9, 6) AS sentiment_deviation
        FROM ss JOIN ds USING (doc_id) GROUP BY doc_id""",
)
def _(spark, folder):
    gap = F.abs(F.col("sentiment") - F.col("document"))
    return sentence_scores(spark, folder).groupBy("doc_id").agg(
        places6(F.stddev_pop(gap)).alias("sentiment_deviation")
    )


# A parse is given with the tables: its words are those between white space, a sentence of it ends
# after a word of 7, 14, ... characters, wherever ours end, and the lengths of words give the root
# and the heads, which lead towards it.
_DEP = " ".join(f"WHEN lower(word) IN {S.names(ws)} THEN '{d}'" for d, ws in trees.MARKED_DEPS.items())
_PIECE = P.WS + "*" + P.NOT_WS + "+"
EDGES = f"""ep AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS piece FROM (SELECT doc_id, {S.all_matches('text', _PIECE)} AS ps FROM d0)),
    ew AS (SELECT doc_id, i, {S.rewrite('piece', P.STRIP[:1])} AS word, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS end_ FROM ep),
    eb AS (SELECT *, CAST(coalesce(sum((length(word) % 7 = 0)::BIGINT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS parse_id FROM ew),
    et AS (SELECT *, row_number() OVER p AS tok_id, count(*) OVER (PARTITION BY doc_id, parse_id) AS n, first_value(length(word)) OVER p AS lead_
      FROM eb WINDOW p AS (PARTITION BY doc_id, parse_id ORDER BY i)),
    er AS (SELECT *, lead_ % n + 1 AS root FROM et),
    edges AS MATERIALIZED (SELECT doc_id, parse_id, tok_id, word, end_ - length(word) AS start_, end_, CASE WHEN tok_id = root THEN 0
        WHEN tok_id < root THEN tok_id + 1 + length(word) % (root - tok_id) ELSE tok_id - 1 - length(word) % (tok_id - root) END AS head_id,
      CASE WHEN tok_id = root THEN 'ROOT' {_DEP} ELSE 'dep' END AS dep FROM er)"""
SUBORDINATE = S.names(SUBORDINATE_DEPS)
_D0 = "d0 AS (SELECT doc_id, text FROM documents)"
DEPTHS = """walk(doc_id, parse_id, tok_id, level) AS (
      SELECT doc_id, parse_id, tok_id, 1 FROM edges WHERE head_id = 0
      UNION ALL SELECT e.doc_id, e.parse_id, e.tok_id, level + 1 FROM walk
        JOIN edges e ON e.doc_id = walk.doc_id AND e.parse_id = walk.parse_id AND e.head_id = walk.tok_id),
    depths AS (SELECT doc_id, parse_id, CAST(max(level) AS BIGINT) AS depth FROM walk GROUP BY 1, 2)"""
COUNTS = f"""counts AS (SELECT doc_id, parse_id, count(*) AS n_tok, min(CASE WHEN head_id = 0 THEN tok_id - 1 END) / count(*) AS head,
    count(*) FILTER (dep IN {SUBORDINATE}) AS sub_clauses, count(*) FILTER (dep = 'cc') AS coord_clauses,
    count(*) FILTER (head_id > 0 AND tok_id > head_id) AS rights,
    count(*) FILTER (head_id > 0 AND tok_id < head_id) AS lefts, min(start_) AS s, max(end_) AS e FROM edges GROUP BY 1, 2)"""
# Our sentences by their place in the text, each with the first parsed one that overlaps it.
ALIGNED = f"""sp0 AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (
        SELECT doc_id, string_split({S.rewrite('text', P.SENTENCE_SPANS)}, chr(1)) AS ps FROM d0)),
    sp1 AS (SELECT doc_id, i, {S.rewrite('p', P.STRIP)} AS bare, length({S.rewrite('p', P.STRIP[:1])}) AS rest,
        sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM sp0),
    sp AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sent_id, upto - rest AS s, upto - rest + length(bare) AS e,
        len({S.words('bare')}) AS n_words FROM sp1 WHERE bare <> ''),
    al AS (SELECT sp.doc_id, sp.sent_id, any_value(n_words) AS n_words, arg_min(parse_id, counts.s) AS parse_id
      FROM sp JOIN counts ON sp.doc_id = counts.doc_id AND sp.s < counts.e AND counts.s < sp.e GROUP BY ALL),
    aligned AS (SELECT * FROM al JOIN (SELECT * EXCLUDE (s, e) FROM counts) USING (doc_id, parse_id) JOIN depths USING (doc_id, parse_id))"""


def given_edges(docs, text_col="text"):
    """The parse of (doc_id, text): a row for every word."""
    # Texts are dealt by document before they fall into words, which then stay where they are.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.regexp_replace(text_col, rf"[{P.WS}&&[^ ]]", " ").alias("_t")).repartition(parts, "doc_id")

    @F.arrow_udf(parses.TYPE)
    def parsed(texts: pa.Array) -> pa.Array:
        return parses.edges_of(texts)

    found = docs.groupBy("doc_id").agg(F.collect_list("_t").alias("_t")).select("doc_id", parsed("_t").alias("_e"))
    # With "outer", as Spark would parse twice to ask first whether there are words.
    words = found.select("doc_id", F.explode_outer("_e").alias("_w")).where("_w is not null").select("doc_id", "_w.*")
    dep = F.when(F.col("head_id") == 0, "ROOT")
    for name, marks in trees.MARKED_DEPS.items():
        dep = dep.when(F.lower("word").isin(marks), name)
    return words.select("doc_id", "parse_id", "tok_id", "head_id", dep.otherwise("dep").alias("dep"), "word", "start", "end")


def edges(spark, folder):
    return given_edges(documents(spark, folder))


@query("tree_depth", f"WITH RECURSIVE {_D0}, {EDGES}, {DEPTHS} SELECT doc_id, parse_id, depth FROM depths")
def _(spark, folder):
    return syntax.tree_depth(edges(spark, folder))


def _counts_query(name: str, expr: str, column: str):
    @query(name, f"WITH {_D0}, {EDGES}, {COUNTS} SELECT doc_id, parse_id, {expr} AS {column} FROM counts")
    def _(spark, folder):
        return syntax.parse_counts(edges(spark, folder)).select("doc_id", "parse_id", column)


_counts_query("root_position", "head", "head")
_counts_query("branching_bias", "(rights - lefts) / n_tok", "branching")
_counts_query("balanced_flag", "abs(lefts - rights) <= 2", "balanced")

# Clauses are counted on our own word tokens, sentence by sentence: a mark beside a word does not hide it.
TOKEN_EDGES = f"""edges AS MATERIALIZED (SELECT doc_id, sent_id, tok_id, word, tok_id // 2 AS head_id,
    CASE WHEN tok_id = 1 THEN 'ROOT' {_DEP} ELSE 'dep' END AS dep FROM tok)"""


def token_edges(spark, folder):
    """Word tokens as edges, our sentences as parsed ones: the first token is the root of a binary tree."""
    toks = lexical.explode_tokens(documents(spark, folder), ["doc_id"], "text")
    dep = F.when(F.col("tok_id") == 1, "ROOT")
    for name, marks in trees.MARKED_DEPS.items():
        dep = dep.when(F.lower("word").isin(marks), name)
    return toks.select(
        "doc_id", F.col("sent_id").cast("long").alias("parse_id"), "tok_id",
        F.floor(F.col("tok_id") / 2).cast("int").alias("head_id"), dep.otherwise("dep").alias("dep"), "word",
    )


def _clauses_query(name: str, column: str, deps: str):
    @query(
        name,
        f"""WITH {S.token_tables()}, {TOKEN_EDGES}
            SELECT doc_id, sent_id, count(*) FILTER (dep IN {deps}) AS {column} FROM edges GROUP BY 1, 2""",
    )
    def _(spark, folder):
        return syntax.parse_counts(token_edges(spark, folder)).select("doc_id", F.col("parse_id").alias("sent_id"), column)


_clauses_query("subordinate_clauses", "sub_clauses", SUBORDINATE)
_clauses_query("coordinating_conjunctions", "coord_clauses", "('cc')")


@query(
    "aligned_parses",
    f"WITH RECURSIVE {_D0}, {EDGES}, {DEPTHS}, {COUNTS}, {ALIGNED} SELECT doc_id, sent_id, parse_id, n_words::BIGINT AS n_words, depth FROM aligned",
)
def _(spark, folder):
    rows = syntax.sentence_syntax(syntax.sentence_spans(documents(spark, folder)), edges(spark, folder))
    return rows.select("doc_id", "sent_id", "parse_id", F.col("n_words").cast("long").alias("n_words"), "depth")


@query(
    "syntax_rollup",
    f"""WITH RECURSIVE {_D0}, {EDGES}, {DEPTHS}, {COUNTS}, {ALIGNED}
        SELECT doc_id, max(depth) AS depth, round(avg(head / n_words) + 1e-9, 6) AS head, round(avg(sub_clauses) + 1e-9, 6) AS sub_clauses,
          round(avg(coord_clauses) + 1e-9, 6) AS coord_clauses, round(avg((rights - lefts) / n_tok) + 1e-9, 6) AS branching,
          round(avg(CASE WHEN abs(lefts - rights) <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 1e-9, 6) AS balanced
        FROM aligned GROUP BY doc_id""",
)
def _(spark, folder):
    spans = syntax.sentence_spans(documents(spark, folder))
    rolled = syntax.document_syntax(syntax.sentence_syntax(spans, edges(spark, folder)))
    return rolled.select(
        "doc_id", "depth",
        *[places6(F.col(c)).alias(c) for c in ("head", "sub_clauses", "coord_clauses", "branching", "balanced")],
    )


@query(
    "clause_proxies",
    f"""WITH {S.token_tables()} SELECT doc_id, sent_id,
        count(*) FILTER (lower(word) IN {S.names(sum((trees.MARKED_DEPS[d] for d in SUBORDINATE_DEPS), []))}) AS subordinators,
        count(*) FILTER (lower(word) IN {S.names(trees.MARKED_DEPS['cc'])}) AS coordinators
        FROM tok GROUP BY doc_id, sent_id""",
)
def _(spark, folder):
    rows = documents(spark, folder).select(
        "doc_id", F.posexplode(tokens.sentence_tokens(F.col("text"))).alias("sent_id", "t")
    )

    def hits(names):
        return F.size(F.filter("t", lambda w: F.lower(w).isin(names))).cast("long")

    subordinators = sum((trees.MARKED_DEPS[d] for d in SUBORDINATE_DEPS), [])
    return rows.select(
        "doc_id", F.col("sent_id").cast("long").alias("sent_id"),
        hits(subordinators).alias("subordinators"), hits(trees.MARKED_DEPS["cc"]).alias("coordinators"),
    )


NO_SYNTAX = """syn AS (SELECT NULL::BIGINT AS doc_id, NULL::DOUBLE AS depth, NULL::DOUBLE AS head, NULL::DOUBLE AS sub_clauses,
        NULL::DOUBLE AS coord_clauses, NULL::DOUBLE AS branching, NULL::DOUBLE AS balanced WHERE false)"""


def _syntax_of_documents(halve_head: bool) -> str:
    return f"""{EDGES}, {DEPTHS}, {COUNTS}, {ALIGNED},
      syn AS (SELECT doc_id, max(depth)::DOUBLE AS depth, avg(head {"/ n_words" if halve_head else ""}) AS head, avg(sub_clauses) AS sub_clauses,
                avg(coord_clauses) AS coord_clauses, avg((rights - lefts) / n_tok) AS branching,
                avg(CASE WHEN abs(lefts - rights) <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS balanced
              FROM aligned GROUP BY 1)"""


def document_sql(body: str, source: str, key: str = "doc_id", label: str = "'LLM'", halve_head: bool = True, parsed: bool = False) -> str:
    """The document job: every number from token, sentence and, if ``parsed``, edge tables."""
    src = f"(SELECT {key} AS doc_id, {label} AS label, {body} AS text FROM {source}) src"
    clean_src = "(SELECT doc_id, text FROM src_) x"
    return f"""WITH RECURSIVE src_ AS MATERIALIZED (SELECT * FROM {src}),
      {S.token_tables('text', clean_src)}, {PROFILE}, {TAGGED}, {LEMMATISED},
      {_sents('text', 'd0')}, {ITEMS}, {scores_sql('ss', ['doc_id', 'sent_id'], 'sents', 's')}, {scores_sql('ds', ['doc_id'], 'd0', 'text')},
      types AS (SELECT DISTINCT doc_id, word FROM tok),
      g AS (SELECT t.doc_id, count(*) AS m, CAST(sum(coalesce(c, 0)) AS BIGINT) AS s1,
              CAST(sum(coalesce(c, 0) * coalesce(c, 0)) AS BIGINT) AS s2
            FROM types t LEFT JOIN tf ON tf.doc_id = t.doc_id AND tf.term = t.word GROUP BY t.doc_id),
      x AS (SELECT d.doc_id, coalesce(m, 0) AS m, coalesce(n, 0) AS n, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2
            FROM d LEFT JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)),
      lens AS (SELECT doc_id, sent_id, count(*) AS n FROM tok GROUP BY 1, 2),
      len2 AS (SELECT doc_id, avg(n) AS mean_len, sqrt(CAST(count(*) * sum(n * n) - sum(n) * sum(n) AS DOUBLE)) / count(*) AS std_len
               FROM lens GROUP BY 1),
      tagsum AS (SELECT doc_id, string_agg(tag, ' ' ORDER BY sent_id, tok_id) AS pos,
                   count(*) FILTER (tag IN {S.CONTENT}) / count(*) AS density,
                   count(DISTINCT word) / count(*) AS ttr, count(*) AS n_words FROM tagged GROUP BY 1),
      lemsum AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY sent_id, tok_id) AS lemmas FROM lemmatised GROUP BY 1),
      dev AS (SELECT doc_id, stddev_pop(abs(ss.score - ds.score)) AS dev FROM ss JOIN ds USING (doc_id) GROUP BY 1),
      {_syntax_of_documents(halve_head) if parsed else NO_SYNTAX}
      SELECT x.doc_id, src_.text, coalesce(pos, '') AS pos, coalesce(lemmas, '') AS lemmas,
        round(coalesce(mean_len, 0) + 1e-9, 6) AS mean_sentence_length, round(coalesce(std_len, 0) + 1e-9, 6) AS std_sentence_length,
        coalesce(density, 0) AS lexical_density, {NUMBERS},
        ds.score AS sentiment, round(coalesce(dev, 0) + 1e-9, 6) AS sentiment_deviation, coalesce(ttr, 0) AS ttr,
        depth, round(head + 1e-9, 6) AS head, round(sub_clauses + 1e-9, 6) AS sub_clauses,
        round(coord_clauses + 1e-9, 6) AS coord_clauses, round(branching + 1e-9, 6) AS branching,
        round(balanced + 1e-9, 6) AS balanced, label, n_words IS NULL AS is_empty
      FROM x JOIN src_ USING (doc_id) JOIN ds USING (doc_id) LEFT JOIN len2 USING (doc_id) LEFT JOIN tagsum USING (doc_id)
        LEFT JOIN lemsum USING (doc_id) LEFT JOIN dev USING (doc_id) LEFT JOIN syn ON syn.doc_id::VARCHAR = x.doc_id::VARCHAR"""


ROUNDED = [
    "mean_sentence_length", "std_sentence_length", "sentiment_deviation", "head", "sub_clauses",
    "coord_clauses", "branching", "balanced",
]


def flat(df):
    """Arrays as joined strings and averages rounded, for comparison by value."""
    return df.withColumns(
        {c: F.array_join(c, " ") for c in ("pos", "lemmas")} | {c: places6(F.col(c)) for c in ROUNDED}
    )


def spread_turns(spark, folder):
    # A task a slot: the forest draws rows by partition and place, so its calls depend on how turns are dealt.
    return spread(turns(spark, folder), "conv_id", "turn", share=2, tasks=1)


def conversation_texts(spark, folder):
    return spread_turns(spark, folder).where(F.col("role") != "system").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text", "role"
    )


def cleaned_edges(docs):
    """The parse of the cleaned texts of (doc_id, text)."""
    return given_edges(docs.select("doc_id", text.clean_text(F.col("text")).alias("text")))


@query("annotate_documents", document_sql(S.clean(), "documents", parsed=True))
def parsed_documents(spark, folder):
    docs = documents(spark, folder)
    return flat(prose.annotate_documents(docs, F.lit("LLM"), lexicon=lexicon(spark, folder), parses=cleaned_edges(docs)))


@query("annotate_documents_raw", document_sql("text", "documents", label="'HUMAN'", halve_head=False))
def _(spark, folder):
    return flat(
        prose.annotate_documents(
            documents(spark, folder), F.lit("HUMAN"), clean=False, normalise_head=False, lexicon=lexicon(spark, folder)
        )
    )


@query(
    "annotate_conversations",
    document_sql(S.clean(), "(SELECT conv_id || '-' || turn AS id, text FROM conversations)", "id"),
)
def _(spark, folder):
    return flat(corpora.from_conversations(spread_turns(spark, folder), lexicon=lexicon(spark, folder)))


SENTENCE_SQL = f"""WITH RECURSIVE {S.token_tables('text', '(SELECT doc_id, text FROM documents) x')}, {PROFILE}, {TAGGED}, {LEMMATISED},
      {_sents('text', 'd0')}, {ITEMS}, {scores_sql('ss', ['doc_id', 'sent_id'], 'sents', 's')}, {scores_sql('ds', ['doc_id'], 'd0', 'text')},
      types AS (SELECT DISTINCT doc_id, sent_id, word FROM tok),
      g AS (SELECT t.doc_id, sent_id, count(*) AS m, CAST(sum(coalesce(c, 0)) AS BIGINT) AS s1,
              CAST(sum(coalesce(c, 0) * coalesce(c, 0)) AS BIGINT) AS s2
            FROM types t LEFT JOIN tf ON tf.doc_id = t.doc_id AND tf.term = t.word GROUP BY t.doc_id, sent_id),
      x AS (SELECT g.doc_id, g.sent_id, m, coalesce(n, 0) AS n, s1, s2 FROM g LEFT JOIN n USING (doc_id)),
      tt AS (SELECT doc_id, count(DISTINCT word) / count(*) AS ttr FROM tok GROUP BY 1),
      tg AS (SELECT doc_id, sent_id, string_agg(tag, ' ' ORDER BY tok_id) AS pos, count(*) FILTER (tag IN {S.CONTENT}) / count(*) AS density
             FROM tagged GROUP BY 1, 2),
      lm AS (SELECT doc_id, sent_id, string_agg(lemma, ' ' ORDER BY tok_id) AS lemmas FROM lemmatised GROUP BY 1, 2),
      lens AS (SELECT doc_id, sent_id, count(*) AS n_words FROM tok GROUP BY 1, 2),
      {EDGES}, {DEPTHS}, {COUNTS}, {ALIGNED}
      SELECT x.doc_id, x.sent_id, s AS sentence, pos, lemmas, density AS lexical_density, {NUMBERS},
        ss.score AS sentiment, round(abs(ss.score - ds.score), 4) AS sentiment_deviation, ttr AS document_ttr,
        lens.n_words AS sentence_length, depth, head, sub_clauses, coord_clauses,
        (rights - lefts) / n_tok AS branching, abs(lefts - rights) <= 2 AS balanced, 'LLM' AS label
      FROM x JOIN sents USING (doc_id, sent_id) JOIN ss USING (doc_id, sent_id) JOIN ds USING (doc_id) JOIN tt USING (doc_id)
        JOIN tg USING (doc_id, sent_id) JOIN lm USING (doc_id, sent_id) JOIN lens USING (doc_id, sent_id)
        LEFT JOIN aligned USING (doc_id, sent_id)"""


def sentence_rows(spark, folder):
    docs = documents(spark, folder)
    rows = prose.annotate_sentences(docs, F.lit("LLM"), lexicon=lexicon(spark, folder), parses=given_edges(docs))
    return rows.withColumn("sentence_length", F.col("sentence_length").cast("long"))


@query("annotate_sentences", SENTENCE_SQL)
def _(spark, folder):
    return sentence_rows(spark, folder).withColumns(
        {c: F.array_join(c, " ") for c in ("pos", "lemmas")}
        | {"sentiment_deviation": F.round("sentiment_deviation", 4)}
    )
