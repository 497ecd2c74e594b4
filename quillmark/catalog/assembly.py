"""Queries on sampling, splits, roll-ups, unions and dialogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.catalog import sql as S
from quillmark.catalog.annotated import SENTENCE_SQL, conversation_texts, document_sql, flat, lexicon, parsed_documents, sentence_rows
from quillmark.catalog.registry import query
from quillmark.catalog.texts import documents, turns
from quillmark.functions import patterns as P
from quillmark.functions.constants import METRICS
from quillmark.operators import dialogue, labels, rollup, sampling, sets
from quillmark.operators.scale import seeded_key
from quillmark.plans import corpora, prose
from quillmark.sources.tables import table

SEED = 42


def _h(*ids: str, seed: int = SEED) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(ids)}))"


@query("seeded_shuffle", f"SELECT doc_id, {_h('doc_id')} AS k FROM documents ORDER BY k")
def _(spark, folder):
    return sampling.shuffled(documents(spark, folder), SEED, "doc_id").select(
        "doc_id", seeded_key(SEED, "doc_id").alias("k")
    )


def _sample_sql(quota: int, table_: str = "documents", where: str = "true") -> str:
    return f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (
        PARTITION BY source ORDER BY {_h('doc_id')}, doc_id) AS rn FROM {table_} WHERE {where}) WHERE rn <= {quota}"""


@query("sample_per_source", _sample_sql(20))
def _(spark, folder):
    return sampling.sample_groups(
        documents(spark, folder).select("doc_id", "source"), ["source"], "doc_id", 20, SEED
    )


@query("skip_take", f"SELECT doc_id, text FROM documents WHERE regexp_matches(text, {S.text(P.NOT_WS)}) ORDER BY doc_id LIMIT 50 OFFSET 137")
def _(spark, folder):
    return sampling.skip_take(documents(spark, folder).select("doc_id", "text"), "doc_id", "text", 137, 50)


@query(
    "take_per_language",
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
       WHERE rn <= 25""",
)
def _(spark, folder):
    return sampling.take_per_group(documents(spark, folder).select("doc_id", "lang"), "lang", "doc_id", 25)


@query("limited_prompts", f"SELECT doc_id, text AS prompt FROM documents ORDER BY {_h('doc_id')}, doc_id LIMIT 30")
def _(spark, folder):
    prompts = documents(spark, folder).select("doc_id", F.col("text").alias("prompt"))
    return sampling.shuffled(prompts, SEED, "doc_id").limit(30)


BALANCED = f"""a AS (SELECT conv_id || '-' || turn AS doc_id, text FROM conversations WHERE role = 'assistant'),
    q AS (SELECT CASE WHEN count(*) > 60 THEN count(*) // 3 ELSE count(*) END AS n FROM a),
    h0 AS (SELECT conv_id || '-' || turn AS doc_id, text, 'user' AS source FROM conversations WHERE role = 'user'
           UNION ALL SELECT 'd' || doc_id, text, 'documents' FROM documents UNION ALL SELECT 'b' || item_id, text, 'benchmark' FROM benchmark),
    h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_h('doc_id')}, doc_id) AS rn FROM h0),
    pair AS (SELECT doc_id, text, NULL AS source, 'LLM' AS label FROM a
             UNION ALL SELECT doc_id, text, source, 'HUMAN' FROM h, q WHERE rn <= q.n)"""


def machine_and_human(spark, folder):
    """Assistant turns against three human sources: user turns, documents and benchmark items."""
    both = conversation_texts(spark, folder)
    human = sets.concat_by_name(
        [
            both.where(F.col("role") == "user").select("doc_id", "text", F.lit("user").alias("source")),
            documents(spark, folder).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", F.lit("documents").alias("source")),
            table(spark, folder, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("doc_id"), "text", F.lit("benchmark").alias("source")),
        ]
    )
    return both.where(F.col("role") == "assistant").select("doc_id", "text"), human


@query("balanced_pair", f"WITH {BALANCED} SELECT doc_id, text, source, label FROM pair")
def _(spark, folder):
    machine, human = machine_and_human(spark, folder)
    return sampling.balanced_pair(machine, human, "source", "doc_id", SEED).select("doc_id", "text", "source", "label")


@query("paired_dataset", document_sql(S.clean(), f"(WITH {BALANCED} SELECT * FROM pair)", label="label"))
def _(spark, folder):
    machine, human = machine_and_human(spark, folder)
    return flat(corpora.paired(machine, human, SEED, lexicon=lexicon(spark, folder)))


@query(
    "dataset_report",
    f"WITH {BALANCED} SELECT label, source, count(*) AS n_rows FROM pair GROUP BY ALL",
)
def _(spark, folder):
    machine, human = machine_and_human(spark, folder)
    pair = sampling.balanced_pair(machine, human, "source", "doc_id", SEED)
    return rollup.size_report(pair, ["label", "source"])


@query(
    "augment_dataset",
    f"""WITH e AS ({_sample_sql(10)}), p AS (SELECT doc_id, source FROM documents ANTI JOIN e USING (doc_id)),
        n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_h('doc_id', seed=7)}, doc_id) AS rn FROM p)
        SELECT doc_id, source FROM e UNION ALL SELECT doc_id, source FROM n WHERE rn <= 25 // 3""",
)
def _(spark, folder):
    pool = documents(spark, folder).select("doc_id", "source")
    existing = sampling.sample_groups(pool, ["source"], "doc_id", 10, SEED)
    return sampling.augment(existing, pool, "source", "doc_id", 25, 7)


@query(
    "iteration_number",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS iteration FROM conversations",
)
def _(spark, folder):
    return dialogue.numbered_turns(turns(spark, folder)).select("conv_id", "turn", "iteration")


@query(
    "pair_turns",
    """SELECT conv_id, turn, text AS prompt, nt AS response FROM (
         SELECT *, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations
         WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'""",
)
def _(spark, folder):
    return dialogue.turn_pairs(turns(spark, folder))


@query(
    "conversation_log",
    """SELECT conv_id, turn, upper(left(role, 1)) || lower(substr(role, 2)) AS role, coalesce(text, '') AS content
       FROM conversations WHERE role IS NOT NULL""",
)
def _(spark, folder):
    return dialogue.conversation_log(turns(spark, folder))


@query(
    "chat_title",
    f"""WITH f AS (SELECT conv_id, {S.words('arg_min(text, turn)')} AS ws FROM conversations WHERE role = 'user' GROUP BY conv_id)
        SELECT conv_id, CASE WHEN len(ws) > 3 THEN array_to_string(list_filter(ws, lambda w: w NOT IN {S.STOP}), '_')
          ELSE array_to_string(ws, '_') END AS title FROM f""",
)
def _(spark, folder):
    return dialogue.conversation_titles(turns(spark, folder))


@query(
    "positional_zip",
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position FROM documents),
         b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS position FROM benchmark)
       SELECT position, doc_id, item_id FROM a JOIN b USING (position)""",
)
def _(spark, folder):
    from quillmark.operators.scale import range_bucket

    docs = table(spark, folder, "documents").select("doc_id")
    items = table(spark, folder, "benchmark").select("item_id")
    return sets.positional_zip(
        docs, "doc_id", range_bucket(docs, "doc_id"), items, "item_id", range_bucket(items, "item_id")
    )


_KEY = f"{_h('doc_id')}, doc_id"


@query(
    "train_test_split",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_KEY}) <= ceil(round(0.2 * count(*) OVER (), 6)) THEN 'test' ELSE 'train' END AS split
        FROM documents""",
)
def _(spark, folder):
    return sampling.split(documents(spark, folder).select("doc_id"), "doc_id", 0.2, SEED)


@query(
    "stratified_split",
    f"""SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_KEY})
          <= ceil(round(0.2 * count(*) OVER (PARTITION BY lang), 6)) THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def _(spark, folder):
    return sampling.split(documents(spark, folder).select("doc_id", "lang"), "doc_id", 0.2, SEED, ["lang"])


# Sentence rows rolled up to documents.
MEANS = ["lexical_density", "variance", "burstiness", "saliency", "sentiment", "sentiment_deviation", "depth",
         "head", "sub_clauses", "coord_clauses", "branching", "balanced"]
SUMS = ["lexical_density", "variance", "burstiness", "saliency", "depth", "sentiment_deviation"]
# Means are shifted by far less than a digit before rounding, so that a tie (many means of
# four-place scores end in 5) falls the same way whatever the order of summation.
DIGITS = {"variance": (9, 1e-12)}


def _digits(m: str) -> tuple[int, float]:
    return DIGITS.get(m, (6, 1e-9))


def _avg(m: str, table_: str = "r") -> str:
    value = f"CAST({table_}.{m} AS INTEGER)" if m == "balanced" else f"{table_}.{m}"
    digits, shift = _digits(m)
    return f"round(avg({value}) + {shift}::DOUBLE, {digits}) AS {m}"


_JOINED = ", ".join(f"string_agg({c}, ' ' ORDER BY sent_id) AS {c}" for c in ("sentence", "pos", "lemmas"))


def _round(df, names):
    return df.withColumns({m: F.round(F.col(m) + _digits(m)[1], _digits(m)[0]) for m in names})


def long_sentences(spark, folder):
    """Sentence rows with lengths, those of up to three characters left out."""
    return sentence_rows(spark, folder).where(F.length("sentence") > 3)


@query(
    "document_rollup_mean",
    f"""WITH r AS ({SENTENCE_SQL}) SELECT doc_id, label, {_JOINED}, {', '.join(map(_avg, MEANS))},
        count(*) AS n_sentences FROM r WHERE length(sentence) > 3 GROUP BY doc_id, label""",
)
def _(spark, folder):
    return _round(rollup.rollup_mean(long_sentences(spark, folder), ["doc_id", "label"], MEANS), MEANS)


@query(
    "document_rollup_sum",
    f"""WITH r AS ({SENTENCE_SQL}) SELECT doc_id, label, {_JOINED}, {', '.join(map(_avg, SUMS))},
        arg_min(document_ttr, sent_id) AS document_ttr, CAST(sum(CAST(balanced AS INTEGER)) AS DOUBLE) AS balanced, count(*) AS n_sentences
        FROM r GROUP BY doc_id, label""",
)
def _(spark, folder):
    return _round(rollup.rollup_sum(sentence_rows(spark, folder), ["doc_id", "label"], SUMS), SUMS)


_GLOBAL = [m for m in METRICS if m not in ("mean_sentence_length", "std_sentence_length")]


@query(
    "global_rollup",
    f"""WITH r AS ({SENTENCE_SQL}) SELECT count(*) AS n_sentences, CAST(0 AS DOUBLE) AS mean_sentence_length,
        CAST(0 AS DOUBLE) AS std_sentence_length, {', '.join(map(_avg, _GLOBAL))} FROM r""",
)
def _(spark, folder):
    return _round(rollup.rollup_all(sentence_rows(spark, folder), METRICS), _GLOBAL)


@query(
    "metric_matrix",
    f"""WITH r AS ({document_sql(S.clean(), 'documents', parsed=True)}) SELECT doc_id, {', '.join(m for m in METRICS if m != 'balanced')},
        CAST(floor(balanced) AS INTEGER) AS balanced FROM r""",
)
def _(spark, folder):
    return rollup.metric_matrix(parsed_documents(spark, folder), METRICS)


@query(
    "concat_labelled",
    """SELECT doc_id, text, lang, NULL AS role, 'HUMAN' AS label FROM (SELECT 'd' || doc_id AS doc_id, text, lang FROM documents)
       UNION ALL SELECT conv_id || '-' || turn, text, NULL, role, 'LLM' FROM conversations WHERE role <> 'system'""",
)
def _(spark, folder):
    human = documents(spark, folder).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", "lang", F.lit("HUMAN").alias("label"))
    machine = conversation_texts(spark, folder).withColumn("label", F.lit("LLM"))
    return sets.concat_by_name([human, machine])


@query(
    "concat_positional",
    """SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark
       UNION ALL SELECT conv_id, text FROM conversations""",
)
def _(spark, folder):
    return sets.concat_by_position(
        [
            documents(spark, folder).select("doc_id", "text"),
            table(spark, folder, "benchmark").select("item_id", "text"),
            turns(spark, folder).select("conv_id", "text"),
        ]
    )


# A length rule as a stand-in classifier: long documents are called good.
PREDICTED = """p AS (SELECT quality AS label, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS prediction
    FROM labels JOIN documents USING (doc_id))"""


def predictions(spark, folder):
    return table(spark, folder, "labels").join(documents(spark, folder), "doc_id").select(
        F.col("quality").alias("label"), F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("prediction")
    )


@query("accuracy", f"WITH {PREDICTED} SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy, count(*) AS support FROM p")
def _(spark, folder):
    return labels.accuracy(predictions(spark, folder), "label", "prediction").withColumn("accuracy", F.round("accuracy", 9))


@query("confusion_matrix", f"WITH {PREDICTED} SELECT label, prediction, count(*) AS n FROM p GROUP BY ALL")
def _(spark, folder):
    return labels.confusion(predictions(spark, folder), "label", "prediction")


@query(
    "classification_report",
    f"""WITH {PREDICTED}, c AS (SELECT label AS k FROM p UNION SELECT prediction FROM p),
        s AS (SELECT CAST(k AS VARCHAR) AS class, (SELECT count(*) FROM p WHERE label = k) AS support,
                (SELECT count(*) FROM p WHERE prediction = k) AS predicted, (SELECT count(*) FROM p WHERE label = k AND prediction = k) AS hits FROM c),
        r AS (SELECT class, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
                coalesce(2.0::DOUBLE * hits / nullif(predicted + support, 0), 0) AS f1, support, hits FROM s),
        a AS (SELECT class, precision, recall, f1, support FROM r
          UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
          UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r
          UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM r)
        SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM a""",
)
def _(spark, folder):
    report = labels.classification_report(predictions(spark, folder), "label", "prediction")
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "build_human_corpus",
    document_sql(
        S.clean(),
        f"""(SELECT 'd' || doc_id AS id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY {_h("'d' || doc_id")}, 'd' || doc_id) AS rn
             FROM documents WHERE regexp_matches(text, {S.text(P.NOT_WS)})) WHERE rn <= 40
             UNION ALL SELECT 'b' || item_id, text FROM (SELECT item_id, text, row_number() OVER (ORDER BY {_h("'b' || item_id")}, 'b' || item_id) AS rn
             FROM benchmark WHERE regexp_matches(text, {S.text(P.NOT_WS)})) WHERE rn <= 40
             UNION ALL SELECT conv_id || '-' || turn, text FROM (SELECT conv_id, turn, text,
               row_number() OVER (ORDER BY {_h("conv_id || '-' || turn")}, conv_id || '-' || turn) AS rn
             FROM conversations WHERE role = 'user' AND regexp_matches(text, {S.text(P.NOT_WS)})) WHERE rn <= 40)""",
        "id", "'HUMAN'",
    ),
)
def _(spark, folder):
    both = conversation_texts(spark, folder)
    sources = {
        "documents": documents(spark, folder).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"),
        "benchmark": table(spark, folder, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("doc_id"), "text"),
        "user": both.where(F.col("role") == "user").select("doc_id", "text"),
    }
    return flat(corpora.from_human_sources(sources, 40, SEED, lexicon=lexicon(spark, folder)))
