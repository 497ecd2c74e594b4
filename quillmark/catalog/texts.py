"""Queries on string expressions, filters and language names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.catalog import sql as S
from quillmark.catalog.registry import query
from quillmark.functions import patterns as P
from quillmark.functions import text, tokens
from quillmark.functions.constants import EXTENSIONS, KNOWN_EXTENSIONS
from quillmark.operators import labels
from quillmark.sources.tables import spread, table


def documents(spark, folder):
    return spread(table(spark, folder, "documents"), "doc_id")


def turns(spark, folder):
    return table(spark, folder, "conversations")


def pages(spark, folder):
    return spread(table(spark, folder, "pages"), "page_id")


@query("clean_text", f"SELECT doc_id, {S.clean()} AS clean FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", text.clean_text(F.col("text")).alias("clean"))


SPACED = "regexp_replace(text, '([.,?!])', ' \\1 ', 'g')"


@query("detok_clean_a", f"SELECT doc_id, {S.substitute(SPACED, P.DETOK_SPACED)} AS clean FROM documents")
def _(spark, folder):
    spaced = F.regexp_replace("text", "([.,?!])", " $1 ")
    return documents(spark, folder).select("doc_id", text.detokenise_spaced(spaced).alias("clean"))


DOUBLED = "regexp_replace(text, '([.,?!])', ' \\1 \\1 ', 'g')"


@query("detok_clean_b", f"SELECT doc_id, {S.substitute(DOUBLED, P.DETOK_DOUBLED)} AS clean FROM documents")
def _(spark, folder):
    doubled = F.regexp_replace("text", "([.,?!])", " $1 $1 ")
    return documents(spark, folder).select("doc_id", text.detokenise_doubled(doubled).alias("clean"))


@query(
    "strip_list_literal",
    f"""SELECT doc_id, regexp_replace('[''' || array_to_string({S.all_matches('text', P.WORD)}, ''', ''') || ''']',
        '[\\[\\]'',]', '', 'g') AS plain FROM documents""",
)
def _(spark, folder):
    toks = tokens.regex_tokens(F.col("text"))
    literal = F.concat(F.lit("['"), F.array_join(toks, "', '"), F.lit("']"))
    return documents(spark, folder).select("doc_id", text.strip_list_literal(literal).alias("plain"))


@query(
    "join_tokens",
    f"SELECT doc_id, array_to_string({S.all_matches('text', P.WORD)}, ' ') AS joined FROM documents",
)
def _(spark, folder):
    toks = tokens.regex_tokens(F.col("text"))
    return documents(spark, folder).select("doc_id", F.array_join(toks, " ").alias("joined"))


@query(
    "non_null_contents",
    """SELECT conv_id, turn, CAST(text AS VARCHAR) AS content FROM conversations
       WHERE nullif(role, 'system') IS NOT NULL AND text IS NOT NULL""",
)
def _(spark, folder):
    present = turns(spark, folder).withColumn("role", F.nullif("role", F.lit("system")))
    return present.dropna(subset=["role", "text"]).select(
        "conv_id", "turn", F.col("text").cast("string").alias("content")
    )


@query(
    "non_blank",
    f"""SELECT doc_id, i AS line_no, line FROM (
          SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
        WHERE regexp_matches(line, {S.text(P.NOT_WS)})""",
)
def _(spark, folder):
    lines = documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike(P.NOT_WS)).select(
        "doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line"
    )


@query(
    "min_length_filter",
    f"""SELECT doc_id, s AS sentence FROM (SELECT doc_id, unnest({S.sentences('text')}) AS s FROM documents)
        WHERE length(s) > 3""",
)
def _(spark, folder):
    sents = documents(spark, folder).select(
        "doc_id", F.explode(tokens.sentences(F.col("text"))).alias("sentence")
    )
    return sents.where(F.length("sentence") > 3)


@query(
    "label_encode",
    """WITH t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'LLM' WHEN 'user' THEN 'HUMAN' END AS label
                  FROM conversations)
       SELECT conv_id, turn, label, CASE label WHEN 'LLM' THEN 0 ELSE 1 END AS code,
              CASE WHEN label = 'LLM' THEN 'LLM' ELSE 'HUMAN' END AS decoded FROM t""",
)
def _(spark, folder):
    named = turns(spark, folder).select(
        "conv_id", "turn",
        F.when(F.col("role").isin("assistant", "user"), labels.label_of(F.col("role") == "assistant")).alias("label"),
    )
    coded = named.withColumn("code", labels.encode_label(F.col("label")))
    return coded.withColumn("decoded", labels.decode_label(F.col("code")))


def _pairs(table_: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"({S.text(k)}, {S.text(v)})" for k, v in table_.items()) + ") AS a(name, ext)"


# Spellings of the documents' languages as code names, so that hits, case, blanks and misses occur.
CODE_NAMES = {"en": " Python ", "fr": "C++", "de": "rust", "es": "Fortran"}
_CODE_NAME = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODE_NAMES.items()) + " END"


def code_name(lang):
    out = F
    for k, v in CODE_NAMES.items():
        out = out.when(lang == k, v)
    return out


@query(
    "normalise_language",
    f"""SELECT doc_id, coalesce(a.ext, trim(lower(d.name))) AS ext
        FROM (SELECT doc_id, {_CODE_NAME} AS name FROM documents) d
        LEFT JOIN {_pairs(EXTENSIONS)} ON a.name = trim(lower(d.name))""",
)
def _(spark, folder):
    return documents(spark, folder).select("doc_id", labels.extension_of(code_name(F.col("lang"))).alias("ext"))


@query(
    "known_language_split",
    f"""SELECT doc_id, a.ext, a.ext IS NULL AS rejected
        FROM (SELECT doc_id, {_CODE_NAME} AS name FROM documents) d
        LEFT JOIN {_pairs(KNOWN_EXTENSIONS)} ON a.name = trim(lower(d.name))""",
)
def _(spark, folder):
    ext = labels.known_extension(code_name(F.col("lang")))
    return documents(spark, folder).select("doc_id", ext.alias("ext"), ext.isNull().alias("rejected"))


@query(
    "language_fallback",
    """SELECT page_id, CASE WHEN contains(html, '#include') OR contains(html, ';') THEN 'cpp'
         WHEN contains(html, 'import') OR contains(html, 'def') THEN 'py' END AS lang FROM pages""",
)
def _(spark, folder):
    return pages(spark, folder).select("page_id", labels.language_from_content(F.col("html")).alias("lang"))


STAMP = "2024-05-06 07:08:09"


@query(
    "stamp_rows",
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS iteration,
         text AS response, 'local' AS model, 'py' AS language, 'llm_code' AS label,
         '2024-05-06_070809' AS "timestamp"
       FROM conversations WHERE role = 'assistant'""",
)
def _(spark, folder):
    from quillmark.operators.dialogue import numbered_turns

    rows = numbered_turns(turns(spark, folder).where(F.col("role") == "assistant"))
    stamp = F.date_format(F.lit(STAMP).cast("timestamp_ntz"), "yyyy-MM-dd_HHmmss")
    return rows.select(
        "conv_id", "turn", "iteration", F.col("text").alias("response"), F.lit("local").alias("model"),
        F.lit("py").alias("language"), F.lit("llm_code").alias("label"), stamp.alias("timestamp"),
    )


_NO_EN = "nullif(lang, 'en')"


@query(
    "render_prompts",
    f"""WITH t AS (SELECT doc_id, lang, text AS topic FROM documents)
        SELECT doc_id, 'Lets discuss ' || topic || '. What are your thoughts?' AS discussion,
          'LANGUAGE:' || lang || chr(10) || 'TASK:' || topic || chr(10) || 'ONLY OUTPUT RAW CODE' AS code_prompt,
          'Generate a short prompt with instructions to create code' || coalesce(' in ' || {_NO_EN}, '')
            || ' based on this request: ' || topic AS request FROM t""",
)
def _(spark, folder):
    topic = F.col("topic")
    return documents(spark, folder).select("doc_id", "lang", F.col("text").alias("topic")).select(
        "doc_id",
        text.discussion_prompt(topic).alias("discussion"),
        text.code_prompt(topic, F.col("lang")).alias("code_prompt"),
        text.prompt_request(topic, F.nullif("lang", F.lit("en"))).alias("request"),
    )


@query(
    "head_words",
    f"SELECT doc_id, array_to_string(list_slice({S.words('text')}, 1, 20), ' ') AS head FROM documents",
)
def _(spark, folder):
    return documents(spark, folder).select("doc_id", text.head_words(F.col("text")).alias("head"))


@query("slug", f"SELECT page_id, coalesce({S.rewrite('url', P.SLUG)}, 'untitled') AS slug FROM pages")
def _(spark, folder):
    return pages(spark, folder).select("page_id", text.slug(F.col("url")).alias("slug"))


@query(
    "split_lines",
    """SELECT doc_id, i AS line_no, line FROM (
         SELECT doc_id, len(ls) AS n, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
         FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE n >= 2""",
)
def _(spark, folder):
    lists = documents(spark, folder).select("doc_id", F.split("text", "\n").alias("ls"))
    return lists.where(F.size("ls") >= 2).select("doc_id", F.posexplode("ls").alias("i", "line")).select(
        "doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line"
    )


@query(
    "role_prefix",
    """WITH r AS (SELECT conv_id,
         max(CASE WHEN turn = 0 THEN role || ' of chats' END) AS a,
         max(CASE WHEN turn = 1 AND role = 'assistant' THEN 'you are a ' || role END) AS b
         FROM conversations GROUP BY conv_id)
       SELECT conv_id,
         CASE WHEN starts_with(coalesce(a, b), 'you are a') THEN coalesce(a, b) ELSE 'you are a(n) ' || coalesce(a, b) END AS sys_a,
         CASE WHEN starts_with(coalesce(b, a), 'you are a') THEN coalesce(b, a) ELSE 'you are a(n) ' || coalesce(b, a) END AS sys_b
       FROM r""",
)
def _(spark, folder):
    roles = turns(spark, folder).groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.concat("role", F.lit(" of chats")))).alias("a"),
        F.max(
            F.when((F.col("turn") == 1) & (F.col("role") == "assistant"), F.concat(F.lit("you are a "), "role"))
        ).alias("b"),
    )
    return roles.select(
        "conv_id",
        text.role_instruction(F.coalesce("a", "b")).alias("sys_a"),
        text.role_instruction(F.coalesce("b", "a")).alias("sys_b"),
    )
