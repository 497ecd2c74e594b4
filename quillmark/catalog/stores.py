"""Queries that write to the shared folder and read back: sources, sinks, stream, annotators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from quillmark.catalog import sql as S
from quillmark.catalog.annotated import document_sql, flat, lexicon
from quillmark.catalog.registry import query
from quillmark.catalog.sources_of_code import SNIPPETS, snippets
from quillmark.catalog.texts import documents, pages, turns
from quillmark.functions import patterns as P
from quillmark.functions import tagging, text, tokens
from quillmark.operators import dialogue, sets
from quillmark.plans import corpora, prose, source_code
from quillmark.plans.custom import annotate_with
from quillmark.sources import readers, writers
from quillmark.sources.shared import new_path
from quillmark.sources.tables import table
from quillmark.streaming.annotate import annotate_stream, read_master


@query(
    "read_prose_csv",
    f"""WITH {S.token_tables()}, tg AS (SELECT doc_id, string_agg({S.tag()}, ' ' ORDER BY sent_id, tok_id) AS pos,
          string_agg(word, ' ' ORDER BY sent_id, tok_id) AS lemmas FROM tok GROUP BY 1)
        SELECT text, pos, lemmas, 'LLM' AS label FROM d JOIN tg USING (doc_id)""",
)
def _(spark, folder):
    toks = documents(spark, folder).select("text", tokens.sentence_tokens(F.col("text")).alias("toks"))
    rows = toks.select(
        "text", F.flatten(tagging.tag_sentences("toks")).alias("pos"), F.flatten("toks").alias("lemmas"),
        F.lit("LLM").alias("label"),
    )
    path = writers.write_csv(rows, new_path(spark, "prose-csv"))
    back = readers.read_prose_csv(spark, path, "text string, pos string, lemmas string, label string")
    return back.withColumns({c: F.array_join(c, " ") for c in ("pos", "lemmas")})


@query("conversation_contents", "SELECT text AS content FROM conversations WHERE text IS NOT NULL")
def _(spark, folder):
    log = dialogue.conversation_log(turns(spark, folder)).select("role", "content")
    path = writers.write_csv(log, new_path(spark, "chat-csv"))
    return readers.read_conversation(spark, path).select("content")


@query("generation_log_pruned", "SELECT text AS response, 'py' AS language FROM conversations WHERE role = 'assistant'")
def _(spark, folder):
    pairs = turns(spark, folder).where(F.col("role") == "assistant").select(
        F.col("turn").cast("int").alias("iteration"), F.lit("p").alias("prompt"), F.col("text").alias("response"),
        F.lit("m").alias("model"), F.lit("py").alias("language"), F.lit("llm_code").alias("label"), F.lit("t").alias("timestamp"),
    )
    path = writers.write_csv(pairs, new_path(spark, "log-csv"))
    return readers.read_generation_log(spark, path, ["response", "language"])


def _language_of_path(path):
    return F.regexp_extract(path, "/lang=([a-z]+)/", 1)


@query(
    "ingest_text_files",
    "SELECT lang, 'LLM' AS label, md5(text || chr(10)) AS content, length(text) + 1 AS n_chars FROM documents",
)
def _(spark, folder):
    """A text file for every document, read whole; a line end follows each text."""
    path = new_path(spark, "texts")
    writers.write_texts(documents(spark, folder).select("lang", "text"), path, "lang", "text", single=True)
    files = readers.read_text_files(spark, path, True)
    return files.select(
        _language_of_path(F.col("path")).alias("lang"), "label", F.md5("text").alias("content"), F.length("text").cast("long").alias("n_chars")
    )


@query(
    "ingest_code_files",
    f"""WITH {SNIPPETS} SELECT CASE WHEN lang = 'cpp' THEN 'cpp' ELSE 'txt' END AS suffix, lang = 'cpp' AS accepted,
        md5(regexp_replace(src, '\\n+\\z', '') || chr(10)) AS content FROM snip WHERE lang IN ('cpp', 'html')""",
)
def _(spark, folder):
    """A file for every source: C++ in .cpp files is accepted; pages in .txt files are rejected."""
    path = new_path(spark, "sources")
    code = snippets(spark, folder).withColumn("src", F.regexp_replace("src", r"\n+\z", ""))
    writers.write_sources(code.where(F.col("lang") == "cpp"), f"{path}/a", ["conv_id", "turn"], "src", "cpp")
    writers.write_texts(code.where(F.col("lang") == "html").select("lang", "src"), f"{path}/b", "lang", "src", single=True)
    accepted, rejected = readers.read_code_files(spark, path, True)
    both = accepted.select("lang", "src", F.lit(True).alias("accepted")).unionByName(
        rejected.select("lang", "src", F.lit(False).alias("accepted"))
    )
    return both.select(F.col("lang").alias("suffix"), "accepted", F.md5("src").alias("content"))


_SECTION = "regexp_extract(url, '/([a-z][a-z])/', 1)"


@query(
    "save_texts",
    f"""SELECT coalesce({S.rewrite(_SECTION, P.SLUG)}, 'untitled') AS slug,
        CAST(sum(len(string_split(html, chr(10)))) AS BIGINT) AS n_lines FROM pages GROUP BY 1""",
)
def _(spark, folder):
    path = new_path(spark, "pages")
    section = text.slug(F.regexp_extract("url", "/([a-z][a-z])/", 1))
    named = pages(spark, folder).select(section.alias("slug"), F.col("html").alias("text"))
    writers.write_texts(named, path, "slug", "text")
    back = spark.read.text(path, lineSep="\n").groupBy("slug").agg(F.count("*").alias("n_lines"))
    # An empty name is kept in the folder of the default partition.
    return back.withColumn("slug", F.coalesce("slug", F.lit("")))


@query(
    "prompt_lines",
    f"""SELECT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE regexp_matches(line, {S.text(P.NOT_WS)})""",
)
def _(spark, folder):
    path = new_path(spark, "lines")
    documents(spark, folder).select("text").write.text(path)
    return readers.read_lines(spark, path).select("line")


@query(
    "documents_from_tokens",
    f"""WITH w AS (SELECT doc_id, lang, {S.words('text')} AS ws FROM documents)
        SELECT doc_id, array_to_string(ws, ' ') AS text, CAST(len(ws) AS BIGINT) AS n_items
        FROM w WHERE lang IN ('en', 'fr') AND len(ws) > 0""",
)
def _(spark, folder):
    words = documents(spark, folder).select(
        "doc_id", "lang", F.posexplode(text.words(F.col("text"))).alias("position", "word")
    )
    return readers.documents_from_tokens(words.where(F.col("lang").isin("en", "fr")), ["doc_id"])


@query("partition_pruned_scan", "SELECT doc_id, text FROM documents WHERE lang = 'de'")
def _(spark, folder):
    path = new_path(spark, "by-language")
    documents(spark, folder).select("doc_id", "text", "lang").write.partitionBy("lang").parquet(path)
    return spark.read.parquet(path).where(F.col("lang") == "de").select("doc_id", "text")


@query("record_count", "SELECT count(*) AS n_records FROM documents")
def _(spark, folder):
    path = writers.write_csv(documents(spark, folder).select("doc_id", "text"), new_path(spark, "count-csv"))
    return readers.record_count(readers.read_csv(spark, path, "doc_id long, text string"))


@query(
    "run_dataset_roundtrip",
    """SELECT conv_id, turn, text, 'prose' AS kind, CASE role WHEN 'assistant' THEN 'LLM' ELSE 'HUMAN' END AS label, 'run-1' AS run_id
       FROM conversations""",
)
def _(spark, folder):
    path = new_path(spark, "runs")
    label = F.when(F.col("role") == "assistant", "LLM").otherwise("HUMAN")
    rows = turns(spark, folder).select("conv_id", "turn", "text", label.alias("label"))
    writers.write_run(rows, path, "prose", "run-1")
    return spark.read.parquet(path)


@query(
    "append_master",
    """SELECT doc_id AS id, text, 'documents' AS run_id FROM documents
       UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark""",
)
def _(spark, folder):
    """Two runs, one of them repeated, and rows of a third that never came to its end."""
    path = new_path(spark, "master")
    docs = documents(spark, folder).select(F.col("doc_id").alias("id"), "text")
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    for rows, run in ((docs.limit(10), "documents"), (items, "benchmark"), (docs, "documents")):
        writers.append_master(rows, path, run)
    items.withColumn("run_id", F.lit("failed")).write.partitionBy("run_id").mode("append").parquet(f"{path}/rows")
    return writers.read_master(spark, path)


@query("stream_annotate", document_sql(S.clean(), "benchmark", "item_id"))
def _(spark, folder):
    """Annotation of the benchmark items by a stream of one file a batch equals the batch job."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    inbox, master = new_path(spark, "inbox"), new_path(spark, "master")
    items.repartition(3, "doc_id").write.parquet(inbox)

    terms = lexicon(spark, folder)

    def job(batch, vocabulary):
        return prose.annotate_documents(batch, F.lit("LLM"), lexicon=terms, vocabulary=vocabulary)

    annotate_stream(spark, inbox, items.schema, job, master, new_path(spark, "checkpoint"), files_per_batch=1)
    return flat(read_master(spark, master))


@query(
    "annotate_manifest",
    f"""WITH {SNIPPETS}, x AS (SELECT conv_id, turn, CASE lang WHEN 'html' THEN 'md' WHEN 'java' THEN 'txt' ELSE lang END AS lang,
          conv_id % 2 = 0 AS is_ai FROM snip)
        SELECT CASE WHEN lang = 'txt' THEN 'prose' WHEN lang IN ('c', 'cpp', 'py') THEN 'code' ELSE 'rejected' END AS job,
          CASE WHEN is_ai THEN 'LLM' ELSE 'HUMAN' END AS label, count(*) AS n FROM x GROUP BY ALL""",
)
def _(spark, folder):
    ext = F.when(F.col("lang") == "html", "md").when(F.col("lang") == "java", "txt").otherwise(F.col("lang"))
    files = snippets(spark, folder).select(
        F.concat(F.lit("in/v1.2/"), "conv_id", F.lit("-"), "turn", F.lit("."), ext).alias("path"), F.col("src").alias("text"),
        (F.col("conv_id") % 2 == 0).alias("is_ai"),
    )
    texts, code, rejected = corpora.split_manifest(files.drop("is_ai"), files.select("path", "is_ai"))
    annotated = prose.annotate_documents(texts.withColumn("doc_id", F.col("path")), F.col("label"), lexicon=lexicon(spark, folder))
    profiled = source_code.profile(code.select("path", "lang", F.col("text").alias("src"), F.col("label").alias("given")), F.col("given"))
    jobs = sets.concat_by_name(
        [f.select(F.lit(name).alias("job"), "label") for name, f in (("prose", annotated), ("code", profiled), ("rejected", rejected))]
    )
    return jobs.groupBy("job", "label").agg(F.count("*").alias("n"))


@query(
    "custom_annotator",
    "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_code_points, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_pieces FROM documents",
)
def _(spark, folder):
    def annotator(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A model would be loaded here, once per worker.
        for batch in batches:
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_code_points": batch["text"].str.len().astype("int64"),
                    "n_pieces": batch["text"].str.split(" ").str.len().astype("int64"),
                }
            )

    return annotate_with(documents(spark, folder), ["doc_id", "text"], annotator, "doc_id long, n_code_points long, n_pieces long")
