"""One query per operator over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import (
    bpe, chat, lines, manifest, mixing, neighbours, phrases, quality_knn, rules, sharding, simhash, toxicity, warc,
)
from quillmark.llm.common import held_out
from quillmark.sources.tables import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def simhash_query(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), size=3, distance=2)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def bpe_query(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary_path()
    docs = table(spark, folder, "documents")
    return bpe.round_trip(docs, path, ["doc_id"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def mixing_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mix = mixing.plan(docs)
    return mix.select(
        "doc_id", "_mix.size", "_mix.source_size", "_mix.target",
        (F.col("_mix.size") * F.size("_mix.copies")).alias("taken"), F.array_join(F.col("_mix.copies.shard").cast("array<string>"), ",").alias("shards"),
    )


def ablation_query(spark: SparkSession, folder: str) -> DataFrame:
    return rules.ablation(rules.ledger(table(spark, folder, "documents")), "v2")


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return _scored(toxicity.scores(docs, model), 0.3)


def lines_query(spark: SparkSession, folder: str) -> DataFrame:
    return lines.duplicate_lines(table(spark, folder, "documents").select("doc_id", "text"))


def warc_replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages, and a replica of them that lost some records and changed others by their ids."""
    lost = F.col("page_id") % 193 == 7
    hurt = F.col("page_id") % 97 == 13
    html: Column = F.when(hurt, F.concat(F.substring("html", 2, 1 << 30), F.lit("?!"))).otherwise(F.col("html"))
    return pages, pages.where(~F.coalesce(lost, F.lit(False))).withColumn("html", html)


def warc_query(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.audit(*warc_replicas(table(spark, folder, "pages").select("page_id", "url", "html")))
    return found.fillna(-1, ["offset_a", "length_a", "offset_b", "length_b"]).fillna("", ["sha256_a", "sha256_b"])


def chat_query(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    trees = chat.reply_trees(turns.unionByName(own))
    made = chat.conversations(trees).withColumn("_turns", chat.read_back(F.col("formatted")))
    plain = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("segments"))
    return made.select(
        F.substring("tree", 2, 64).try_cast("long").alias("conv_id"), F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_knn.train(docs, table(spark, folder, "labels"))
    return _scored(quality_knn.scores(docs, model), 0.7)


def neighbours_query(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def rules_query(spark: SparkSession, folder: str) -> DataFrame:
    entries = rules.apply(rules.ledger(table(spark, folder, "documents")), "v1")
    failed = F.col("bits").bitwiseAND(F.lit(rules.mask("base"))) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "kept", "bits",
    )


def manifest_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    leaf = lambda text: manifest.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(struck, lowered).otherwise(F.col("text"))
    found = manifest.proofs(docs, leaf(F.col("text")), F.col("lang"), F.col("doc_id"), shown=leaf(tampered))
    found = found.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        manifest.fold(F.col("shown"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def sharding_query(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.shard(table(spark, folder, "documents"), shards=16)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def phrases_query(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents").select("doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash_query,
    "op2_bpe": bpe_query,
    "op3_mixing": mixing_query,
    "op4_toxicity": toxicity_query,
    "op5_lines": lines_query,
    "op6_warc": warc_query,
    "op7_chat": chat_query,
    "op8_quality": quality_query,
    "op9_neighbours": neighbours_query,
    "op10_rules": rules_query,
    "rules_ablation": ablation_query,
    "op11_manifest": manifest_query,
    "op12_sharding": sharding_query,
    "op13_phrases": phrases_query,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LEDGER = f"""
        WITH d AS MATERIALIZED (
          SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
        g AS (SELECT id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
        wins AS MATERIALIZED (
          SELECT id, i, x || ' ' || lead(x, 1) OVER s || ' ' || lead(x, 2) OVER s || ' ' || lead(x, 3) OVER s || ' ' || lead(x, 4) OVER s AS g
          FROM g WINDOW s AS (PARTITION BY id ORDER BY i)),
        rep AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM wins WHERE g IS NOT NULL) WHERE n > 1),
        gaps AS (SELECT id, least(5, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - i, 5)) AS c FROM rep),
        r AS (SELECT id, sum(c)::BIGINT AS n_repeat_words FROM gaps GROUP BY id),
        m AS (
          SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
            length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS upper
          FROM d LEFT JOIN r USING (id)),
        f AS (SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines FROM m),
        b AS (SELECT *,
            (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
            + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT
            + 32 * (10 * n_dup_lines > 3 * len(l))::BIGINT + 64 * (2 * upper > letters)::BIGINT AS bits FROM f)"""


def _climbed(name: str, levels: int) -> str:
    """SQL: tables name1, name2, ... of ever higher nodes above name0 (g, slot, total, node, before, after)."""
    run = "PARTITION BY g, slot // 8 ORDER BY slot"
    out = []
    for i in range(1, levels + 1):
        out.append(f"""{name}{i} AS MATERIALIZED (
          SELECT *, coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM (
            SELECT g, slot // 8 AS slot, (any_value(total) + 7) // 8 AS total,
              CASE WHEN any_value(total) > 1 THEN sha256(string_agg(node, '' ORDER BY slot)) ELSE any_value(node) END AS node
            FROM {name}{i - 1} GROUP BY g, slot // 8))""")
    return ", ".join(out)


def _first_level(rows: str) -> str:
    run = "PARTITION BY g, slot // 8 ORDER BY slot"
    return (
        f"SELECT *, coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, "
        f"coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM ({rows})"
    )


#: Levels of the trees that the SQL spells out: documents of a language, and languages.
DEEP, FLAT = 9, 3
_CRC = (
    "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"
)


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')" for x in fields) + ")"


def _manifest_sql() -> str:
    steps, proof, folded = [], [], "shown"
    for name, levels, slot in (("t", DEEP, "slot"), ("u", FLAT, "u_slot")):
        for i in range(levels):
            steps.append(f"JOIN {name}{i} ON {name}{i}.g = {'d.g' if name == 't' else chr(39) * 2} AND {name}{i}.slot = d.{slot} // {8 ** i}")
            proof.append(f"CASE WHEN {name}{i}.total > 1 THEN {name}{i}.before || {name}{i}.after ELSE '' END")
    plan = [(f"t{i}", "f" if i else "shown") for i in range(DEEP)] + [(f"u{i}", "f") for i in range(FLAT)]
    base = "SELECT d.*, " + " || ".join(proof) + " AS proof, " + ", ".join(
        f"{n}.total AS {n}_total, {n}.before AS {n}_before, {n}.after AS {n}_after" for n, _ in plan
    ) + " FROM (SELECT d0.*, u0.slot AS u_slot FROM d0 JOIN u0 ON u0.name = d0.g) d " + " ".join(steps)
    chain, last = [f"f0 AS MATERIALIZED (SELECT *, {folded} AS h0 FROM ({base}))"], 0
    for i, (n, _) in enumerate(plan):
        chain.append(f"f{i + 1} AS (SELECT *, CASE WHEN {n}_total > 1 THEN sha256({n}_before || h{i} || {n}_after) ELSE h{i} END AS h{i + 1} FROM f{i})")
        last = i + 1
    return f"""
        WITH e AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf_sql('text')} AS leaf,
            CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              ELSE {_leaf_sql('text')} END AS shown FROM documents),
        d0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS slot,
            count(*) OVER (PARTITION BY g) AS total FROM e),
        t0 AS MATERIALIZED ({_first_level("SELECT g, slot, total, leaf AS node FROM d0")}), {_climbed("t", DEEP)},
        u0 AS MATERIALIZED ({_first_level(f"SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS slot, count(*) OVER () AS total, node FROM t{DEEP}")}),
        {_climbed("u", FLAT)}, {", ".join(chain)}
        SELECT doc_id, leaf, t{DEEP}.node AS subroot, u{FLAT}.node AS root, sha256(proof) AS proof_sha256,
          h{last} AS folded_root, h{last} = u{FLAT}.node AS verified
        FROM f{last} JOIN t{DEEP} ON t{DEEP}.g = f{last}.g CROSS JOIN u{FLAT}"""


def _phrases_sql(least: int = 100, k: int = 2000) -> str:
    lead = lambda i: f"lead(w, {i}) OVER s"
    runs = ["w", *(" || ' ' || ".join(["w", *(lead(i) for i in range(1, size))]) for size in range(2, 6))]
    columns = ", ".join(f"{run} AS g{size}" for size, run in enumerate(runs, 1))
    grams = " UNION ALL ".join(f"SELECT lang, {size} AS size, g{size} AS phrase FROM grams WHERE g{size} IS NOT NULL" for size in range(1, 6))
    return f"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
            regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
        p AS (SELECT id, lang, generate_subscripts(ps, 1) AS pno, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM d),
        t AS (SELECT id, lang, pno, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM p),
        grams AS MATERIALIZED (SELECT lang, {columns} FROM t WINDOW s AS (PARTITION BY id, pno ORDER BY i)),
        f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS c FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
        n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
        s AS (SELECT c.lang, c.phrase, c.size, c.c AS a, c.k, x.c AS l, y.c AS r, n.n,
            (1000::HUGEINT * c.c * n.n) // (x.c::HUGEINT * y.c) AS score
          FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[:c.k], ' ')
          JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ') JOIN n ON n.lang = c.lang),
        m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        part AS (SELECT DISTINCT b.lang, b.phrase FROM f b JOIN f h ON h.lang = b.lang AND h.size > b.size AND 100 * h.c >= 100 * b.c
            AND contains(' ' || h.phrase || ' ', ' ' || b.phrase || ' ') WHERE b.size > 1),
        z AS (SELECT m.* FROM m ANTI JOIN part ON part.lang = m.lang AND part.phrase = m.phrase),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= {k}"""


SQL: dict[str, str] = {
    "op11_manifest": _manifest_sql(),
    "op13_phrases": _phrases_sql(),
    "op7_chat": r"""
        WITH t AS (
          SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS esc FROM t)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(4 + length(role) + 1 + length(esc) + 9)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_neighbours": """
        WITH v AS (
          SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_warc": r"""
        WITH r AS (
          SELECT page_id, url, html, page_id // 4096 AS file,
            page_id % 193 = 7 AS lost, page_id % 97 = 13 AS hurt FROM pages),
        b AS (SELECT *, CASE WHEN hurt THEN substr(html, 2) || '?!' ELSE html END AS html_b FROM r),
        x AS (
          SELECT page_id, file, lost, hurt,
            'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
              || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head,
            chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, html_b FROM b),
        y AS (SELECT page_id, file, lost, hurt, head || strlen(html) || gap || html || gap AS ra,
                head || strlen(html_b) || gap || html_b || gap AS rb FROM x),
        z AS (SELECT *, CASE WHEN lost THEN 0 ELSE strlen(rb) END AS nb FROM y),
        o AS (SELECT *,
            coalesce(sum(strlen(ra)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS oa,
            coalesce(sum(nb) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ob FROM z)
        SELECT page_id, CASE WHEN lost THEN 'missing' ELSE 'changed' END AS status,
          oa AS offset_a, strlen(ra) AS length_a, sha256(ra) AS sha256_a,
          CASE WHEN lost THEN -1 ELSE ob END AS offset_b, CASE WHEN lost THEN -1 ELSE strlen(rb) END AS length_b,
          CASE WHEN lost THEN '' ELSE sha256(rb) END AS sha256_b
        FROM o WHERE lost OR hurt""",
    "op10_rules": _LEDGER + """
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words,
          bits & 3 <> 0 AS base_failed, bits & 31 = 0 AS kept, bits FROM b""",
    "rules_ablation": _LEDGER + f"""
        , names AS (SELECT unnest({list(rules.rules_names())}) AS rule, unnest({[1 << i for i in range(len(rules.rules_names()))]}) AS bit)
        SELECT rule, sum((bits & bit <> 0)::BIGINT)::BIGINT AS n_failed, sum((bits = bit)::BIGINT)::BIGINT AS n_only,
          sum((bits = 0 OR bits = bit)::BIGINT)::BIGINT AS n_kept_without FROM b CROSS JOIN names GROUP BY rule""",
}
