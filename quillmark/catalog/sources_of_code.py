"""Queries on source text: pages as markup, and code rendered from conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.catalog import sql as S
from quillmark.catalog.registry import query
from quillmark.catalog.texts import documents, pages, turns
from quillmark.functions import arrays as A
from quillmark.functions import code as C
from quillmark.functions import nesting as N
from quillmark.functions import patterns as P
from quillmark.functions import text
from quillmark.operators import dialogue, language, nesting
from quillmark.plans import corpora, source_code

# Each turn becomes one source in a language picked by its conversation, a line for every word of
# its whole text. A word gives the names and strings of its line, and its length and place the kind
# of line, so that lines, blocks and loops nest as the words have it, some closed that never opened.
LANGS = ["c", "cpp", "py", "java", "html"]
HEADS = {"c": "#include <stdio.h>\n", "cpp": "#include <iostream>\n", "py": "import os\n", "java": "import java.util.List;\n", "html": "<html>\n"}
LINES = {
    "c": [
        "if (@n > @l) {", "for (int @n = 0; @n < @l; @n++) {", "}", '@n[1] = "@n {" + @l; // @n }', "} /* @n\n { */",
        "while (@n && f(@l)) {", "} else if (@n) { return; }", "int f_@n(int x) { switch (x) { case @l: return x; default: break; } return @n ? 1 : 0; }",
    ],
    "cpp": [
        "if (@n == @l || !@n) {", "for (auto @n : items) {", "}", 'std::cout << "@n \\" {" << @l; // @n }', "} // for",
        "do {", "} while (@n < @l);", "auto f_@n(int x) const { for (auto y : @n) { x += y; } return x; }",
    ],
    "py": [
        "if @n > @l:", "for @n in range(@l):", '@n = "@n # (" # @n if', "x = [@n, (@l, @n)]", "while @n and @l:",
        "def f_@n(x):", 'y = {"@n": (@l,)}', "return @n or @l",
    ],
    "java": [
        "if (@n > @l) {", "for (int @n : list) {", "}", 'String @n = "}" + @l;', "} // @n {", "while (run(@n) < @l) {",
        "}", "int f_@n(int x) { try { run(); } catch (Exception e) { @n = x; } return x; }",
    ],
    "html": [
        '<div id="@n">', '<p title="@n">', "</p>", "@n", "<br>", "</div>", "<!-- <div> @n -->", '<span class="@n">@n<img src="@n"/></span>',
    ],
}
_PICK = "CASE conv_id % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LANGS)) + " END"


def _line_sql(lang: str) -> str:
    kinds = " ".join(f"WHEN {k} THEN {S.text(t)}" for k, t in enumerate(LINES[lang]))
    name = "coalesce(nullif(regexp_replace(w, '[^A-Za-z]', '', 'g'), ''), 'w') || '_' || length(w)"
    indent = "repeat('    ', length(w) % 4) || " if lang == "py" else ""
    return f"{indent}replace(replace(CASE (length(w) + i) % 8 {kinds} END, '@n', {name}), '@l', length(w)::VARCHAR)"


def _source_sql(lang: str) -> str:
    lines = f"list_transform(ws, lambda w, i: {_line_sql(lang)})"
    return f"{S.text(HEADS[lang])} || array_to_string({lines}, chr(10)) || chr(10)"


SNIPPETS = f"""t0 AS (SELECT conv_id, turn, {_PICK} AS lang, {S.words('text')} AS ws FROM conversations),
    snip AS MATERIALIZED (SELECT conv_id, turn, lang, CASE lang {" ".join(f"WHEN '{x}' THEN {_source_sql(x)}" for x in LANGS)} END AS src FROM t0)"""


def snippets(spark, folder):
    pick = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (F.col("conv_id") % 5 + 1).cast("int"))
    named = turns(spark, folder).select("conv_id", "turn", pick.alias("lang"), text.words(F.col("text")).alias("ws"))

    def source(lang):
        kinds = F.array(*[F.lit(x) for x in LINES[lang]])

        def line(w, i):
            letters = F.regexp_replace(w, "[^A-Za-z]", "")
            size = F.length(w).cast("string")
            name = F.concat(F.when(letters == "", "w").otherwise(letters), F.lit("_"), size)
            kind = F.element_at(kinds, (F.length(w) + i + 1) % 8 + 1)
            filled = F.replace(F.replace(kind, F.lit("@n"), name), F.lit("@l"), size)
            return F.concat(F.repeat(F.lit("    "), F.length(w) % 4), filled) if lang == "py" else filled

        return F.concat(F.lit(HEADS[lang]), F.array_join(F.transform("ws", line), "\n"), F.lit("\n"))

    src = F.coalesce(*[F.when(F.col("lang") == x, source(x)) for x in LANGS])
    return named.select("conv_id", "turn", "lang", src.alias("src"))


def _by(py: str, html: str, other: str) -> str:
    return f"CASE WHEN lang = 'py' THEN {py} WHEN lang = 'html' THEN {html} ELSE {other} END"


MASKED = _by(S.rewrite("src", P.MASK_PY), S.rewrite("src", P.MASK_HTML), S.rewrite("src", P.MASK_C))
BARE = _by(S.rewrite("src", P.COMMENTS_PY), S.rewrite("src", P.COMMENTS_HTML), S.rewrite("src", P.COMMENTS_C))
_PY_LINES = f"list_filter(string_split(code, chr(10)), lambda x: regexp_matches(x, {S.text(P.NOT_WS)}))"
_INDENT = "length(regexp_extract(x, '^[ \\t]*'))"
# Python lines in order, folded: decisions that a definition encloses; the indents of enclosing lines,
# and how many of them are loops.
M = f"""m0 AS MATERIALIZED (SELECT *, {MASKED} AS code, {BARE} AS bare FROM snip),
    py AS (SELECT conv_id, turn, list_transform({_PY_LINES}, lambda x: {{'ind': {_INDENT}, 'def': regexp_matches(x, {S.text(P.PY_DEF)}),
        'n': len(regexp_extract_all(x, {S.text(P.PY_DECISION)})), 'at': -1}}) AS ls FROM m0 WHERE lang = 'py'),
    pd AS (SELECT conv_id, turn, list_reduce(list_prepend({{'ind': 0, 'def': false, 'n': 0, 'at': -1}}, ls), lambda a, b: {{
        'ind': 0, 'def': false, 'n': a.n + CASE WHEN a.at < 0 OR b.ind <= a.at THEN 0 ELSE b.n END,
        'at': CASE WHEN a.at < 0 OR b.ind <= a.at THEN CASE WHEN b.def THEN b.ind ELSE -1 END ELSE a.at END}}).n AS py_decisions FROM py),
    m AS MATERIALIZED (SELECT m0.*, py_decisions FROM m0 LEFT JOIN pd USING (conv_id, turn))"""


def _n(pattern: str, of: str = "code") -> str:
    return S.matches(of, pattern)


LOC = (
    f"CAST(len(list_filter(string_split(bare, chr(10)), lambda l: regexp_matches(l, {S.text(P.NOT_WS)})"
    f" AND NOT (lang NOT IN ('py', 'html') AND regexp_matches(l, {S.text(P.UNCOUNTED_LINE)})))) AS BIGINT)"
)
TOKENS = f"({_n(P.CODE_TOKEN)} + {_by('0', '0', S.matches(S.rewrite('src', P.COMMENTS_C), P.PREPROCESSOR_LINE))})"
CONTROL_C = (
    f"({_n(r'\bif\b')} + {_n(r'\bfor\b')} + 2 * {_n(r'\bwhile\b')} - {_n(r'\bdo[\s]*\{')} + 2 * {_n(r'\bcase\b')}"
    f" + {_n(r'\bdefault[\s]*:')} - CASE WHEN lang = 'cpp' THEN {_n(P.RANGE_FOR)} ELSE 0 END)"
)
CONTROL_PY = (
    f"({_n(r'(?m)^[ \t]*(?:async )?for\b')} + {_n(r'(?m)^[ \t]*if\b')} + 2 * {_n(r'(?m)^[ \t]*while\b')}"
    f" + 2 * {_n(r'(?m)^[ \t]*case\b')})"
)
CONTROL = _by(CONTROL_PY, "0", CONTROL_C)
DEF = r"(?m)^[ \t]*(?:async[ \t]+)?def\b"
FUNCTIONS = f"CAST({_by(_n(DEF), '0', f'greatest({_n(P.C_FUNCTION)} - {_n(P.C_BLOCK_HEAD)}, 0)')} AS BIGINT)"
DECISIONS_C = f"({_n(r'\b(?:if|for|while|case|catch)\b')} + {_n(r'&&|\|\||\?')})"
DECISIONS_PY = "coalesce(py_decisions, 0)"
DECISIONS = _by(DECISIONS_PY, "0", DECISIONS_C)
NAMES = _by(
    S.all_matches("code", P.ASSIGNED_NAME, 1), S.all_matches("code", P.ATTRIBUTE, 1), S.all_matches("code", P.ASSIGNED_NAME, 1)
)
_VOID = S.names(P.VOID_TAGS)


def steps_sql(code: str) -> str:
    return (
        f"list_transform({S.all_matches(code, P.TAG)}, lambda t: CASE WHEN starts_with(t, '</') THEN -1 "
        f"WHEN ends_with(t, '/>') OR lower(regexp_extract(t, '^<([A-Za-z][A-Za-z0-9]*)', 1)) IN {_VOID} THEN 0 ELSE 1 END)"
    )


_STEPS = (
    f"list_transform({S.all_matches('x', P.CODE_TOKEN)}, lambda b: CASE WHEN b IN ('(', '[', '{{') THEN 1 WHEN b IN (')', ']', '}}') THEN -1 ELSE 0 END)"
)
_SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def floored(name: str, source: str, key: str) -> str:
    """CTEs name: events (key, i, step) with ``now``, their depth if closings that open nothing are ignored."""
    order = f"(PARTITION BY {key} ORDER BY i {_SO_FAR})"
    return f"""{name}0 AS (SELECT *, sum(step) OVER {order} AS s FROM {source}),
    {name} AS (SELECT *, s - least(0, min(s) OVER {order}) AS now FROM {name}0)"""


# Lines of Python are blocks under the last line that is less indented; elsewhere a source is one line.
NEST = f"""ls AS (SELECT conv_id, turn, lang, CASE WHEN lang = 'py' THEN {_PY_LINES} ELSE [code] END AS ls FROM m WHERE lang <> 'html'),
    ln AS (SELECT conv_id, turn, lang, generate_subscripts(ls, 1) AS line, unnest(ls) AS x FROM ls),
    stacks AS (SELECT conv_id, turn, list_reduce(list_prepend({{'stack': []::INTEGER[], 'levels': []::BIGINT[]}}, list_transform(ls, lambda x: {{'stack': [{_INDENT}::INTEGER], 'levels': []::BIGINT[]}})),
        lambda a, b: {{'stack': list_append(list_filter(a.stack, lambda s: s < b.stack[1]), b.stack[1]),
          'levels': list_append(a.levels, len(list_filter(a.stack, lambda s: s < b.stack[1]))::BIGINT)}}).levels AS levels FROM ls WHERE lang = 'py'),
    lv AS (SELECT conv_id, turn, generate_subscripts(levels, 1) AS line, unnest(levels) + 1 AS level FROM stacks),
    ev AS (SELECT conv_id, turn, line, generate_subscripts(st, 1) AS i, unnest(st) AS step FROM (SELECT conv_id, turn, line, {_STEPS} AS st FROM ln)),
    {floored('run', 'ev', 'conv_id, turn, line')},
    inner_ AS (SELECT conv_id, turn, line, count(*) FILTER (step >= 0) AS seen, max(now + CASE WHEN step = 0 THEN 1 ELSE 0 END) AS top FROM run GROUP BY ALL),
    nest AS (SELECT conv_id, turn, sum(coalesce(seen, 0) + CASE WHEN level IS NULL THEN 0 ELSE 1 END)::BIGINT AS seen,
        max(coalesce(top, 0) + coalesce(level, 0))::BIGINT AS top FROM ln LEFT JOIN inner_ USING (conv_id, turn, line) LEFT JOIN lv USING (conv_id, turn, line) GROUP BY ALL
      UNION ALL SELECT conv_id, turn, count(*) FILTER (step >= 0), greatest(max(s + CASE WHEN step = 0 THEN 1 ELSE 0 END), 0)
      FROM (SELECT *, sum(step) OVER (PARTITION BY conv_id, turn ORDER BY i) AS s FROM (
        SELECT conv_id, turn, generate_subscripts(st, 1) AS i, unnest(st) AS step FROM (SELECT conv_id, turn, {steps_sql('code')} AS st FROM m WHERE lang = 'html'))) GROUP BY ALL)"""
_NODES = "CAST(coalesce(nest.seen, 0) + 1 AS BIGINT)"
_DEPTH = "CAST(coalesce(nest.top, 0) + 1 AS BIGINT)"


def _metric(name: str, column: str, sql: str, build):
    @query(name, f"WITH {SNIPPETS}, {M} SELECT conv_id, turn, lang, {sql} AS {column} FROM m")
    def _(spark, folder):
        lang = F.col("lang")
        masked = snippets(spark, folder).withColumn("code", C.masked(F.col("src"), lang))
        return masked.select("conv_id", "turn", "lang", build(F.col("src"), F.col("code"), lang).alias(column))


_metric("code_nloc", "loc", LOC, lambda src, code, lang: C.line_count(src, lang))
_metric("code_token_count", "n_tokens", f"CAST({TOKENS} AS BIGINT)", lambda src, code, lang: C.token_count(src, lang))
_metric("function_count", "n_functions", FUNCTIONS, lambda src, code, lang: C.function_count(code, lang))
_metric(
    "code_complexity", "complexity",
    f"CASE WHEN {FUNCTIONS} > 0 THEN ({DECISIONS} + {FUNCTIONS}) / {FUNCTIONS} ELSE 0 END",
    lambda src, code, lang: C.mean_complexity(code, lang),
)
_metric(
    "control_density", "control_density", f"CASE WHEN {LOC} > 0 THEN {CONTROL} / {LOC} ELSE 0 END",
    lambda src, code, lang: F.when(
        C.line_count(src, lang) > 0, C.control_blocks(code, lang) / C.line_count(src, lang)
    ).otherwise(F.lit(0.0)),
)


@query(
    "code_profile",
    f"""WITH {SNIPPETS}, {M}, {NEST} SELECT m.conv_id, m.turn, lang, src, {LOC} AS loc, CAST({TOKENS} AS BIGINT) AS n_tokens,
        {_NODES} AS n_nodes, {FUNCTIONS} AS n_functions,
        coalesce(CAST(list_sum(list_transform({NAMES}, lambda x: length(x))) AS DOUBLE) / len({NAMES}), 0) AS avg_variable_length,
        {_DEPTH} AS max_depth, CASE WHEN {LOC} > 0 THEN {CONTROL} / {LOC} ELSE 0 END AS control_density,
        CASE WHEN {FUNCTIONS} > 0 THEN ({DECISIONS} + {FUNCTIONS}) / {FUNCTIONS} ELSE 0 END AS complexity, 'LLM' AS label
        FROM m LEFT JOIN nest USING (conv_id, turn)""",
)
def code_profile(spark, folder):
    return source_code.profile(snippets(spark, folder), F.lit("LLM"))


@query(
    "build_code_corpus",
    f"""WITH {SNIPPETS}, {M} SELECT trim(lower(lang)) AS lang, count(*) AS n_rows, CAST(sum({LOC}) AS BIGINT) AS loc,
        CAST(sum({TOKENS}) AS BIGINT) AS n_tokens, CAST(sum({FUNCTIONS}) AS BIGINT) AS n_functions
        FROM m WHERE lang <> 'html' GROUP BY 1""",
)
def _(spark, folder):
    log = snippets(spark, folder).withColumn("language", F.nullif("lang", F.lit("html"))).drop("lang")
    rows = source_code.from_generation_log(log.withColumnRenamed("src", "response"))
    return rows.groupBy("lang").agg(
        F.count("*").alias("n_rows"), *[F.sum(c).alias(c) for c in ("loc", "n_tokens", "n_functions")]
    )


@query(
    "build_human_code",
    f"""WITH {SNIPPETS}, k AS (SELECT conv_id * 100000 + turn AS doc_id, conv_id, turn, lang, src, row_number() OVER (PARTITION BY lang
          ORDER BY conv_id * 100000 + turn) AS rn FROM snip),
        m AS (SELECT *, {MASKED} AS code, {BARE} AS bare FROM k WHERE rn <= 25)
        SELECT doc_id, lang, {LOC} AS loc, CAST({TOKENS} AS BIGINT) AS n_tokens, {FUNCTIONS} AS n_functions, 'HUMAN' AS label FROM m""",
)
def _(spark, folder):
    files = snippets(spark, folder).withColumn("doc_id", F.col("conv_id") * 100000 + F.col("turn"))
    return corpora.human_code(files, 25).select("doc_id", "lang", "loc", "n_tokens", "n_functions", "label")


HTML = f"""m AS (SELECT page_id, {S.rewrite('html', P.MASK_HTML)} AS code FROM pages),
    ev AS (SELECT page_id, generate_subscripts(st, 1) AS i, unnest(st) AS step FROM (SELECT page_id, {steps_sql('code')} AS st FROM m)),
    run AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY i) AS now FROM ev)"""


@query(
    "markup_depth",
    f"""WITH {HTML}, a AS (SELECT page_id, count(*) FILTER (step >= 0) AS seen,
          greatest(max(now + CASE WHEN step = 0 THEN 1 ELSE 0 END), 0) AS top FROM run GROUP BY 1)
        SELECT page_id, CAST(coalesce(seen, 0) + 1 AS BIGINT) AS n_nodes, CAST(coalesce(top, 0) + 1 AS BIGINT) AS max_depth
        FROM pages LEFT JOIN a USING (page_id)""",
)
def _(spark, folder):
    code = pages(spark, folder).select("page_id", C.masked(F.col("html"), F.lit("html")).alias("code"))
    return code.select("page_id", C.run_depth(C.tag_steps(F.col("code"))).alias("n")).select(
        "page_id", F.col("n.nodes").alias("n_nodes"), F.col("n.depth").alias("max_depth")
    )


@query(
    "identifier_length",
    f"""SELECT page_id, CAST(len(names) AS BIGINT) AS n_names,
          coalesce(CAST(list_sum(list_transform(names, lambda x: length(x))) AS DOUBLE) / len(names), 0) AS avg_variable_length
        FROM (SELECT page_id, {S.all_matches(S.rewrite('html', P.MASK_HTML), P.ATTRIBUTE, 1)} AS names FROM pages)""",
)
def _(spark, folder):
    lang = F.lit("html")
    names = pages(spark, folder).select("page_id", C.name_lengths(C.masked(F.col("html"), lang), lang).alias("n"))
    size = F.size("n").cast("long")
    return names.select("page_id", size.alias("n_names"), A.mean_of(size, A.sum_long(F.col("n"))).alias("avg_variable_length"))


# A loop lasts from its brace to the one that closes it, the next event at its depth. Loops of Python
# last as long as lines are more indented.
LOOPS = f"""lev AS (SELECT conv_id, turn, generate_subscripts(es, 1) AS i, unnest(es) AS e FROM (
        SELECT conv_id, turn, {S.all_matches('code', N.LOOP_EVENT)} AS es FROM m WHERE lang NOT IN ('py', 'html'))),
    steps AS (SELECT *, CASE WHEN e = '}}' THEN -1 ELSE 1 END AS step, CASE WHEN e IN ('{{', '}}') THEN 0 ELSE 1 END AS loop FROM lev),
    {floored('deep', 'steps', 'conv_id, turn')},
    lvl AS (SELECT *, CASE WHEN step = 1 THEN now ELSE now + 1 END AS level FROM (
        SELECT *, coalesce(lag(now) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) AS before FROM deep) WHERE step = 1 OR before > 0),
    pairs AS (SELECT *, CASE WHEN step = 1 THEN loop ELSE lag(loop) OVER (PARTITION BY conv_id, turn, level ORDER BY i) END AS own FROM lvl),
    open_loops AS (SELECT conv_id, turn, sum(step * own) OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM pairs),
    py_loops AS (SELECT conv_id, turn, list_max(list_reduce(list_prepend({{'stack': []::INTEGER[], 'loops': [0]::BIGINT[]}}, list_transform({_PY_LINES}, lambda x: {{
          'stack': [{_INDENT}::INTEGER * 2 + regexp_matches(x, {S.text(N.PY_LOOP)})::INTEGER], 'loops': []::BIGINT[]}})),
        lambda a, b: {{'stack': list_append(list_filter(a.stack, lambda s: s // 2 < b.stack[1] // 2), b.stack[1]),
          'loops': list_append(a.loops, (b.stack[1] % 2 + list_sum(list_prepend(0, list_transform(list_filter(a.stack, lambda s: s // 2 < b.stack[1] // 2), lambda s: s % 2))))::BIGINT)}}).loops) AS n
      FROM m WHERE lang = 'py'),
    loops AS (SELECT conv_id, turn, max(n) AS n FROM (SELECT * FROM open_loops UNION ALL SELECT * FROM py_loops) GROUP BY ALL)"""


@query(
    "loop_nest_depth",
    f"""WITH {SNIPPETS}, {M}, {NEST}, {LOOPS}
        SELECT m.conv_id, m.turn, {_NODES} AS n_nodes, {_DEPTH} AS max_depth, CAST(greatest(coalesce(n, 0), 0) AS BIGINT) AS loop_depth
        FROM m LEFT JOIN nest USING (conv_id, turn) LEFT JOIN loops USING (conv_id, turn) WHERE lang <> 'html'""",
)
def _(spark, folder):
    code = snippets(spark, folder).where("lang <> 'html'")
    return nesting.nesting(code, ["conv_id", "turn"], lines=64)


# Half of the conversations teach, the other half is called: logarithms in millionths, so sums are exact.
_LOG = "CAST(round(1000000 * ln({0})) AS BIGINT)"
BAYES = f"""pc AS MATERIALIZED (SELECT conv_id, turn, lang, CAST('0x' || left(md5(p), 4) AS INTEGER) AS b FROM (
        SELECT conv_id, turn, lang, unnest({S.all_matches('src', P.CODE_TOKEN)}) AS p FROM snip)),
    nb AS (SELECT lang, b, count(*) AS n FROM pc WHERE conv_id % 2 = 0 GROUP BY ALL),
    nc AS (SELECT lang, sum(n) AS total FROM nb GROUP BY lang),
    prior AS (SELECT lang, {_LOG.format('count(*) / (SELECT count(*) FROM snip WHERE conv_id % 2 = 0)')} AS p,
        {_LOG.format('1 / (coalesce(any_value(total), 0) + 65536)')} AS unseen, any_value(total) AS total
      FROM snip LEFT JOIN nc USING (lang) WHERE conv_id % 2 = 0 GROUP BY lang),
    wt AS (SELECT lang, b, {_LOG.format('(n + 1) / (total + 65536)')} - unseen AS w FROM nb JOIN prior USING (lang)),
    df AS (SELECT conv_id, turn, b, count(*) AS c FROM pc WHERE conv_id % 2 = 1 GROUP BY ALL),
    dn AS (SELECT conv_id, turn, CAST(sum(c) AS BIGINT) AS n FROM df GROUP BY ALL),
    ds AS (SELECT conv_id, turn, wt.lang, CAST(sum(c * w) AS BIGINT) AS s FROM df JOIN wt USING (b) GROUP BY ALL),
    sc AS (SELECT conv_id, turn, prior.lang, p + coalesce(n, 0) * unseen + coalesce(s, 0) AS score FROM snip JOIN prior ON snip.conv_id % 2 = 1
      LEFT JOIN dn USING (conv_id, turn) LEFT JOIN ds ON ds.conv_id = snip.conv_id AND ds.turn = snip.turn AND ds.lang = prior.lang)"""


@query(
    "detect_code_language",
    f"""WITH {SNIPPETS}, {BAYES} SELECT conv_id, turn, struct_extract(best, 'lang') AS detected, struct_extract(best, 's')::BIGINT AS score
        FROM (SELECT conv_id, turn, max({{'s': score, 'lang': lang}}) AS best FROM sc GROUP BY ALL)""",
)
def _(spark, folder):
    code = snippets(spark, folder)
    model = language.train(code.where("conv_id % 2 = 0"), F.col("src"), F.col("lang"))
    return language.detect(code.where("conv_id % 2 = 1"), ["conv_id", "turn"], F.col("src"), model)


@query(
    "session_concat",
    """SELECT conv_id, string_agg(chr(10) || chr(10) || text, '' ORDER BY turn) AS text, count(*) AS n_items
       FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
)
def _(spark, folder):
    return dialogue.session_text(turns(spark, folder))


@query(
    "group_by_language",
    """WITH r AS (SELECT lang, doc_id, text, strlen(text) AS n FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
        l AS (SELECT lang, doc_id, text, n, 's' || (coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 10000)::BIGINT AS list_id FROM r WHERE n <= 10000
          UNION ALL SELECT lang, doc_id, text, n, 'l' || doc_id FROM r WHERE n > 10000)
        SELECT lang, list_id, string_agg(text, chr(30) ORDER BY doc_id) AS responses, count(*) AS n_responses, CAST(sum(n) AS BIGINT) AS n_bytes
        FROM l GROUP BY lang, list_id""",
)
def _(spark, folder):
    lists = source_code.work_lists(documents(spark, folder), "lang", "doc_id", "text", 20_000)
    return lists.withColumn("responses", F.array_join("responses", "\x1e"))
