import math

import pytest
from pyspark.sql import functions as F

from quillmark.functions import code, tagging, tokens, trees
from quillmark.operators import language, nesting, opinion, syntax
from quillmark.plans import prose, source_code

LEXICON = {"good": 2.0, "bad": -2.0}


def squash(s):
    return round(s / math.sqrt(s * s + 15), 4)


@pytest.mark.parametrize(
    "raw, total",
    [
        ("", 0.0),
        ("nothing scored here", 0.0),
        ("a good day", 2.0),
        ("very good", 2.0 + 0.293),
        ("very bad", -2.0 - 0.293),
        ("slightly good", 2.0 - 0.293),
        ("very much good", 2.0 + 0.293 * 0.95),
        ("not good", 2.0 * -0.74),
        ("not so good", (2.0 + 0.293) * -0.74),
        ("isn't all that good", 2.0 * -0.74),
        ("bad but good", -2.0 * 0.5 + 2.0 * 1.5),
        ("good day!!", 2.0 + 2 * 0.292),
        ("bad day!!!!!!", -2.0 - 4 * 0.292),
        ("good? good??", 4.0 + 3 * 0.18),
        ("a GOOD day", 2.0 + 0.733),
        ("GOOD", 2.0),
        ('"good," he said', 2.0),
    ],
)
def test_polarity(spark, raw, total):
    frame = spark.createDataFrame([(1, raw)], "doc_id long, text string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "term string, score double")
    assert opinion.sentiment(frame, lexicon).first()["sentiment"] == pytest.approx(squash(total))


def test_longest_phrases_of_a_large_lexicon(spark):
    from pyspark.sql import functions as F

    rows = [(f"w{i}", 0.5) for i in range(7000)] + [("w1 w2", -1.0), ("W1  w2 w3", 3.0), ("w3 w4", 2.0), ("cut above", 1.5), ("w9", 0.25), ("", 1.0), (None, 2.0), ("w5", None)]
    lexicon = spark.createDataFrame(rows, "term string, score double")
    texts = ["w1 w2 w3 w4 yes", "w1 w2 w4", "not w1 w2", "a CUT ABOVE the rest", "w1. w2 w3", "w6999 but w9", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "w1 w2"), (None, "w3")], "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["sentiment"] for r in opinion.sentiment(docs, lexicon).join(docs, "doc_id").collect()}
    half = 0.5
    totals = [3.0 + half, -1.0 + half, -1.0 * -0.74, 1.5 + 0.733, half + half + half, half * 0.5 + half * 1.5, 0.0, 0.0]
    assert [got[i, t] for i, t in enumerate(texts)] == pytest.approx([squash(t) for t in totals])
    nulls = opinion.sentiment(docs, lexicon).where(F.col("doc_id").isNull())
    assert sorted(r["sentiment"] for r in nulls.collect()) == pytest.approx([squash(-1.0), squash(half)])


def edges(spark, rows):
    """Edges whose tokens have 10 characters each, sentence after sentence."""
    each = [(*r, f"w{r[2]}", 1000 * r[1] + 10 * r[2], 1000 * r[1] + 10 * r[2] + 9) for r in rows]
    return spark.createDataFrame(each, "doc_id long, parse_id int, tok_id int, head_id int, dep string, word string, start int, end int")


def test_tree_shapes(spark):
    chain = [(1, 0, i, i - 1, "x") for i in range(1, 41)]
    star = [(1, 1, 1, 3, "cc"), (1, 1, 2, 3, "advcl"), (1, 1, 3, 0, "ROOT"), (1, 1, 4, 3, "relcl"), (1, 1, 5, 3, "x")]
    single = [(2, 0, 1, 0, "ROOT")]
    backwards = [(3, 0, i, i + 1 if i < 6 else 0, "x") for i in range(1, 7)]
    rows = {(r["doc_id"], r["parse_id"]): r for r in syntax.parse_syntax(edges(spark, chain + star + single + backwards)).collect()}
    assert [rows[k]["depth"] for k in ((1, 0), (1, 1), (2, 0), (3, 0))] == [40, 2, 1, 6]
    s = rows[1, 1]
    assert (s["head"], s["sub_clauses"], s["coord_clauses"], s["branching"], s["balanced"]) == (2 / 5, 2, 1, 0.0, True)
    assert rows[3, 0]["branching"] == pytest.approx(-5 / 6) and not rows[3, 0]["balanced"]
    assert (s["start"], s["end"]) == (1010, 1059)


def test_document_syntax_divides_heads(spark):
    spans = spark.createDataFrame([(1, 7, 0, 0, 40, 2), (1, 7, 1, 1000, 1040, 1)], "doc_id long, text_hash long, sent_id int, start int, end int, n_words int")
    frame = syntax.sentence_syntax(spans, edges(spark, [(1, 0, 1, 2, "x"), (1, 0, 2, 0, "ROOT"), (1, 1, 1, 0, "ROOT")]))
    assert syntax.document_syntax(frame, False).first()["head"] == pytest.approx(0.25)
    assert syntax.document_syntax(frame).first()["head"] == pytest.approx(0.125)


def plain_nesting(code, tokens):
    """(nodes, depth) of brackets and other tokens, closings without an opening left out."""
    depth = top = seen = 0
    for t in tokens:
        if t in ")]}":
            depth = max(0, depth - 1)
            continue
        seen += 1
        top = max(top, depth + 1)
        depth += t in "([{"
    return seen + 1, top + 1


def plain_loops(events):
    stack, top = [], 0
    for e in events:
        if e == "}":
            stack = stack[:-1]
        else:
            stack.append(e != "{")
            top = max(top, sum(stack))
    return top


@pytest.mark.parametrize("lines", [1, 3, 7, 1000])
def test_nesting_is_the_same_however_a_source_is_cut(spark, lines):
    import random
    import re

    draw = random.Random(3)
    kinds = ["{", "}", "while (a) {", "do {", "for (i = 0; f(i); i++) {", "}", "x[(1)] = y;", "}", ")", "if (b) {", ""]
    sources = ["\n".join(draw.choice(kinds) for _ in range(n)) for n in (0, 1, 5, 40, 160)] + ["}}} {", "while (x) {" * 30 + "}" * 31 + "{"]
    frame = spark.createDataFrame([(i, s, "cpp") for i, s in enumerate(sources)], "id long, src string, lang string")
    got = {r["id"]: tuple(r)[1:] for r in nesting.nesting(frame, ["id"], lines=lines).collect()}
    for i, s in enumerate(sources):
        tokens = re.findall(r"[A-Za-z_]\w*|[0-9]+|\+\+|\S", s)
        events = re.findall(r"\b(?:for|while)[ \t]*\([^(){}]*(?:\([^()]*\)[^(){}]*)*\)\s*\{|\bdo\s*\{|\{|\}", s)
        assert got[i] == (*plain_nesting(s, tokens), plain_loops(events)), s


def test_nesting_by_indentation_and_tags(spark):
    rows = [
        ("py", "import os\nfor a in b:\n    while c:\n        f(g(1))\n    x\nwhile d:\n\n  async for y in z:\n    pass\nend"),
        ("html", "<html><body\n class='a'><p>a<br>b</p></body></html>"), ("py", ""), ("c", None),
    ]
    frame = spark.createDataFrame([(i, r[1], r[0]) for i, r in enumerate(rows)], "id long, src string, lang string")
    got = {r["id"]: tuple(r)[1:] for r in nesting.nesting(frame, ["id"]).collect()}
    # The line of f is in two loops, its 1 in two pairs of brackets; 9 lines, 2 openings, 25 other tokens.
    assert got[0] == (1 + 9 + 2 + 25, 1 + 2 + 1 + 3, 2)
    assert got[1] == (5, 5, 0) and got[2] == (1, 1, 0) and got[3] == (None, None, None)


C_SOURCE = """#include <stdio.h>
/* if for
   while */
int add(int a, int b) {
  int total = a + b; // if
  for (int i = 0; i < b; i++) {
    while (a > 0 && b) { a--; }
    do { total++; } while (total < 3);
  }
  switch (a) { case 1: return 1; default: break; }
  return total;
}
void log_it(void) {
  printf("if (x) {");
}
"""
PY_SOURCE = '''import os
# for if
def f(x):
    """if
    while"""
    for i in range(x):
        if i and x:
            return i
    return 0

async def g():
    s = "if while"
    while True:
        pass

if f(1):
    y = 2
'''


def measure(spark, src, lang):
    frame = spark.createDataFrame([(src, lang)], "src string, lang string")
    masked = code.masked(F.col("src"), F.col("lang"))
    return frame.withColumn("m", masked).select(
        code.line_count(F.col("src"), F.col("lang")).alias("loc"),
        code.control_blocks(F.col("m"), F.col("lang")).alias("control"),
        code.function_count(F.col("m"), F.col("lang")).alias("functions"),
        code.mean_complexity(F.col("m"), F.col("lang")).alias("complexity"),
        code.loop_depth(F.col("m")).alias("loops"),
    ).first().asDict()


def test_c_measures(spark):
    got = measure(spark, C_SOURCE, "c")
    # for 1, while 2 x 2 less the do, case 2, default 1; decisions: for, 2 while, &&, case.
    assert got == {"loc": 13, "control": 7, "functions": 2, "complexity": (5 + 2) / 2, "loops": 2}


def test_python_measures(spark):
    got = measure(spark, PY_SOURCE, "py")
    assert (got["loc"], got["control"], got["functions"]) == (14, 1 + 2 + 2, 2)


def test_comment_only_source(spark):
    got = measure(spark, "// nothing\n/* at\n all */\n", "cpp")
    assert (got["loc"], got["functions"], got["complexity"]) == (0, 0, 0.0)


def test_depth_of_many_trees(spark):
    """Against a plain walk; a head that is not there leaves its token and all below it without a depth."""
    import random

    draw = random.Random(3)
    trees_ = [[0 if i == 0 else draw.randint(1, i) for i in range(n)] for n in range(1, 60)]
    trees_ += [[i for i in range(40)], [0] * 9, [], [0, 1, 9, 3], [None, 1, 2], [9, 1]]

    def depth(heads, i):
        h = heads[i] or 0
        return 1 if h == 0 else None if h > len(heads) else (d := depth(heads, h - 1)) and d + 1

    frame = spark.createDataFrame([(t,) for t in trees_], "heads array<int>")
    built = frame.select(trees.tree_depth(F.col("heads")).alias("d"))
    assert [r["d"] for r in built.collect()] == [
        max((d for i in range(len(t)) if (d := depth(t, i))), default=None if t else 0) for t in trees_
    ]
    # A round is one pass over the tokens.
    assert str(built._jdf.queryExecution().analyzed()).count("transform(") <= 3


def test_words_and_tags_are_shuffled_as_text(spark):
    docs = spark.createDataFrame([(1, "A  cat sat. Dogs\u00a0ran!"), (1, ""), (None, None), (2, "``Hm'' ... ?!")], "doc_id long, text string")
    rows = prose.lemmatised(docs, F.lit("LLM"), clean=False)
    plain = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(
        tokens.sentence_tokens(F.col("text")).alias("toks")).withColumn("tags", tagging.tag_sentences("toks"))
    assert sorted(map(tuple, rows.select("toks", "tags").collect())) == sorted(map(tuple, plain.collect()))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("array_join(")


def test_markup_depth(one):
    html = "<!DOCTYPE x><html><body><p>a<br><img src='x'/></p><!-- <div><div> --></body></html>"
    got = one(html, lambda c: code.run_depth(code.tag_steps(code.masked(c, F.lit("html")))))
    assert (got["nodes"], got["depth"]) == (6, 5)


def test_language_by_naive_bayes(spark):
    import hashlib
    import math
    from collections import Counter

    rows = [("a b b", "x"), ("b c", "x"), ("c c d", "y"), ("z", None), (None, "y"), ("", "y")]
    frame = spark.createDataFrame(rows, "src string, lang string")
    model = language.train(frame, F.col("src"), F.col("lang"))
    code_of = lambda p: int(hashlib.md5(p.encode()).hexdigest()[:4], 16)
    taught = [(s, y) for s, y in rows if s is not None and y]
    counts = {y: Counter(code_of(p) for s, l in taught if l == y for p in s.split()) for y in "xy"}

    def score(text, y):
        total = sum(counts[y].values()) + language.PIECES
        prior = round(1e6 * math.log(sum(l == y for _, l in taught) / len(taught)))
        return prior + sum(round(1e6 * math.log((counts[y][code_of(p)] + 1) / total)) for p in text.split())

    texts = ["a b", "c d", "q", "", "b c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "id long, src string")
    got = {r["id"]: (r["detected"], r["score"]) for r in language.detect(docs, ["id"], F.col("src"), model).collect()}
    for i, t in enumerate([*texts]):
        best = max((score(t, y), y) for y in "xy")
        assert got[i] == (best[1], best[0])
    assert got[9] == got[3] and language.detect(docs.limit(0), ["id"], F.col("src"), model).count() == 0


def test_work_lists_keep_their_bound(spark):
    sizes = [3, 50, 1, 200, 7, 40, 51, 2, 2, 2, 49, 30, 30, 30]
    rows = [(i, "en" if i % 3 else "fr", "é" * (n // 2) + "x" * (n % 2)) for i, n in enumerate(sizes)] + [(90, None, "n"), (91, "en", None), (92, "en", "")]
    frame = spark.createDataFrame(rows, "k long, lang string, text string")
    lists = source_code.work_lists(frame, "lang", "k", "text", 100).collect()
    assert all(r["n_bytes"] <= 100 or r["n_responses"] == 1 for r in lists)
    held = sorted((r["lang"], t) for r in lists for t in r["responses"])
    assert held == sorted((g, t) for _, g, t in rows if g and t is not None)
    assert len(lists) < len(held) and all(r["n_bytes"] == sum(len(t.encode()) for t in r["responses"]) for r in lists)
    assert source_code.work_lists(frame.limit(0), "lang", "k", "text", 100).count() == 0


def test_clause_counts_see_words_beside_marks(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "He left, and, because it rained, they stayed (who knows). We saw that.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = entry.queries()
    sub = {(r["sent_id"], r["sub_clauses"]) for r in found["subordinate_clauses"](spark, str(tmp_path)).collect()}
    coord = {(r["sent_id"], r["coord_clauses"]) for r in found["coordinating_conjunctions"](spark, str(tmp_path)).collect()}
    assert sub == {(0, 2), (1, 1)} and coord == {(0, 1), (1, 0)}


def test_words_and_sentences_stay_where_their_document_is(spark):
    """Texts are shuffled, not the words of a parse; sentence rows take their numbers without a shuffle."""
    from quillmark.catalog.annotated import given_edges
    from quillmark.plans import prose

    docs = spark.createDataFrame([(1, "One two. Three four."), (2, "Five six seven.")], "doc_id long, text string")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    words = plan(given_edges(docs))
    assert words.count("Exchange") == 1 and words.index("Generate") < words.index("Exchange")
    rows = prose.annotate_sentences(docs, F.lit("LLM"), parses=given_edges(docs))
    above = plan(rows).split("Generate")[0]
    assert "Exchange" not in above and "Join" not in above
    assert [(r["doc_id"], r["sent_id"], r["depth"] > 0) for r in rows.orderBy("doc_id", "sent_id").collect()] == [(1, 0, True), (1, 1, True), (2, 0, True)]
