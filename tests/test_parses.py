"""The parse that the catalogue gives, against one made word by word."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.catalog import annotated
from quillmark.functions import parses
from quillmark.plans import prose

WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0  　"


def plain(text):
    """(parse_id, tok_id, head_id, word, start, end) of every word."""
    out, sentences = [], [[]]
    for found in re.finditer(f"[^{WHITE}]+", text or ""):
        sentences[-1].append(found)
        if len(found[0]) % 7 == 0:
            sentences.append([])
    for p, words in enumerate(sentences):
        root = len(words[0][0]) % len(words) + 1 if words else 0
        for tok, w in enumerate(words, start=1):
            n = len(w[0])
            head = 0 if tok == root else tok + 1 + n % (root - tok) if tok < root else tok - 1 - n % (tok - root)
            out.append((p, tok, head, w[0], w.start(), w.end()))
    return out


TEXTS = [
    None, "", "  ", "one", "  a  chapter of seventy\x85words \U0001F600\U0001F600 and　that's all ", "chapter chapter\nchapter",
    "If a parse, which is long, ends; " * 9,
]


def test_given_parse_equals_one_made_word_by_word(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = annotated.given_edges(docs).select("doc_id", *parses.FIELDS).collect()
    assert sorted(map(tuple, rows)) == sorted((i, *w) for i, t in enumerate(TEXTS) for w in plain(t))


def test_a_parse_does_not_depend_on_the_strips(monkeypatch):
    texts = pa.array([["a chapter of it"], [], ["", "x yy"], ["one two", "one two"], ["  "], ["and seventy more"]], pa.list_(pa.string()))
    whole = parses.edges_of(texts).to_pylist()
    monkeypatch.setattr(parses, "STRIP", 1)
    assert parses.edges_of(texts).to_pylist() == whole
    assert [len(e) for e in whole] == [4, 0, 2, 4, 0, 3]
    # Rows that repeat an id and text: words of equal number stand side by side.
    assert [e["word"] for e in whole[3]] == ["one", "one", "two", "two"] and [e["end"] for e in whole[3]] == [6, 6, 14, 14]


def test_texts_are_parsed_once_and_not_by_windows(spark):
    docs = spark.createDataFrame([(1, "a chapter of it")], "doc_id long, text string")
    counted = annotated.syntax.parse_counts(annotated.given_edges(docs))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Window" not in plan and "Sort [" not in plan


def test_a_cleaned_text_is_cleaned_once(spark):
    docs = spark.createDataFrame([(1, 'He said: ``a chapter of it" .')], "doc_id long, text string")
    rows = prose.annotate_documents(docs, F.lit("LLM"), parses=annotated.given_edges(docs))
    assert rows.count() == 1
    # Spans are measured on the text as it was written, not on one that is cleaned anew.
    assert "[#*]" not in rows._jdf.queryExecution().optimizedPlan().toString()
