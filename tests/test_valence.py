"""Scores of strips of texts against those of the joined look-ups, and what a plan works out."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quillmark.catalog import annotated
from quillmark.functions import valence
from quillmark.operators import opinion
from quillmark.plans import prose

TERMS = [
    ("good", 1.9), ("bad", -2.5), ("very good", 3.0), ("not very good at all", -1.25), ("but", 0.5), ("very", 1.0), ("ice cream", 0.75),
    ("cream", -0.5), ("straße", 1.5), ("ὀδυσσεύς", 2.0), ("zero", 0.0), ("New  York", 1.25),
]
TEXTS = [
    None, "", "   ", "...", "Good.", "GOOD!!! Is it? Is it?? BAD", "not very good at all, but very good", "not very good at  all.",
    "It isn't good. Hardly BAD! Ice\ncream, ice-cream; \"cream\" (good).", "But good but bad. But bad", "STRASSE Straße, ὈΔΥΣΣΕΎΣ. zero zero",
    "a good\x01bad\x02good a. b? -- !! ?? New York, NEW YORK", "Mr. Good said: extremely  bad!? No. Good", "very very\tgood very bad good ice cream but",
    "very good " * 40 + "but not bad! " * 30,
]


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def texts(spark):
    ids = [(None if i % 5 == 1 else i // 2, t) for i, t in enumerate(TEXTS + TEXTS[4:9])]
    return spark.createDataFrame(ids, "doc_id long, text string")


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(TERMS, "term string, score double")


def test_strips_and_joins_give_the_same_scores(texts, lexicon, monkeypatch):
    held = rows_of(opinion.sentiment(texts, lexicon))
    monkeypatch.setattr(opinion, "LEXICON_BYTES", 0)
    assert held == rows_of(opinion.sentiment(texts, lexicon))
    assert len(held) == texts.count()


def test_scores_do_not_depend_on_the_strips(monkeypatch):
    low = pa.array(["", "very good \n good", "but bad", "ice cream x \n\n", "not good"] * 3)
    held = valence.Lexicon([("good", 1.0, 1), ("bad", -1.0, 1), ("ice cream", 0.5, 2)])
    whole = valence.sums_of(low, low, pc.utf8_upper(low), held)
    monkeypatch.setattr(valence, "STRIP", 1)
    assert valence.sums_of(low, low, pc.utf8_upper(low), held).to_pylist() == whole.to_pylist()
    assert whole.to_pylist()[1] == {"total": pytest.approx(1.293 + 1 + 0.95 * 0.293), "sums": [1.293, 1.0]} and whole.to_pylist()[0] == {"total": 0.0, "sums": [0.0]}
    assert valence.sums_of(low[:0], low[:0], low[:0], held).to_pylist() == []


def test_annotation_is_the_same_by_strips_and_by_joins(texts, lexicon, monkeypatch):
    def both():
        label = F.lit("LLM")
        return rows_of(prose.annotate_documents(texts, label, lexicon=lexicon)), rows_of(prose.annotate_sentences(texts, label, lexicon=lexicon))

    held = both()
    monkeypatch.setattr(opinion, "LEXICON_BYTES", 0)
    assert held == both()


def test_a_held_lexicon_needs_no_shuffle(texts, lexicon):
    plan = opinion.sentiment(texts, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_sentences_are_scored_once(spark, tmp_path):
    docs = [(i, "Good things. Bad things! Is it so?") for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "good bad things are here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scores = annotated.sentence_scores(spark, str(tmp_path)).drop("document")
    assert scores.count() == 9
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    # Sentences were split, or read back and scored, a second time to ask whether there are any.
    assert plan.count("[Pp]rof") == 1 and plan.count("Filter") == plan.count("Filter isnotnull(sent_id")
