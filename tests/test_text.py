import pytest
from pyspark.sql import functions as F

from quillmark.functions import patterns, text


@pytest.mark.parametrize(
    "raw, clean",
    [
        (None, ""),
        ("", ""),
        ("  \t ", ""),
        ("  # Title ** here **  ", "Title  here"),
        ("``quoted''", '"quoted"'),
        ("“curly”", '"curly"'),
        ("wait . . . what", "wait.. what"),
        ('He said "x." Then', 'He said "x. Then'),
        ("a , b ;c", "a, b;c"),
        ("line\r\nbreak", "line\nbreak"),
        ("No !? yes", "No! yes"),
    ],
)
def test_clean_text(one, raw, clean):
    assert one(raw, text.clean_text) == clean


def test_detokenising(one):
    assert one("a . b , c ? `` d '' #*", text.detokenise_spaced) == 'a. b, c? " d " '
    assert one('a . . b ? ? c ! d ""', text.detokenise_doubled) == 'a. b? c! d "'


@pytest.mark.parametrize(
    "raw, slug",
    [
        (None, "untitled"),
        ("a b/c", "a_b_c"),
        ("  it's \"x\"\n y-z.txt ", "its_x_y-z.txt"),
        ("__é ü__", "é_ü"),
    ],
)
def test_slug(one, raw, slug):
    assert one(raw, text.slug) == slug


def test_head_words(one):
    assert one(" a  b\nc d ", lambda c: text.head_words(c, 3)) == "a b c"
    assert one("", text.head_words) == ""


@pytest.mark.parametrize("items", [["NN", "''", ","], ["n't", "a"], ['"', "\\", "x y"], ["it's", 'both \' and "'], []])
def test_list_literal_round_trip(spark, items):
    frame = spark.createDataFrame([(items,)], "a array<string>")
    back = frame.select(text.write_list_literal(F.col("a")).alias("t")).select(text.list_literal(F.col("t")).alias("a"))
    assert back.first()["a"] == items


def test_prompts(one):
    assert one("x", text.discussion_prompt) == "Lets discuss x. What are your thoughts?"
    ask = one("x", lambda c: text.prompt_request(c, F.lit(None).cast("string")))
    assert ask == "Generate a short prompt with instructions to create code based on this request: x"
    assert one("x", lambda c: text.prompt_request(c, F.lit("c"))).endswith("code in c based on this request: x")
    assert one("poet", text.role_instruction) == "you are a(n) poet"
    assert one("you are a poet", text.role_instruction) == "you are a poet"


def test_patterns_avoid_dialect_traps():
    shared = patterns.CLEAN + patterns.SENTENCE_BREAKS + patterns.TOKEN_PADDING + patterns.SLUG
    for pattern, _ in shared:
        assert "(?=" not in pattern and "(?!" not in pattern and r"\b" not in pattern
