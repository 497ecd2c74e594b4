import math

import pytest
from pyspark.sql import functions as F

from quillmark.functions import tagging, tokens
from quillmark.operators import lexical, sentence_model


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("", []),
        ("...", [["..."]]),
        ("One two. Three!", [["One", "two", "."], ["Three", "!"]]),
        ("I can't, we'll go.", [["I", "ca", "n't", ",", "we", "'ll", "go", "."]]),
        ('He said "go on." Then left.', [["He", "said", "``", "go", "on", ".", "''"], ["Then", "left", "."]]),
        ("Mr. Fox met J. Hare. ok", [["Mr.", "Fox", "met", "J.", "Hare", "."], ["ok"]]),
        ("at 5:30, x: y", [["at", "5:30", ",", "x", ":", "y"]]),
        ("a—b (c) 3.5% …", [["a", "—", "b", "(", "c", ")", "3.5", "%", "…"]]),
        ("Été à l'eau? Öl", [["Été", "à", "l'eau", "?"], ["Öl"]]),
    ],
)
def test_sentence_tokens(one, raw, expected):
    assert one(raw, tokens.sentence_tokens) == expected


def test_sentences_and_tokens_stay_parallel(one):
    raw = ' A b.  "C d!" e? \n\n F. . . g '
    assert len(one(raw, tokens.sentences)) == len(one(raw, tokens.sentence_tokens))


def test_kept_tokens_test_the_original_case(spark):
    frame = spark.createDataFrame([("The cat and THE a_b é",)], "text string")
    plain = frame.select(tokens.kept_tokens("text")).first()[0]
    folded = frame.select(tokens.kept_tokens("text", fold_case=True)).first()[0]
    assert plain == ["the", "cat", "the", "a_b", "é"]
    assert folded == ["cat", "a_b", "é"]


def test_type_profile_by_hand(spark):
    # 6 tokens, all distinct; kept terms: red, fish, swim, fish (n = 4); counts of the types:
    # Red 0, fish 2, swim 1, like 1, Fish 0, "." 0 with "like" kept too, so n = 5.
    frame = spark.createDataFrame([(1, "Red fish swim like Fish."), (2, ""), (3, "the of"), (4, "a a a")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lexical.type_frequency_profile(frame, ["doc_id"], "text").collect()}
    r = rows[1]
    m, n, s1, s2 = 6, 5, 4, 6
    assert (r["n_tokens"], r["n_types"], r["n_kept"], r["ttr"]) == (6, m, n, 1.0)
    assert r["saliency"] == pytest.approx(s1 / (m * n))
    assert r["variance"] == pytest.approx((m * s2 - s1 * s1) / (m * n) ** 2)
    assert r["burstiness"] == pytest.approx(math.sqrt(m * s2 - s1 * s1) / s1)
    assert (rows[2]["n_tokens"], rows[2]["saliency"], rows[2]["ttr"]) == (0, 0.0, 0.0)
    assert (rows[3]["n_kept"], rows[3]["variance"]) == (0, 0.0)
    assert rows[4]["ttr"] == pytest.approx(1 / 3)


def test_sentence_profile_matches_brute_force(spark):
    raw = "Cats like cats. Dogs like cats and dogs! Birds? birds birds."
    frame = spark.createDataFrame([(raw,)], "text string")
    got = frame.select(
        tokens.type_profile(
            tokens.kept_tokens("text"), tokens.types_of_sentences(tokens.sentence_tokens(F.col("text")))
        ).alias("p"),
        tokens.sentence_tokens(F.col("text")).alias("s"),
        tokens.kept_tokens("text").alias("k"),
    ).first()
    for row, sentence in zip(got["p"], got["s"], strict=True):
        counts = [got["k"].count(t) for t in set(sentence)]
        assert (row["m"], row["s1"], row["s2"]) == (len(counts), sum(counts), sum(c * c for c in counts))


def test_tags_and_density(spark):
    frame = spark.createDataFrame([([["The", "Dog", "quickly", "jumped", "over", "3", "cats", "?"], ["Running", ";"]],)], "t array<array<string>>")
    tags = frame.select(tagging.tag_sentences("t")).first()[0]
    assert tags == [["DT", "NNP", "RB", "VBD", "IN", "CD", "NNS", "."], ["VBG", ":"]]
    density = frame.select(tagging.lexical_density(F.flatten(tagging.tag_sentences("t")))).first()[0]
    assert density == pytest.approx(5 / 10)


def test_lemmas_need_the_vocabulary(spark):
    rows = [("cats", "NNS"), ("cat", "NN"), ("was", "VBD"), ("running", "VBG"), ("glas", "NNS"), ("Cats", "NNS")]
    frame = spark.createDataFrame(rows, "word string, tag string")
    got = {r["word"]: r["lemma"] for r in lexical.lemmas(frame).collect()}
    assert got == {"cats": "cat", "cat": "cat", "was": "be", "running": "running", "glas": "glas", "Cats": "Cats"}


def test_user_lexicon_overrules(spark):
    toks = spark.createDataFrame([(1, "zorp"), (2, "blick")], "tok_id int, word string")
    lexicon = spark.createDataFrame([("blick", "JJ")], "word string, tag string")
    assert {r["word"]: r["tag"] for r in lexical.tags(toks, lexicon).collect()} == {"zorp": "NN", "blick": "JJ"}


@pytest.mark.parametrize(
    "raw, title",
    [
        ("", "untitled"),
        ("The red fox", "red_fox"),
        ("cat dog cat bird dog cat fish owl ant", "cat_dog_cat_bird_dog_cat_fish_owl"),
    ],
)
def test_title_by_lemma(one, raw, title):
    assert one(raw, lambda c: tokens.title_by_lemma(c, tokens.title_words(c))) == title


def test_other_titles(one):
    assert one("big cat, big dog; an ox", tokens.title_by_frequency) == "big_c"
    assert one("an of", tokens.title_by_frequency) == "untitled"
    assert one("write the long story now", tokens.chat_title) == "write_long_story"
    assert one("the red fox", tokens.chat_title) == "the_red_fox"


def test_titles_by_lemma(spark):
    rows = [
        (1, "The dogs and the dog saw a cat, cats were cats; dogs ran"), (None, "Wolves howl, a wolf howls and the wolf howled then"), (2, "Big red DOG's!"),
        (2, ""), (3, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = spark.createDataFrame([(w,) for w in "dog cat wolf howl run".split()], "word string")
    got = sorted((str(r["doc_id"]), r["title"]) for r in lexical.lemma_titles(docs, "doc_id", "text", words, 2).collect())
    assert got == [("1", "dog_cat"), ("2", "big_red_dogs"), ("2", "untitled"), ("3", "untitled"), ("None", "wolf_wolf")] or got == [
        ("1", "dog_cat"), ("2", "big_red_dogs"), ("2", "untitled"), ("3", "untitled"), ("None", "howl_wolf_wolf")
    ]


def plain_sentence_model(texts):
    """Counts and scores by hand: {(type, kind): score}."""
    import math
    import re
    from collections import Counter

    closing, opening = "[\"”’')\\]]*", "^[\"“‘'(\\[]+"
    plain = lambda w: re.sub("[.?!,;:]*" + closing + "$", "", re.sub(opening, "", w.lower()))
    n, k, s = Counter(), Counter(), Counter()
    for text in texts:
        words = (text or "").split()
        for i, w in enumerate(words):
            t = plain(w)
            if re.search(r"[^\W\d_]", t):
                n[t] += 1
                k[t] += bool(re.search(r"\." + closing + "$", w))
                s[t] += bool(i and re.search("[.?!]" + closing + "$", words[i - 1]))
    every, stops, after = sum(n.values()), sum(k.values()), sum(s.values())
    log = lambda h, of, p: (h * math.log(p) if h else 0) + ((of - h) * math.log(1 - p) if of - h else 0)
    out = {}
    for t in n:
        bare = len(t.replace(".", ""))
        score = 2 * (log(k[t], n[t], 0.99) - log(k[t], n[t], stops / every)) * math.exp(-bare) * (len(t) - bare + 1) * bare ** -(n[t] - k[t])
        if k[t] and score >= 0.3:
            out[t, "abbreviation"] = score
        a, b, p = s[t] / after, (n[t] - s[t]) / (every - after), n[t] / every
        tied = 2 * (log(s[t], after, a) + log(n[t] - s[t], every - after, b) - log(s[t], after, p) - log(n[t] - s[t], every - after, p))
        if a > b and tied >= 30:
            out[t, "starter"] = tied
    return out


def test_abbreviations_are_learned(spark):
    import random

    draw, texts = random.Random(2), []
    for _ in range(60):
        parts = []
        for _ in range(6):
            body = " ".join(draw.choice("house tree walks blue under dr. runs e.g. seven apples".split()) for _ in range(draw.randint(3, 9)))
            parts.append(draw.choice(["The ", "The ", "It "]) + body + " home" + draw.choice([".", ".", "!", "?\""]))
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, ""), (5, None)], "doc_id long, text string")
    model = sentence_model.train(docs)
    got = {(r["type"], r["kind"]): r["score"] for r in model.collect()}
    want = plain_sentence_model(texts)
    assert got == pytest.approx(want) and {("dr", "abbreviation"), ("e.g", "abbreviation"), ("the", "starter")} <= set(want)
    said = spark.createDataFrame(
        [(1, "He met Dr. Brown e.g. today. The end"), (1, "It was the dr. The house is (blue)! it goes on?  Yes"), (None, "no"), (2, ""), (3, None)],
        "doc_id long, text string",
    )
    cut = {(r["doc_id"], tuple(r["sentences"])) for r in sentence_model.split(said, model).collect()}
    assert cut == {
        (1, ("He met Dr. Brown e.g. today.", "The end")), (1, ("It was the dr.", "The house is (blue)!", "it goes on?", "Yes")), (None, ("no",)), (2, ()), (3, ()),
    }
    assert sentence_model.train(docs.limit(0)).count() == 0
