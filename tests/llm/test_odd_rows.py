"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from quillmark.llm import bpe, chat, lines, mixing, neighbours, quality_knn, queries, rules, simhash, toxicity, warc

ROWS = [
    (1, "one two three four five six\nagain the very same line here", "a", 7), (2, "", "a", 8), (3, None, None, None),
    (None, "one two three four five six", "b", 1), (5, "x" * 50_000, "b", 2), (6, "word " * 3000, "a", 3),
    (7, "again the very same line here", None, 4), (7, "again the very same line here", None, 4),
]
SCHEMA = "doc_id long, text string, source string, size long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def operators(spark, docs):
    path = queries.vocabulary_path()
    mild = toxicity.fit([("good words", 0), ("bad words", 1)] * 3)
    fair = quality_knn.fit([("Good words here.", 1), ("### $$$", 0)] * 3)
    return {
        "simhash": simhash.near_duplicates(docs), "bpe": bpe.decode(bpe.encode(docs, path, out="size"), path, ids="size"),
        "mixing": mixing.plan(docs), "toxicity": toxicity.scores(docs, mild), "quality": quality_knn.scores(docs, fair),
        "rules": rules.apply(rules.ledger(docs), "v2"), "lines": lines.drop_duplicate_lines(docs),
    }


def test_every_row_has_a_result(spark, docs):
    for name, found in operators(spark, docs).items():
        assert found.count() == len(ROWS), name


def test_empty_tables_stay_empty(spark, docs):
    none = docs.limit(0)
    for name, found in operators(spark, none).items():
        assert found.count() == 0, name
    assert lines.duplicate_lines(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(vectors, F.lit(True)).count() == 0


def test_empty_texts_are_linked_and_copied_lines_go(spark, docs):
    labels = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert labels[2, 0] == labels[3, 0] == 2
    texts = {r["doc_id"]: r["text"] for r in lines.drop_duplicate_lines(docs).collect()}
    assert texts[7] == "" and texts[3] is None and texts[1] == ROWS[0][1] and texts[None] == ROWS[3][1]


def test_short_lines_and_scripts_without_blanks(spark):
    long = "東京は日本の首都であり世界最大の都市圏を形成している。" * 3
    texts = {1: f"All rights reserved.\n{long}\n\nown", 2: f"ALL  rights reserved.\n\n{long}", 3: f"ok\n{long}。", 4: "ok\nOKAY\n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_duplicate_lines(docs).collect()}
    assert got == {1: texts[1], 2: "", 3: "ok", 4: "OKAY\n"}


def test_one_row_of_each_component_stays(spark):
    unlike = [" ".join(f"{w}{i}" for i in range(60)) for w in ("ash", "birch", "cedar", "elm", "fir", "oak")]
    rows = [(None, unlike[0], "a"), (None, unlike[1], "b"), (None, unlike[1], "b"), (3, unlike[2], "c"), (3, unlike[3], "d"),
            (4, unlike[4], "e"), (None, unlike[4], "f"), (2, unlike[4].upper(), "g"), (2, unlike[4], "h"), (9, None, "i"), (None, "", "j"),
            (None, unlike[5], "k"), (None, unlike[5].upper(), "l")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.columns == ["doc_id", "text", "source"]
    assert {tuple(r) for r in got.collect()} == {rows[0], rows[1], rows[3], rows[4], rows[7], rows[9], rows[12]}
    assert got.count() == 7


def test_texts_of_one_id_lose_their_own_lines_only(spark):
    copied, own, other = "again the very same line here", "a line that no other text has", "something else of its own stands there"
    rows = [(1, copied), (2, f"{own}\n{copied}"), (2, f"{copied}\n{other}"), (2, f"{copied}\n{other}"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(lines.drop_duplicate_lines(docs).collect(), key=lambda r: r["text"] or "")
    assert [tuple(r) for r in got] == [(2, None), (2, own), (1, copied), (2, other), (2, other)]


def test_bands_miss_few_pairs_at_the_threshold():
    assert (1 - lines.SIMILARITY**lines.ROWS) ** lines.BANDS < 0.002


def test_vectors_without_direction_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, None), (6, [None, 1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0)]


def test_branches_are_ranked_and_text_comes_back(spark):
    odd = "\\ \\\\ ### </turn> \n</turn>\n"
    rows = [("t", 1, None, "user", odd, 1.0), ("t", 2, 1, "assistant", "low", 0.1), ("t", 3, 1, "assistant", odd, 0.9),
            ("u", 8, 9, "x", "circle", 1.0), ("u", 9, 8, "x", "circle", 1.0), ("v", 4, 77, "r\\\n### s", None, None)]
    frame = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    made = chat.conversations(frame).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r["tree"]: r for r in made.collect()}
    assert set(got) == {"t", "v"}
    assert [tuple(x) for x in got["t"]["turns"]] == [("user", odd), ("assistant", odd)] and got["t"]["loss"] == odd
    span = got["t"]["loss_spans"][0]
    assert "".join(s["text"] for s in got["t"]["segments"]) == got["t"]["formatted"]
    assert got["t"]["formatted"][span["start"] : span["end"]] == got["t"]["segments"][4]["text"]
    assert [tuple(x) for x in got["v"]["turns"]] == [("r\\\n### s", "")]


def test_equal_replicas_and_null_parts(spark):
    pages = spark.createDataFrame([(1, "u", "h"), (None, None, "x"), (None, "y", None), (1, "u", "h"), (5000, "v", "")], "page_id long, url string, html string")
    assert warc.audit(pages, pages).count() == 0
    assert warc.audit(pages, pages.where("page_id is not null")).count() == 2


#: Names that plans use themselves, or that callers often have.
CLASHING = (
    "target size source_size _n _start _size _src _key _block _at _row _mix _copy _shard _place _id _hash _gone _x _y _none _of"
    " _text_hash fp root key line bucket component_id score toxic quality bits kept ids decoded"
).split()


def test_clashing_columns_stay_as_they_are(spark):
    docs = spark.createDataFrame([r[:3] for r in ROWS], "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHING})
    mild = toxicity.fit([("good words", 0), ("bad words", 1)] * 3)
    found = {
        "mixing": mixing.mixture(docs), "simhash": simhash.keep_first(docs), "lines": lines.drop_duplicate_lines(docs),
        "toxicity": toxicity.keep_ordinary(docs, mild, threshold=1.1),
    }
    for name, kept in found.items():
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(r[c] == c + ("?" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for c in CLASHING), name
    assert mixing.plan(docs).columns == [c for c in docs.columns if c != "_mix"] + ["_mix"]
    labels = docs.select("doc_id", F.lit(1).alias("toxic"), F.lit(0).alias("quality"), "score", "text")
    for name, each in {
        "near": simhash.near_duplicates(docs), "scores": toxicity.scores(docs, toxicity.train(docs, labels)),
        "quality": quality_knn.scores(docs, quality_knn.train(docs, labels)), "ledger": rules.ledger(docs),
        "bpe": bpe.round_trip(docs, queries.vocabulary_path(), ["doc_id", "line"]), "lines": lines.duplicate_lines(docs),
    }.items():
        assert each.count() > 0, name


def test_empty_tables_of_other_operators(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert simhash.keep_first(docs).count() == mixing.mixture(docs).count() == 0
    assert bpe.round_trip(docs, queries.vocabulary_path(), ["doc_id"], exact="same").count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.audit(pages, pages).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversations(chat.reply_trees(turns)).count() == 0


def test_training_without_labels_or_with_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b" * 5000), (1, "a"), (4, None), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert len({r["score"] for r in toxicity.scores(docs, toxicity.train(docs, none)).collect()}) == 1
    assert len({r["score"] for r in quality_knn.scores(docs, quality_knn.train(docs, none)).collect()}) == 1
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (4, 0, 0)], "doc_id long, toxic int, quality int")
    kept = [i for i in (1, 4) if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    # A text that was refused for its size is never fetched by its id.
    assert sorted(toxicity.sample(docs, labels, "toxic", 10, 100), key=str) == sorted(
        [(t, y) for i, t, y in ((1, "a", 1), (4, None, 0)) if i in kept], key=str
    )
    assert len(toxicity.sample(docs, labels, "toxic", 10, 10_000)) == len([x for x in (1, 1, 4) if x in kept])


def test_very_long_lines(spark):
    base = " ".join(f"word{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, base), (2, base + " more"), (3, base[::-1])], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_duplicate_lines(docs).collect()}
    assert got[1] == base and got[2] == "" and got[3] == base[::-1]


def test_equal_scores_across_tiles(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(5000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame, F.col("vec_id").isin(1, 2, 4999), k=4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [
        (1, 3), (1, 5), (1, 7), (1, 9), (2, 0), (2, 4), (2, 6), (2, 8), (4999, 1), (4999, 3), (4999, 5), (4999, 7)
    ]


def test_texts_are_cut_to_strips_by_bytes_only_between_rows():
    import pyarrow as pa

    from quillmark.llm.common import strips

    texts = ["a" * 7, None, "", "é" * 10, "b" * 100, "c", "d" * 9, "e"]
    batch = pa.record_batch([pa.array(texts)], ["t"])
    cut = [b.column(0).to_pylist() for b in strips([batch, batch.slice(0, 0)], "t", 10)]
    assert [x for c in cut for x in c] == texts
    assert all(len(c) == 1 or sum(len((x or "").encode()) for x in c) <= 10 for c in cut)


def test_bpe_holds_little(monkeypatch):
    """Texts of a batch in strips: what encoding and decoding take is bounded, whatever the batch holds."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quillmark.llm import common

    words = bpe.vocabulary(queries.vocabulary_path())
    texts = [" ".join(f"w{i * j % 9973}x{i}" for j in range(200)) for i in range(1200)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    most = 0
    for strip in common.strips([batch], "text", bpe.STRIP):
        tracemalloc.start()
        found = words.encode(strip.column(0).to_pylist())
        offsets = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))
        assert words.decode(np.concatenate(found), offsets) == strip.column(0).to_pylist()
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most < 36 << 20, most
