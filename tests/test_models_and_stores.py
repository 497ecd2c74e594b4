import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import grams
from quillmark.operators import features, labels, margin, models, syntax
from quillmark.plans import corpora, prose, source_code
from quillmark.plans.custom import annotate_with
from quillmark.sources import readers, writers
from quillmark.sources.shared import settle
from quillmark.streaming.annotate import annotate_stream, changes, read_master, read_vocabulary


@pytest.fixture(scope="module")
def rows(spark):
    """Two styles that a classifier must tell apart."""
    machine = [(i, f"Furthermore, the system {w} provides robust structure. It is notable.", "LLM") for i, w in enumerate("abcdefghijklmnop" * 2)]
    human = [(100 + i, f"hey {w}! so we went out, and yeah nope!! Who knows?", "HUMAN") for i, w in enumerate("qrstuvwxyzabcdef" * 2)]
    texts = spark.createDataFrame(machine + human, "doc_id long, text string, label string")
    annotated = prose.annotate_documents(texts, F.col("label"))
    return annotated.withColumn("y", labels.encode_label(F.col("label")).cast("double")).cache()


@pytest.mark.parametrize("kind", ["forest", "margin"])
def test_classifier_learns_and_reloads(rows, kind, tmp_path):
    if kind == "forest":
        blocks, metrics, classifier = models.forest_blocks(), K.METRICS, models.random_forest(trees=10)
    else:
        blocks, metrics, classifier = models.margin_blocks(), K.SCALED_METRICS, models.linear_svm()
    frame = models.with_terms(rows, blocks)
    model = models.fit(frame, blocks, metrics, classifier, scaled=kind != "forest")
    called = models.predict(model, frame)
    assert labels.accuracy(called.withColumn("y", F.col("y").cast("int")), "y", "prediction").first()["accuracy"] > 0.9
    again = models.predict(models.load(models.save(model, str(tmp_path / kind))), frame)
    assert called.select("doc_id", "prediction").exceptAll(again.select("doc_id", "prediction")).count() == 0


def test_forest_keeps_nodes_beside_rows(spark, rows):
    """Tasks do not get the trees grown so far; the trees are those that are grown with them."""
    blocks = models.forest_blocks()
    frame = settle(models.with_terms(rows, blocks), "training")
    grown = []
    for kept in (True, False):
        forest = models.random_forest(trees=5)
        assert forest.getCacheNodeIds()
        model = models.fit(frame, blocks, K.METRICS, forest.setCacheNodeIds(kept)).stages[-1]
        grown.append(model.toDebugString.split("\n", 1)[1])
    assert grown[0] == grown[1]
    assert spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("rows_of_a_block", [1000, 40, 9])
def test_the_margin_problem_is_solved(spark, monkeypatch, rows_of_a_block):
    monkeypatch.setattr(margin, "ROWS", rows_of_a_block)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(120, 4)) * (draw.random((120, 4)) < 0.7)
    y = (x @ [1.0, -2.0, 0.5, 0.0] + 0.3 + draw.normal(size=120) * 0.5 > 0).astype(float)
    vectors = [Vectors.dense(r) if i % 2 else Vectors.sparse(4, [(j, v) for j, v in enumerate(r) if v]) for i, r in enumerate(x.tolist())]
    frame = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(zip(vectors, y.tolist()))], ["id", "features", "y"])
    model = margin.MarginClassifier(c=0.5, tolerance=1e-4).fit(frame)
    w, signs = np.array(model.getOrDefault("weights")), 2 * y - 1
    padded = np.hstack([x, np.ones((120, 1))])
    primal = w @ w / 2 + 0.5 * np.maximum(0, 1 - signs * (padded @ w)).sum()
    assert model.solved and primal == pytest.approx(model.getOrDefault("objective"))
    # A plain subgradient descent finds nothing better by more than the gap.
    v, best = np.zeros(5), np.inf
    for t in range(1, 20_000):
        active = signs * (padded @ v) < 1
        v = v - (v - 0.5 * (signs[active, None] * padded[active]).sum(axis=0)) / t
        best = min(best, v @ v / 2 + 0.5 * np.maximum(0, 1 - signs * (padded @ v)).sum())
    assert primal <= best + model.getOrDefault("gap") and model.getOrDefault("gap") <= 1e-4 * primal
    called = np.array([r["prediction"] for r in model.transform(frame).orderBy("id").collect()])
    assert (called == (padded @ w > 0)).all()


def test_tfidf_by_hand(spark):
    import math

    frame = spark.createDataFrame([(1, "aa aa bb"), (2, "bb cc"), (3, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in features.tfidf(frame, features.word_terms(F.col("text")), 2).collect()}
    idf = {"aa": math.log(4 / 2) + 1, "bb": math.log(4 / 3) + 1}
    norm = math.hypot(2 * idf["aa"], idf["bb"])
    assert got == {(1, "aa"): pytest.approx(2 * idf["aa"] / norm), (1, "bb"): pytest.approx(idf["bb"] / norm), (2, "bb"): pytest.approx(1.0)}


def test_char_tfidf_counts_strips_of_texts(spark, monkeypatch):
    """The weights of the general operator, bit by bit; an n-gram leaves a strip of texts once."""
    many = "".join(map(chr, [*range(0x100, 0xD800), *range(0xE000, 0xF000)]))
    texts = ["Ab  ab\tab c", "", "a", "\x00a\x00\x00 \x00", "\U0001f600\U0001f600x\u0130\u4e2d", "aB ab" * 50, many, "Ab  ab\tab c"]
    frame = spark.createDataFrame([(i // 2 if i != 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    for top in (40, 100_000):
        plain = features.tfidf(frame, features.char_terms(F.col("text")), top)
        got = features.char_tfidf(frame, F.col("text"), top)
        assert got.schema == plain.schema
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    none = features.char_tfidf(frame.where("text = ''").unionAll(spark.createDataFrame([(9, None)], frame.schema)), F.col("text"), 5)
    assert none.count() == 0
    batch, found = pa.RecordBatch.from_pydict({"_text": texts}), []
    for size in (20, 1 << 18):
        monkeypatch.setattr(grams, "STRIP", size)
        total = Counter()
        for out in grams.totals_of(2, 4)([batch]):
            for r in out.to_pylist():
                total.update({(r["term"], "cf"): r["cf"], (r["term"], "df"): r["df"]})
        found.append(total)
    assert found[0] == found[1] and found[0]["ab", "df"] == 3
    short = "ab ab"
    terms, cf, df = grams.Counted([short, None, short], 2, 4).totals()
    assert len(terms) == len(set(terms)) and dict(zip(terms, zip(cf, df)))["ab"] == (4, 2)


def test_char_terms(one):
    raw = "Ab  c\U0001f600d"
    text = "ab c\U0001f600d"
    want = [text[i : i + n] for n in (2, 3, 4) for i in range(len(text) - n + 1)]
    assert one(raw, features.char_terms) == want
    assert one("a", features.char_terms) == []


def test_word_terms(one):
    assert one("A Bb cc-DD . e_", lambda c: features.word_terms(c, 1, 3)) == [
        "bb", "cc", "dd", "e_", "bb cc", "cc dd", "dd e_", "bb cc dd", "cc dd e_",
    ]


def test_standard_scale_uses_training_rows(spark):
    frame = spark.createDataFrame([(1, 1.0, 5.0, True), (2, 3.0, 5.0, True), (3, 9.0, 6.0, False)], "doc_id long, a double, b double, train boolean")
    got = {r["doc_id"]: (r["a"], r["b"]) for r in features.standard_scale(frame, ["a", "b"], F.col("train")).collect()}
    assert got == {1: (-1.0, 0.0), 2: (1.0, 0.0), 3: (7.0, 1.0)}


def test_classification_report(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 4 + [(1, 0)] * 2
    frame = spark.createDataFrame(pairs, "label int, prediction int")
    got = {r["class"]: r for r in labels.classification_report(frame, "label", "prediction").collect()}
    assert (got["0"]["precision"], got["0"]["recall"], got["0"]["support"]) == (0.6, 0.75, 4)
    assert got["accuracy"]["f1"] == 0.7 and got["macro avg"]["precision"] == pytest.approx((0.6 + 0.8) / 2)


def test_labels_and_languages(spark):
    frame = spark.createDataFrame([("LLM", " C++ "), ("HUMAN", "Fortran"), (None, None)], "label string, lang string")
    got = frame.select(
        labels.encode_label(F.col("label")), labels.extension_of(F.col("lang")), labels.known_extension(F.col("lang"))
    ).collect()
    assert [tuple(r) for r in got] == [(0, "cpp", "cpp"), (1, "fortran", None), (1, None, None)]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a, \"q\"\nline", ["''", "n't", "it's"], ["x"]), ("NA", [], ["null", '"'])]
    frame = spark.createDataFrame(rows, "text string, pos array<string>, lemmas array<string>")
    path = writers.write_csv(frame, str(tmp_path / "csv"))
    back = readers.read_prose_csv(spark, path, "text string, pos string, lemmas string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frame.collect()))


def test_file_readers(spark, tmp_path):
    for name, body in {"a.txt": "one\ntwo", "b.v2.py": "x = 1", "c.md": "no", "d.CPP": "int x;"}.items():
        (tmp_path / name).write_text(body)
    texts = readers.read_text_files(spark, str(tmp_path), False).collect()
    assert [(os.path.basename(r["path"]), r["text"], r["label"]) for r in texts] == [("a.txt", "one\ntwo", "HUMAN")]
    accepted, rejected = readers.read_code_files(spark, str(tmp_path), True)
    assert sorted((r["lang"], r["src"], r["label"]) for r in accepted.collect()) == [("cpp", "int x;", "LLM"), ("py", "x = 1", "LLM")]
    assert sorted(r["lang"] for r in rejected.collect()) == ["md", "txt"]
    lines = readers.read_lines(spark, str(tmp_path / "a.txt")).orderBy("line_id").collect()
    assert [r["line"] for r in lines] == ["one", "two"]


def test_a_file_for_every_text(spark, tmp_path):
    """Names and texts of any kind, repeated rows too; each task has folders of its own and no file of checksums."""
    names = ["en", "en", "a/b: 100%", "", None, "é]^", "en", "fr"]
    texts = ["one\ntwo", "same", "x", "", None, "ü\r\n", "same", "y"]
    rows = spark.createDataFrame(list(zip(names, texts)), "name string, body string").repartition(3)
    for round_ in (1, 2):
        writers.write_texts(rows, str(tmp_path / "own"), "name", "body", single=True)
        back = readers.read_text_files(spark, str(tmp_path / "own"), True)
        assert sorted(r["text"] for r in back.collect()) == sorted([f"{t or ''}\n" for t in texts] * round_)
    writers.write_texts(rows, str(tmp_path / "spark"), "name", "body")
    folders = [sorted(p.name for p in (tmp_path / at).glob("name=*")) for at in ("own", "spark")]
    assert folders[0] == folders[1]
    files = [p for p in (tmp_path / "own").rglob("*") if p.is_file()]
    assert len(files) == 16 and all(p.parent.name.startswith("part-") for p in files)


def test_manifest(spark):
    files = spark.createDataFrame([("x/a.txt", "t"), ("x/b.c.py", "t"), ("x/c.md", "t"), ("x/d.txt", "t")], "path string, text string")
    manifest = spark.createDataFrame([("x/a.txt", True), ("x/b.c.py", False), ("x/c.md", True)], "path string, is_ai boolean")
    parts = [sorted((r["path"], r["label"]) for r in f.collect()) for f in corpora.split_manifest(files, manifest)]
    assert parts == [[("x/a.txt", "LLM")], [("x/b.c.py", "HUMAN")], [("x/c.md", "LLM")]]


def test_generation_log_drops_nulls(spark):
    log = spark.createDataFrame([("int f(int a) { return a; }", " C "), (None, "c"), ("x", None)], "response string, language string")
    got = source_code.from_generation_log(log).collect()
    assert [(r["lang"], r["n_functions"]) for r in got] == [("c", 1)]


def test_stream_appends_once(spark, tmp_path):
    inbox, master, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs = spark.createDataFrame([(1, "A cat sat."), (2, "Dogs ran off!")], "doc_id long, text string")
    late = spark.createDataFrame([(3, "Late one. Here.")], "doc_id long, text string")

    def job(batch, vocabulary=None):
        return prose.annotate_documents(batch, F.lit("LLM"), vocabulary=vocabulary)

    docs.write.parquet(inbox)
    for _ in range(2):
        annotate_stream(spark, inbox, docs.schema, job, master, state)
    late.write.mode("append").parquet(inbox)
    annotate_stream(spark, inbox, docs.schema, job, master, state)
    got = read_master(spark, master)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 3]
    assert got.exceptAll(job(docs.unionByName(late))).count() == 0


STREAMED = [
    (1, "Wolves howl at tables. Cats was here."), (2, "One table stood there."), (3, "A cat and dogs; a wolf."), (None, "No tables, no dog."),
    (None, "Two cats!"), (2, "Other tables of id two."), (4, ""), (5, None), (6, "One table stood there."),
]


@pytest.mark.parametrize("cuts", [[range(9)], [[0, 7], [3, 8, 1, 5], [2, 6, 4]]])
def test_streams_do_not_depend_on_their_batches(spark, tmp_path, cuts):
    inbox, master, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id long, text string"
    for cut in cuts:
        spark.createDataFrame([STREAMED[i] for i in cut], schema).coalesce(1).write.mode("append").parquet(inbox)
        annotate_stream(spark, inbox, spark.createDataFrame([], schema).schema, lambda d, v: prose.annotate_documents(d, F.lit("LLM"), vocabulary=v), master, state, 1)
    whole = spark.createDataFrame(STREAMED, schema)
    want = prose.annotate_documents(whole, F.lit("LLM"))
    got = read_master(spark, master)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert {r["word"] for r in read_vocabulary(spark, master).collect()} == {r["word"] for r in prose.words_of(whole).collect()}
    again = [r["doc_id"] for v in range(len(cuts)) for r in changes(spark, master, v).collect()]
    assert (len(again) > 0) == (len(cuts) > 1)


def test_a_run_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "master")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    for run, frame in (("r1", rows), ("r2", rows.limit(0)), ("r1", rows), ("r3", rows.limit(1)), ("r3", rows)):
        writers.append_master(frame, path, run)
    rows.write.partitionBy().mode("append").parquet(f"{path}/rows/run_id=broken")
    got = sorted((r["run_id"], r["id"]) for r in writers.read_master(spark, path).collect())
    assert got == [("r1", 1), ("r1", 2), ("r3", 1), ("r3", 2)]


def test_empty_documents_keep_their_row(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "  "), (4, "Fine.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in prose.annotate_documents(docs, F.lit("HUMAN")).collect()}
    assert [got[i]["is_empty"] for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert got[2]["depth"] is None and got[2]["sentiment"] == 0.0 and got[2]["pos"] == []


PARSE = "doc_id long, parse_id int, tok_id int, head_id int, dep string, word string, start int, end int"


def test_syntax_comes_from_a_given_parse_only(spark):
    docs = spark.createDataFrame([(1, "Dogs bark loudly."), (1, "Dogs bark loudly."), (2, "No parse."), (None, "x y.")], "doc_id long, text string")
    edges = [(1, 0, 1, 2, "nsubj", "Dogs", 0, 4), (1, 0, 2, 0, "ROOT", "bark", 5, 9), (1, 0, 3, 2, "advmod", "loudly", 10, 16), (1, 0, 4, 2, "punct", ".", 16, 17)]
    rows = prose.annotate_documents(docs, F.lit("LLM"), parses=spark.createDataFrame(edges, PARSE)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "2", "None"]
    for row in rows:
        found = (row["depth"], row["head"], row["branching"], row["balanced"])
        assert found == ((2, 0.25 / 3, 0.25, 1.0) if row["doc_id"] == 1 else (None,) * 4)
    assert {r["depth"] for r in prose.annotate_documents(docs, F.lit("LLM")).collect()} == {None}
    assert {r["balanced"] for r in prose.annotate_sentences(docs, F.lit("LLM")).collect()} == {None}


@pytest.mark.parametrize("width", [1, 5, 4096])
def test_parses_are_aligned_by_their_place(spark, width):
    text = "  One two.  Three four five! Dr. Six said so.\nEnd"
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    spans = syntax.sentence_spans(docs)
    found = sorted((r["sent_id"], text[r["start"] : r["end"]], r["n_words"]) for r in spans.collect())
    assert found == [(0, "One two.", 2), (1, "Three four five!", 3), (2, "Dr. Six said so.", 4), (3, "End", 1)]
    # The parser's second sentence begins in our first one and ends in the third.
    parsed = spark.createDataFrame([(1, 7, 2, 5), (1, 8, 6, 33), (1, 9, 33, 45), (3, 1, 0, 9)], "doc_id long, parse_id int, start int, end int")
    got = {r["sent_id"]: r["parse_id"] for r in syntax.aligned(spans, parsed, width).collect()}
    assert got == {0: 7, 1: 8, 2: 8}


def test_custom_annotator(spark):
    def shout(batches):
        for batch in batches:
            yield batch.assign(text=batch["text"].str.upper())

    docs = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, other int")
    assert tuple(annotate_with(docs, ["doc_id", "text"], shout, "doc_id long, text string").first()) == (1, "A")


def test_many_blocks_are_settled_in_few_rounds(spark, monkeypatch):
    """Rows are dealt to blocks anew and rounds are accelerated; blocks that stayed the same took some 300 rounds."""
    monkeypatch.setattr(margin, "ROWS", 16)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(120, 4)) * (draw.random((120, 4)) < 0.7)
    y = (x @ [1.0, -2.0, 0.5, 0.0] + 0.3 + draw.normal(size=120) * 0.5 > 0).astype(float)
    frame = spark.createDataFrame([(Vectors.dense(v), t) for v, t in zip(x.tolist(), y.tolist())], ["features", "y"])
    model = margin.MarginClassifier(c=0.5, tolerance=1e-3).fit(frame)
    assert model.solved and model.getOrDefault("rounds") < 100
