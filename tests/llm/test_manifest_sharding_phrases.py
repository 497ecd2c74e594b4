"""The manifest, sharding and phrase operators against plain versions, and on odd rows."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import manifest, phrases, queries, sharding
from quillmark.sources.tables import table

FOLDER = os.environ.get("QUILLMARK_TABLES", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(d, text):
    fields = [d["doc_id"], d["source"], d["lang"], d["n_chars"], text]
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def plain_tree(nodes):
    """Root, and for every node its path of (before, after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k - k % 8 : k - k % 8 + 8]
            paths[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        at = [k // 8 for k in at]
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return (level[0] if level else None), paths


def plain_manifest(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for d in docs:
        groups[d["lang"]].append((d["doc_id"] is None, d["doc_id"] or 0, plain_leaf(d, d["text"]), d))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, upper = plain_tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, upper):
        for (_, _, leaf, d), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0
            node = plain_leaf(d, d["text"].translate(lower) if hit and d["text"] is not None else d["text"])
            for before, after in path + above:
                node = h(before, node, after)
            out.append((d["doc_id"], leaf, trees[g][0], root, h(*(x for p in path + above for x in p)), node, node == root))
    return Counter(out)


def run_manifest(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.manifest_query(spark, "")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in got.select(*names).collect())


@needs_tables
def test_manifest_query(spark, monkeypatch):
    docs = table(spark, FOLDER, "documents")
    assert run_manifest(spark, docs, monkeypatch) == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_many_sparse_repeated_and_null_ids(spark, monkeypatch):
    rng = np.random.default_rng(2)
    ids = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 700)] + list(range(-40, 620)) + [2**63 - 1, -(2**63)]
    rows = [(i, f"Text {i}", ["en", None, "", "é"][0 if k % 5 else k % 4], "S", k % 7) for k, i in enumerate(ids)]
    rows += [(5, f"Same id {k}", "en", None, None) for k in range(90)] + [(5, "Equal row", "en", None, None)] * 9
    rows += [(None, f"No id {k}", "en", "s", 1) for k in range(70)] + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    assert run_manifest(spark, docs, monkeypatch) == plain_manifest([dict(zip(docs.columns, r)) for r in rows])


@pytest.mark.parametrize("n", [0, 1, 8, 9, 512, 513])
def test_manifest_of_small_trees(spark, monkeypatch, n):
    rows = [(i, "Ab", "en", "s", 2) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit(1), "slot": F.lit("x"), "leaf": F.lit(2.0), "total": F.lit(0)})
    assert run_manifest(spark, docs, monkeypatch) == plain_manifest([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows])


def plain_split(points, first, shards):
    """Shard of every point (key, weight, x0, x1, ...) by sorting."""
    if shards == 1 or not points:
        return {p[0]: first for p in points}
    widths = [max(p[2][i] for p in points) - min(p[2][i] for p in points) for i in range(len(points[0][2]))]
    dim, half = widths.index(max(widths)), shards // 2
    place = lambda p: (p[2][dim] << 32) | p[3]
    want, below = sum(p[1] for p in points) * half / shards, 0
    for key in sorted({place(p) for p in points}):
        at = sum(p[1] for p in points if place(p) == key)
        if below + at >= want:
            cut = key if want - below >= below + at - want else key - 1
            break
        below += at
    left = plain_split([p for p in points if place(p) <= cut], first, half)
    return left | plain_split([p for p in points if place(p) > cut], first + half, shards - half)


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_points_are_split_at_weighted_medians(spark, shards):
    rng = np.random.default_rng(shards)
    xs = np.stack([rng.integers(0, 4, 300) * 9000, rng.integers(0, 65536, 300), np.minimum(65535, rng.pareto(1, 300) * 99)], axis=1).astype(int)
    weights, ties = rng.pareto(1.5, 300) * 100 + 1, rng.integers(0, 2**32, 300)
    points = [(i, int(weights[i]), [int(v) for v in xs[i]], int(ties[i])) for i in range(300)]
    points += [(300 + i, 7, [5, 5, 5], 9) for i in range(3)]
    frame = spark.createDataFrame([(k, w, t, *x) for k, w, x, t in points], "name long, weight long, tie long, x0 long, x1 long, x2 long")
    got = {r["name"]: r["shard"] for r in sharding.split_points(frame, 3, shards).collect()}
    assert got == plain_split(points, 0, shards)


@needs_tables
def test_sharding_query(spark):
    documents = {r["doc_id"]: r for r in table(spark, FOLDER, "documents").collect()}
    rows = queries.sharding_query(spark, FOLDER).collect()
    assert len(rows) == len(documents) and {r["law"] for r in rows} == {"bytes"}
    sizes, slots, group, bytes_ = Counter(), defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        text = documents[r["doc_id"]]["text"]
        assert r["size"] == len((text or "").encode()) + 1 and r["grown_shard"] is None
        assert r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        group[text].add(r["shard"])
        bytes_[text] += r["size"]
    target, largest = sum(sizes.values()) / 16, max(r["size"] for r in rows)
    assert set(sizes) == set(range(16)) and all(abs(s - target) <= 2 * largest for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    members = Counter(d["text"] for d in documents.values())
    bound = lambda t: bytes_[t] <= 0.02 * target and members[t] <= 0.02 * len(rows) / 16
    assert all(len(group[t]) == 1 for t in group if members[t] == 1 or bound(t))
    assert sorted(rows, key=lambda r: r["doc_id"]) == sorted(queries.sharding_query(spark, FOLDER).collect(), key=lambda r: r["doc_id"])


def test_sharding_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "en", "a", 0), (1, "x" * 60_000, "en", "b", 9), (1, "x", None, "b", -5), (2, "x", "de", None, 1)]
    rows += [(3, "again", "en", "a", 5)] * 40 + [(i, "copy " * 20, "en", f"s{i % 3}", 100) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"shard": F.lit(1), "node": F.lit("x"), "pieces": F.lit(2.0), "v0": F.lit(0)})
    got = sharding.shard(docs, shards=4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(r[1] or "") + 1) for r in rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    # The large group of copies is cut, so that a shard stays near its bytes.
    parts = Counter(r["shard"] for r in got if r["size"] == 101)
    assert max(parts.values()) < 500
    assert sharding.shard(docs.limit(0), shards=4).count() == 0
    assert {r["shard"] for r in sharding.shard(docs, target_bytes=60_000).collect()} == {0, 1}


def plain_collocations(docs, least, k=2000):
    import re

    count, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, 6):
                count[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in count.items():
        frequent = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        parts = {p[i:j] for p in frequent for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[p[i:j]] == f[p]}
        rows = []
        for p, a in frequent.items():
            if p not in parts:
                score, cut = min((1000 * a * total[lang] // (f[p[:c]] * f[p[c:]]), c) for c in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:k], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def as_rows(found):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())


# Without a sample everything is left to the border and the passes after it; with all it is closed at once.
@pytest.mark.parametrize("sample", [0.0, 0.3, 1.0])
def test_collocations_whatever_the_sample(spark, sample, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["the", "of", "New", "York", "big", "été", "a\x00b", "x", "y", "z"]
    texts = []
    for i in range(300):
        text = " ".join(str(w) + str(rng.choice(["", "", "", ",", ".\n", "\t", "  ", "!?"])) for w in rng.choice(words, int(rng.integers(0, 30))))
        texts.append((i, text + " one two three four five six" * int(rng.integers(0, 3)), str(rng.choice(["en", "de"]))))
    texts += [(7, "One two THREE four", "en")] * 5 + [(None, "of the of the of the of the", None), (None, None, "en"), (3, "", "de"), (4, " \t.", "xx")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "size": F.lit("s"), "phrase": F.lit(2)})
    monkeypatch.setattr(phrases, "STRIP", 2000)
    want = plain_collocations([(t, g) for _, t, g in texts], 4)
    assert as_rows(phrases.collocations(docs, least=4, sample=sample)) == want and len({len(w[2].split()) for w in want}) == 4
    assert as_rows(phrases.collocations(docs, least=4, k=3, sample=sample)) == plain_collocations([(t, g) for _, t, g in texts], 4, 3)
    assert phrases.collocations(docs.limit(0), least=4, sample=sample).count() == 0


def test_a_crowded_filter_changes_no_result(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e", "f"], 40)), "en") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    monkeypatch.setattr(phrases, "FEWEST_BITS", 64)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    assert as_rows(phrases.collocations(docs, least=8, sample=0.2)) == plain_collocations([(t, g) for _, t, g in texts], 8)


def test_ranking_in_rounds(spark, monkeypatch):
    rows = [("en" if i % 3 else "de", f"p{i:04}", i % 5 + 1, 1, 1, 1, (i * 37) % 101) for i in range(900)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    monkeypatch.setattr(phrases, "RANKED", 100)
    got = {(r["lang"], r["rank"]): r["phrase"] for r in phrases.best(frame, 7).collect()}
    for lang in ("en", "de"):
        order = sorted((-r[6], -r[2], r[1]) for r in rows if r[0] == lang)[:7]
        assert [got[lang, i + 1] for i in range(7)] == [x[2] for x in order]


def test_scores_beyond_64_bits(spark):
    big = 10**14
    found = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", 10**13), ("en", 1, "b", 10**13), ("en", 2, "a b", 9 * 10**12)], phrases.SCHEMA)
    row = phrases.scored(found).first()
    assert row["score"] == 1000 * 9 * 10**12 * big // 10**26
