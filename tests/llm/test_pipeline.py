"""Every stage of the pipeline against a plain version on what the stage before it kept."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import lines, mixing, queries, toxicity
from quillmark.llm.common import Stored
from quillmark.sources.tables import table

from .test_brute_force import FOLDER, least_reachable, plain_fingerprint, plain_targets

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs, found = table(spark, FOLDER, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = Stored(stage(spark, docs, FOLDER), f"tested-{name}").df
        found[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return found


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    assert all(stages[n][2] == NAMES for n in list(stages)[:4])


def plain_kind(model, window):
    """1, 2 or 0 for a window, from one compression with each dictionary."""
    data = toxicity.PRIMER + b" " + window + b" " + toxicity.TAIL

    def size(content):
        return len(toxicity._compressor(content).compress(data))

    gain = size(model.ordinary) - size(model.strong), size(model.ordinary) - size(model.weak)
    frame = len(toxicity._compressor(model.weak + model.strong).compress(toxicity.PRIMER + b" " + bytes(range(1, 6)) + b" " + toxicity.TAIL)) - 5
    shorter = len(window) + frame - size(model.weak + model.strong)
    if shorter < min(toxicity.STRONG[3], toxicity.WEAK[3]):
        return 0
    return 1 if gain[0] >= toxicity.STRONG[3] else 2 if gain[1] >= toxicity.WEAK[3] else 0


def test_toxicity(spark, stages):
    before, after, _ = stages["toxicity"]
    model = toxicity.train(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    kinds, score = {}, {}
    for d in before:
        found = (d["text"] or "").encode().lower().split()
        found = [w[i : i + 64] for w in found for i in range(0, len(w), 64)] if max(map(len, found), default=0) > 64 else found
        for w in set(found) - kinds.keys():
            kinds[w] = None
        score[d["doc_id"]] = found
    # Every window that the model calls a hit, and as many again, one at a time.
    opened = model.open()
    ours = dict(zip(kinds, opened.kinds(list(kinds))))
    tried = [w for w in kinds if ours[w]] + [w for w in kinds if not ours[w]][:400]
    assert {w: plain_kind(model, w) for w in tried} == {w: ours[w] for w in tried}
    want = Counter()
    for d in before:
        n = Counter(ours[w] for w in score[d["doc_id"]])
        value = model.levels[model.weigh(n[1], n[2], sum(n.values())) - toxicity.LEAST]
        if value < 0.3:
            want[d] += 1
    assert Counter(after) == want


def test_toxic_windows_one_at_a_time(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("the larger tables are not here")
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels")).open()
    windows = sorted({w for d in docs.select("text").collect() for w in toxicity._windows(d["text"])})
    ours = dict(zip(windows, model.kinds(windows)))
    hits = [w for w in windows if ours[w]]
    tried = hits[:: max(1, len(hits) // 150)] + [w for w in windows if not ours[w]][::500]
    assert len({ours[w] for w in tried}) > 1
    assert {w: plain_kind(model, w) for w in tried} == {w: ours[w] for w in tried}
    kept = corpus_pipeline.drop_toxic(spark, docs, folder).count()
    scores = [r["score"] for r in toxicity.scores(docs, model).collect()]
    assert kept == sum(s < 0.3 for s in scores) < len(scores)


def test_line_dedup(stages):
    before, after, _ = stages["line_dedup"]
    places, codes = [], {}
    for d in before:
        for i, line in enumerate((d["text"] or "").split("\n")):
            if line.split():
                places.append((d["doc_id"], i))
                codes[d["doc_id"], i] = lines.normal(line)
    sets = {p: {codes[p][i : i + 9] for i in range(max(1, len(codes[p]) - 8))} for p in places}
    holders, near = defaultdict(list), set()
    for p in places:
        for s in sets[p]:
            holders[s].append(p)
    for found in holders.values():
        near |= {(a, b) for a in found for b in found if a < b}
    near = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    first = least_reachable(sorted(places), near)
    want = Counter()
    for d in before:
        kept = [x for i, x in enumerate((d["text"] or "").split("\n")) if first.get((d["doc_id"], i), (d["doc_id"], i)) == (d["doc_id"], i)]
        want[d["doc_id"], None if d["text"] is None else "\n".join(kept), d["lang"], d["source"], d["n_chars"]] += 1
    assert Counter(map(tuple, after)) == want


def test_simhash_near_dedup(stages):
    before, after, _ = stages["simhash_near_dedup"]
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in before}
    ids = sorted(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    root = least_reachable(ids, near)
    assert Counter(after) == Counter(d for d in before if root[d["doc_id"]] == d["doc_id"])


def test_mixing(spark, stages):
    before, after, _ = stages["mixing"]
    sizes, taken, size = defaultdict(int), Counter(), {}
    for d in before:
        size[d["doc_id"]] = len((d["text"] or "").encode().split())
        sizes[d["source"]] += size[d["doc_id"]]
    for d in after:
        taken[d["source"]] += size[d["doc_id"]]
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    want = plain_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= max(size.values()) for s in sizes)
    docs = spark.createDataFrame(before, ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in NAMES))
    assert Counter(mixing.mixture(docs).collect()) == Counter(after)


def test_bpe(stages):
    from tokenizers import Tokenizer

    before, after, _ = stages["bpe"]
    own = Tokenizer.from_file(queries.vocabulary_path())
    want = Counter()
    for d in before:
        ids = own.encode(d["text"] or "", add_special_tokens=False).ids
        same = own.decode(ids, skip_special_tokens=False) == (d["text"] or "")
        want[d["doc_id"], d["source"], len(ids), tuple(ids), same] += 1
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"]), r["round_trip"]) for r in after) == want


def test_mixture_is_dealt_over_the_levels_of_the_tree(spark):
    docs = table(spark, FOLDER, "documents")
    for words, least in ((40_000, 2), (5_000, 8)):
        shards = Counter()
        for r in mixing.plan(docs, shard_words=words).select("_mix.size", F.col("_mix.copies.shard").alias("s")).collect():
            for s in r["s"]:
                shards[s] += 1
        assert len(shards) >= least and max(shards.values()) <= 3 * min(shards.values()) + 200
