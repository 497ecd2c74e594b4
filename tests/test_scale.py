"""Operators that must give whole results however rows are spread over keys."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quillmark.operators import dialogue, lexical, rollup, sampling, scale, sets
from quillmark.plans import prose
from quillmark.sources.tables import spread


def md5(seed, *ids):
    return hashlib.md5(":".join([str(seed), *map(str, ids)]).encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows; one key owns a third of them."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(3000)]
    return spark.createDataFrame(rows, "id long, key string"), rows


def test_number_rows(skewed):
    frame, rows = skewed
    got = scale.number_rows(frame, ["key"], [F.col("id")], F.floor(F.col("id") / 100)).collect()
    want, seen = {}, {}
    for i, k in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert {r["id"]: r["rn"] for r in got} == want


def test_number_rows_keeps_null_groups(spark):
    frame = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, key string")
    got = scale.number_rows(frame, ["key"], [F.col("id")], F.col("id"))
    assert sorted((r["id"], r["rn"]) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("quota", [7, 400, 5_000, 100_000])
def test_quotas_of_a_hot_group(skewed, quota):
    frame, rows = skewed
    groups = {}
    for i, k in rows:
        groups.setdefault(k, []).append((md5(5, i), i))
    want = {i for members in groups.values() for _, i in sorted(members)[:quota]}
    drawn = sampling.sample_groups(frame, ["key"], "id", quota, 5)
    assert {r["id"] for r in drawn.collect()} == want


@pytest.mark.parametrize("ranked", [1, 20, 100_000])
def test_cuts_are_refined_to_any_depth(spark, skewed, monkeypatch, ranked):
    frame, rows = skewed
    monkeypatch.setattr(scale, "RANKED", ranked)
    monkeypatch.setattr(scale.cut_points, "__defaults__", (ranked,))
    odd = frame.unionByName(spark.createDataFrame([(7, None), (8, None), (7, None), (-5, None), (-(2**63), "hot")], "id long, key string"))
    got = sorted(((r["key"] or "", r["id"]) for r in sampling.take_per_group(odd, "key", "id", 3).collect()))
    groups = {}
    for i, k in [*rows, (7, None), (8, None), (7, None), (-5, None), (-(2**63), "hot")]:
        groups.setdefault(k or "", []).append(i)
    assert got == sorted((k, i) for k, ids in groups.items() for i in sorted(ids)[:3])
    assert sampling.take_per_group(odd, "key", "id", 0).count() == 0
    assert sampling.sample_groups(odd, ["key"], "id", 3, 1).count() == 3 * len(groups)


@pytest.mark.parametrize("by", [None, ["key"]])
def test_split_is_exact(skewed, by):
    frame, rows = skewed
    got = {r["id"]: r["split"] for r in sampling.split(frame, "id", 0.2, 9, by).collect()}
    groups = {}
    for i, k in rows:
        groups.setdefault(k if by else None, []).append((md5(9, i), i))
    want = {}
    for members in groups.values():
        quota = math.ceil(round(len(members) * 0.2, 6))
        for rank, (_, i) in enumerate(sorted(members)):
            want[i] = "test" if rank < quota else "train"
    assert got == want


def test_shuffle_ignores_partitioning(skewed):
    frame, _ = skewed
    orders = [[r["id"] for r in sampling.shuffled(frame.repartition(n), 3, "id").collect()] for n in (1, 7)]
    assert orders[0] == orders[1] != sorted(orders[0])


def test_lookup_join_paths_agree(spark, skewed, monkeypatch):
    frame, rows = skewed
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    want = sorted((i, {"hot": 1, "k1": 2}.get(k)) for i, k in rows)
    for bound in (scale.BROADCAST_BYTES, -1):
        monkeypatch.setattr(scale, "BROADCAST_BYTES", bound)
        got = scale.lookup_join(frame, lookup, ["key"])
        assert sorted((r["id"], r["v"]) for r in got.collect()) == want


def test_lemmas_of_rows_with_odd_ids(spark):
    rows = [(1, "Cats chase a cat. Dogs was dogs!"), (1, "One dog, two dogs; cat?"), (None, "Dogs was cats."), (None, "Two cats!"), (1, ""), (1, ""), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = prose.lemmatised(docs, F.lit("LLM"))
    assert got.count() == len(rows)
    lemmas = {(r["doc_id"], r["text"]): r["lemmas"] for r in got.collect()}
    assert lemmas[1, rows[0][1]] == [["Cats", "chase", "a", "cat", "."], ["Dogs", "be", "dog", "!"]]
    assert lemmas[None, "Two cats!"] == [["Two", "cat", "!"]] and lemmas[1, ""] == lemmas[2, ""] == []
    # A vocabulary of one's own decides what may be a lemma.
    own = spark.createDataFrame([("Dog",), ("Dog",)], "word string")
    served = {(r["doc_id"], r["text"]): r["lemmas"] for r in prose.lemmatised(docs, F.lit("LLM"), vocabulary=own).collect()}
    assert served[1, rows[0][1]] == [["Cats", "chase", "a", "cat", "."], ["Dog", "be", "dogs", "!"]]


def test_joined_text_is_one_row_per_key(spark):
    rows = [("a", i * 20_000, f"w{i}") for i in range(25)] + [("b", 0, "x")]
    frame = spark.createDataFrame(rows, "k string, p int, w string")
    got = scale.joined_text(frame, ["k"], "p", F.col("w"), " ").orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", " ".join(f"w{i}" for i in range(25)), 25), ("b", "x", 1)]


def test_positional_zip_stops_at_the_shorter(spark):
    left = spark.createDataFrame([(i * 10,) for i in range(50)], "a long")
    right = spark.createDataFrame([(i,) for i in range(7)], "b long")
    got = sets.positional_zip(left, "a", scale.range_bucket(left, "a", 4), right, "b", scale.range_bucket(right, "b", 4))
    assert sorted((r["position"], r["a"], r["b"]) for r in got.collect()) == [(i + 1, i * 10, i) for i in range(7)]


def test_concat(spark):
    a = spark.createDataFrame([(1, "x")], "id long, t string")
    b = spark.createDataFrame([(2, 3.0)], "id long, v double")
    assert sets.concat_by_name([a, b]).columns == ["id", "t", "v"]
    with pytest.raises(ValueError):
        sets.concat_by_position([a, a.select("id")])


def test_balance_and_augment(spark):
    machine = spark.createDataFrame([(f"m{i}", "t") for i in range(90)], "doc_id string, text string")
    human = spark.createDataFrame([(f"h{i}", "t", f"s{i % 3}") for i in range(120)], "doc_id string, text string, source string")
    pair = sampling.balanced_pair(machine, human, "source", "doc_id", 1)
    assert {(r["label"], r["source"]): r["count"] for r in pair.groupBy("label", "source").count().collect()} == {
        ("LLM", None): 90, ("HUMAN", "s0"): 30, ("HUMAN", "s1"): 30, ("HUMAN", "s2"): 30,
    }
    few = sampling.balanced_pair(machine.limit(10), human, "source", "doc_id", 1)
    assert few.where("label = 'HUMAN'").count() == 30
    start = human.where("doc_id < 'h2'")
    more = sampling.augment(start, human, "source", "doc_id", 12, 1)
    assert more.count() == start.count() + 12 and more.select("doc_id").distinct().count() == more.count()


def sentences(spark, n=23):
    rows = [(1, "LLM", i, f"s{i}", ["T", "U"], ["l"], float(i), i % 2 == 0, None if i < 2 else 0.5) for i in range(n)]
    rows += [(2, "HUMAN", 0, "only", ["V"], ["m"], None, True, 0.25), (None, "LLM", 0, "lost", [], [], 9.0, True, 0.1)]
    schema = (
        "doc_id long, label string, sent_id long, sentence string, pos array<string>, lemmas array<string>, "
        "depth double, balanced boolean, document_ttr double"
    )
    return spark.createDataFrame(rows, schema)


def test_rollups(spark):
    frame = sentences(spark)
    got = rollup.rollup_mean(frame, ["doc_id", "label"], ["depth", "balanced"]).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2]
    first = next(r for r in got if r["doc_id"] == 1)
    assert first["sentence"] == " ".join(f"s{i}" for i in range(23))
    assert (first["depth"], first["balanced"], first["n_sentences"]) == (11.0, 12 / 23, 23)
    second = next(r for r in got if r["doc_id"] == 2)
    assert second["depth"] is None and second["pos"] == "V"
    summed = rollup.rollup_sum(frame, ["doc_id"], ["depth"]).where("doc_id = 1").first()
    assert (summed["document_ttr"], summed["balanced"]) == (0.5, 12.0)


def test_global_rollup_and_matrix(spark):
    row = rollup.rollup_all(sentences(spark), ["depth", "head"]).first()
    assert row["head"] == 0.0 and row["n_sentences"] == 25
    frame = spark.createDataFrame([(1, 0.99, 2.5), (2, 1.0, 0.5)], "doc_id long, balanced double, depth double")
    assert [r["balanced"] for r in rollup.metric_matrix(frame, ["depth", "balanced"]).orderBy("doc_id").collect()] == [0, 1]
    kept = rollup.metric_matrix(frame, ["balanced"], keep_balance=True)
    assert kept.orderBy("doc_id").first()["balanced"] == 0.99


def test_turn_pairs_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "TURNS_PER_BUCKET", 8)
    roles = ["user", "assistant", "user", "user", "assistant", "assistant", "system"]
    rows = [(1, i * 2, roles[i % 7], f"t{i}") for i in range(70)] + [(2, 0, "user", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = [(1, i * 2, f"t{i}", f"t{i + 1}") for i in range(69) if roles[i % 7] == "user" and roles[(i + 1) % 7] == "assistant"]
    assert sorted(map(tuple, dialogue.turn_pairs(turns).collect())) == want


def test_conversation_log(spark):
    rows = [(1, 1, "user", None), (1, 0, "assistant", "x"), (1, 2, None, "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in dialogue.conversation_log(turns).collect()] == [(1, 0, "Assistant", "x"), (1, 1, "User", "")]
    assert [r["content"] for r in dialogue.conversation_log(turns, capitalise=False).collect()] == ["x", None]


def test_term_frequency_totals(spark):
    frame = spark.createDataFrame([(1, "a1 b1 a1 c1 the"), (2, "the")], "doc_id long, text string")
    rows = lexical.term_frequency(frame, ["doc_id"], "text").collect()
    assert sorted((r["term"], r["cnt"], r["n"]) for r in rows) == [("a1", 2, 4), ("b1", 1, 4), ("c1", 1, 4)]


def test_spread_deals_few_splits_to_several_tasks_a_slot(spark):
    """Nine splits on eight slots would be two rounds, the second with one task; rows stay the same."""
    slots = spark.sparkContext.defaultParallelism
    dealt = spread(spark.range(0, 100 * (slots + 1), numPartitions=slots + 1), "id")
    assert dealt.rdd.getNumPartitions() == 4 * slots
    assert sorted(r["id"] for r in dealt.collect()) == list(range(100 * (slots + 1)))


def test_spread_deals_a_file_of_one_row_group(spark, tmp_path):
    """Its splits are as many as the slots, but one of them holds all rows."""
    path = str(tmp_path / "one")
    rows = [(i, hashlib.md5(str(i).encode()).hexdigest() * 200) for i in range(6000)]
    frame = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    frame.write.option("parquet.block.size", 1 << 30).option("compression", "uncompressed").option("parquet.enable.dictionary", False).parquet(path)
    read = spark.read.parquet(path)
    slots = spark.sparkContext.defaultParallelism
    assert read.rdd.getNumPartitions() >= slots

    def largest(df):
        return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

    assert largest(read) == 6000
    dealt = spread(read, "id")
    assert largest(dealt) <= 2 * 6000 / slots and dealt.count() == 6000
    assert spread(dealt, "id") is dealt
