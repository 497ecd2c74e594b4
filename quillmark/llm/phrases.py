"""Phrase collocations by Toivonen's mining: a sample proposes, a full pass counts, failures expand.

Phrases are runs of words within a piece of text. A sample of the documents, mined at a lowered
threshold, gives the phrases that are likely frequent. A pass over all documents counts these and
their negative border exactly: a phrase is counted if it lacks nothing but itself, that is if what
it is without its last and without its first word are both in the proposal. Border phrases that turn
out frequent were missed by the sample; then further passes count all that can still be frequent,
until no count is missing. Tasks count within a strip of text and Spark adds up the strips.

Which phrases were proposed or frequent is known to tasks by a Bloom filter of bounded size. A false
answer makes a task count a phrase needlessly and changes no result, as the same filters decide in
every pass what has been counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Stored, slices

#: Words of the longest phrase, occurrences of a frequent one, phrases returned of each language.
LONGEST, LEAST, BEST = 5, 100, 2000
#: Share of the documents in the sample, and of a phrase's expected count there that proposes it.
SAMPLE, LOWERED = 0.1, 0.8
#: Bytes of text that a task counts at a time, and rows it takes from a batch at a time.
STRIP, ROWS = 3 << 20, 256
#: Bits for each phrase in a filter, its bits at least and at most, and probes.
PER_PHRASE, FEWEST_BITS, MOST_BITS, PROBES = 16, 1 << 16, 1 << 28, 4
#: Rows that are ranked in one task before the last ranking.
RANKED = 100_000

#: Fixed values of the word rule: A-Z lower-cased, pieces end at these marks, blanks part words.
ENDS = b".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: A byte that no UTF-8 text holds marks an end.
END = b"\xff"
LETTERS = bytes.maketrans(UPPER + ENDS + b"\t", LOWER + b"\n" * len(ENDS) + b" ")
SCHEMA = "lang string, size int, phrase string, n long"
#: Between a language and a phrase in the key of a count; no word holds it.
BETWEEN = "\t"


@dataclass
class Filters:
    """What the tasks of a pass know: the proposal, the frequent phrases, and which pass it is.

    ``kind``: ``words`` counts single words and pairs, ``rest`` what is longer and may be frequent,
    ``border`` the proposal and its negative border, ``expand`` what the border pass left out.
    """

    kind: str
    proposed: Broadcast | None = None
    frequent: Broadcast | None = None
    sizes: tuple[int, ...] = field(default_factory=lambda: tuple(range(1, LONGEST + 1)))


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts in a row, an end mark between pieces."""
    return b"\n".join(texts).translate(LETTERS).replace(b"\n", b" " + END + b" ").split(b" ")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _word_codes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed=seed) for w in words), np.uint64, len(words))


def _probes(codes: np.ndarray, bits: int) -> np.ndarray:
    step = (codes >> np.uint64(17)) | np.uint64(1)
    return np.stack([(codes + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)])


def contains(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether phrases may be in the filter, a bitmap of bytes."""
    out = np.ones(len(codes), bool)
    for at in _probes(codes, len(bitmap) * 8):
        out &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def count_strip(texts: list[bytes], lang: str, filters: Filters) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(keys, counts) of the phrases that this pass counts, size by size; the bare language has all words.

    Distinct phrases of a strip have dense numbers, made from the number of what they are without
    their last word and that word, so that counting is exact.
    """
    proposed = filters.proposed.value if filters.proposed else None
    frequent = filters.frequent.value if filters.frequent else None
    flat = [w for w in tokens(texts) if w]
    index = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    names = list(index)
    word = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    code_of = _word_codes(names, lang)
    prefix = (lang + BETWEEN).encode("utf-8", "replace")
    place = np.flatnonzero(word != index.get(END, -1))
    inside = np.zeros(len(word) + LONGEST, bool)
    inside[place] = True
    if filters.kind in ("words", "border"):
        yield [prefix], np.array([len(place)])
    # Of the phrase of the present size that begins at a place: its number, and whether longer ones may count.
    number, may = np.zeros(len(word), np.int64), np.zeros(len(word) + LONGEST, bool)
    codes = np.zeros(0, np.uint64)
    # Places whose phrase has been decided by the border pass, and is proposed.
    was = np.zeros(len(word) + LONGEST, bool)
    for size in range(1, LONGEST + 1):
        if size == 1:
            key = word[place]
        else:
            place = place[may[place] & may[place + 1] & inside[place + size - 1]]
            key = number[place] * len(names) + word[place + size - 1]
        if not len(place):
            return
        at, found = pd.factorize(key)
        times = np.bincount(at, minlength=len(found))
        first = np.empty(len(found), np.int64)
        first[at[::-1]] = np.arange(len(at) - 1, -1, -1)
        start = place[first]
        own = code_of[word[start]] if size == 1 else _mix(codes[number[start]], code_of[word[start + size - 1]])
        new = np.ones(len(start), bool)
        if filters.kind == "words":
            goes = new
        elif filters.kind == "rest":
            new &= size > 2
            goes = new | contains(frequent, own)
        elif filters.kind == "border":
            goes = contains(proposed, own)
        else:
            # Counted before, by the rule of the border pass: both parts were proposed.
            before = np.ones(len(start), bool) if size == 1 else was[start] & was[start + 1]
            new = ~before
            goes = new | contains(frequent, own)
            kept = contains(proposed, own) & before
            fresh = np.zeros_like(was)
            fresh[place] = kept[at]
            was = fresh
        if size in filters.sizes and new.any():
            some = start[new].tolist()
            yield [prefix + b" ".join(flat[p : p + size]) for p in some], times[new]
        number = np.zeros(len(word), np.int64)
        number[place] = at
        may = np.zeros(len(word) + LONGEST, bool)
        may[place] = goes[at]
        codes = own


def _strips(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language at a time, up to about STRIP bytes; no text is cut."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in slices(batches, ROWS):
        langs = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for lang, text in zip(langs, texts):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= STRIP:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def counts(docs: DataFrame, filters: Filters) -> DataFrame:
    """(lang, size, phrase, n): what a pass counts, added up over all documents (lang, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _strips(batches):
            for keys, n in count_strip(texts, lang, filters):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], ["key", "n"])

    # One string and one number a row is what is shuffled.
    each = docs.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    phrase = F.substring_index("key", BETWEEN, -1)
    size = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1)
    lang = F.substring(F.col("key"), F.lit(1), F.length("key") - F.length(phrase) - 1)
    return each.select(lang.alias("lang"), size.cast("int").alias("size"), phrase.alias("phrase"), "n")


def bloom(phrases: DataFrame) -> np.ndarray:
    """Filter over (lang, phrase), as bytes: 16 bits a phrase, 32 MB at most.

    Tasks turn phrases to bits, and Spark joins the bits of each 64-bit word; the driver gets the
    words that are not zero, which the size of the filter bounds.
    """
    n = phrases.count()
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (n * PER_PHRASE - 1).bit_length())) if n else FEWEST_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_phrase_code(p, lang) for lang, p in zip(*(batch.column(i).to_pylist() for i in range(2)))]
            at = np.unique(_probes(np.array(codes, np.uint64), bits).ravel()) if codes else np.empty(0, np.uint64)
            value = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(value)], ["word", "bits"])

    words = phrases.select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _phrase_code(phrase: str, lang: str) -> int:
    codes = _word_codes([w for w in phrase.encode("utf-8", "replace").split(b" ")], lang)
    code = codes[:1]
    for i in range(1, len(codes)):
        code = _mix(code, codes[i : i + 1])
    return int(code[0])


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, sample: float = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(lang, size, phrase, n): all phrases that occur ``least`` times or more, exactly counted.

    Size 0, with an empty phrase, has the number of all words of a language. The sample is a share
    of the rows, chosen by the hash of id and text; it decides how many passes are needed, never
    what they find. Null languages are ``und``; null and empty texts have no words. Repeated rows
    count as often as they occur, texts of any length are counted whole, and phrases do not cross
    documents. Other columns are not looked at; an empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    table = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("draw"))
    part = table.where(F.pmod("draw", F.lit(10_000)) < int(sample * 10_000)).select("lang", "text")
    table = table.select("lang", "text")
    lowered = max(2, int(least * sample * LOWERED))
    short = Stored(counts(part, Filters("words", sizes=(1, 2))).where((F.col("n") >= lowered) & (F.col("size") > 0)), "sample-pairs")
    likely = context.broadcast(bloom(short.df))
    long = Stored(counts(part, Filters("rest", frequent=likely)).where(F.col("n") >= lowered), "sample-phrases")
    proposal = short.df.unionAll(long.df)
    proposed = context.broadcast(bloom(proposal))
    kept = (F.col("n") >= least) | (F.col("size") == 0)
    found = Stored(counts(table, Filters("border", proposed=proposed)).where(kept), "border-counts").df
    failed = found.where((F.col("size") > 0) & (F.col("size") < LONGEST)).join(proposal.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    if failed.limit(1).count():
        # A phrase that this pass leaves out holds one that is known to be rare: nothing is open after it.
        known = context.broadcast(bloom(found.where("size > 0")))
        further = Stored(counts(table, Filters("expand", proposed=proposed, frequent=known)).where(kept), "expanded-counts").df
        found = found.unionAll(further)
        known.unpersist()
    for table_ in (short, long):
        table_.drop()
    likely.unpersist()
    proposed.unpersist()
    return found


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words or more, by their weakest cut.

    The score of a cut is floor(1000 a n / (l r)), in decimals of 38 digits.
    """
    totals = found.where("size = 0").select("lang", F.col("n").alias("total"))
    known = found.where("size > 0").select("lang", "phrase", "n")
    cuts = found.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    left = F.expr("substring_index(phrase, ' ', k)")
    cuts = cuts.withColumn("left", left).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    score = F.expr(
        "(cast(1000 * cast(a AS decimal(18,0)) AS decimal(22,0)) * cast(total AS decimal(15,0)))"
        " div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))"
    )
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r", F.col("total").alias("n"))).alias("w")
    return cuts.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "w.l", "w.r", "w.n", "w.score")


def without_parts(found: DataFrame) -> DataFrame:
    """Phrases of two words or more that no longer phrase holds as often as they occur.

    A phrase that is held by a longer one as often is held so by one that is longer by one word.
    """
    longer = found.where("size > 2")
    ends = longer.select("lang", "n", F.explode(F.expr(
        "array(substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1),"
        " substring(phrase, length(substring_index(phrase, ' ', 1)) + 2))"
    )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("held"))
    return found.where("size > 1").join(ends, ["lang", "phrase"], "left").where("held IS NULL OR held < n").drop("held")


def best(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each language, ranked; rounds over hash parts leave no large group."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    n = rows.count()
    while n > max(RANKED, 2 * k):
        parts = n // RANKED + 1
        inside = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = Stored(rows.withColumn("_rank", F.row_number().over(inside)).where(F.col("_rank") <= k).drop("_rank"), "ranked-phrases").df
        n, before = rows.count(), n
        if n == before:
            break
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def collocations(docs: DataFrame, least: int = LEAST, k: int = BEST, sample: float = SAMPLE, **columns) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to five words.

    Phrases that a longer one holds as often are left out. Ties in the score go to the more
    frequent phrase, then to the lesser by its bytes. Rows are treated as in ``frequent_phrases``.
    """
    found = frequent_phrases(docs, least, sample, **columns)
    rows = scored(found).join(without_parts(found).select("lang", "phrase"), ["lang", "phrase"], "left_semi")
    rows = Stored(rows, "scored-phrases").df
    return best(rows, k).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
