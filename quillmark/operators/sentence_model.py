"""Sentence split that learns its abbreviations and sentence starters from the texts themselves.

A full stop after a word that nearly always has one belongs to the word. How strongly the counts say
so is a log-likelihood ratio, lowered for long words and for those that are often seen without the
stop. A word that follows stops more often than chance explains starts sentences; after an
abbreviation only such a word, written with a capital, begins a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import arrays as A
from quillmark.functions import text as T

#: Fixed values of the published method: share of stops after an abbreviation, least score of one, and
#: least ratio of a sentence starter.
STOPPED, ABBREVIATION, STARTER = 0.99, 0.3, 30.0
#: Marks that may close a sentence after its end, and those that may open a word.
CLOSING, OPENING = "[\"”’')\\]]*", "^[\"“‘'(\\[]+"
END = "[.?!]" + CLOSING + "$"


def plain(word: Column) -> Column:
    """A word as it is counted: lower case, without marks around it and without its stop."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), OPENING, ""), "[.?!,;:]*" + CLOSING + "$", "")


def _stopped(word: Column) -> Column:
    return word.rlike("\\." + CLOSING + "$")


def _log_share(n: Column, of: Column, p: Column) -> Column:
    """Logarithm of the likelihood of n hits in a number of draws; 0 log 0 is 0."""
    part = lambda k, q: F.when(k == 0, F.lit(0.0)).otherwise(k * F.log(q))
    return part(n, p) + part(of - n, 1 - p)


def _words(df: DataFrame, text: str) -> DataFrame:
    """(word, before): the words of texts, each with the one before it."""
    each = df.select(T.words(F.coalesce(text, F.lit(""))).alias("_w")).select("_w", F.posexplode("_w").alias("_i", "word"))
    return each.select("word", F.get("_w", F.col("_i") - 1).alias("before"))


def train(df: DataFrame, text: str = "text") -> DataFrame:
    """(type, kind, score): kind ``abbreviation`` or ``starter``, from one aggregation over the words.

    Words are counted by what ``plain`` makes of them, with partial sums; only words with a letter take
    part. Null and empty texts have no words.
    """
    kind = plain(F.col("word"))
    counted = _words(df, text).select(
        kind.alias("type"), _stopped(F.col("word")).alias("stop"),
        F.coalesce(F.col("before").rlike(END), F.lit(False)).alias("starts"),
    )
    types = counted.where(F.col("type").rlike("\\p{L}")).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("stop").alias("stops"), F.count_if("starts").alias("starts")
    )
    # Types are read once more for the totals over them.
    total = types.agg(F.sum("n").alias("n_all"), F.sum("stops").alias("stops_all"), F.sum("starts").alias("starts_all"))
    each = types.withColumns({c: total.select(c).scalar() for c in total.columns})
    bare = F.length(F.regexp_replace("type", "\\.", ""))
    chance = F.col("stops_all") / F.col("n_all")
    ratio = 2 * (_log_share(F.col("stops"), F.col("n"), F.lit(STOPPED)) - _log_share(F.col("stops"), F.col("n"), chance))
    score = ratio * F.exp(-bare) * (F.length("type") - bare + 1) * F.pow(bare.cast("double"), -(F.col("n") - F.col("stops")).cast("double"))
    n, k, after, every = F.col("n"), F.col("starts"), F.col("starts_all"), F.col("n_all")
    inside, outside = k / after, (n - k) / (every - after)
    share = n / every
    tied = 2 * (_log_share(k, after, inside) + _log_share(n - k, every - after, outside) - _log_share(k, after, share) - _log_share(n - k, every - after, share))
    starter = F.when((after > 0) & (every > after) & (inside > outside), tied).otherwise(F.lit(0.0))
    kinds = F.array(
        F.when((F.col("stops") > 0) & (score >= ABBREVIATION), F.struct(F.lit("abbreviation").alias("kind"), score.alias("score"))),
        F.when(starter >= STARTER, F.struct(F.lit("starter").alias("kind"), starter.alias("score"))),
    )
    return each.select("type", F.explode(kinds).alias("k")).where("k is not null").select("type", "k.kind", "k.score")


def split(df: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, sentences): the words of each text, joined by single blanks, sentence by sentence.

    Only words before a possible break are looked up, with what follows; the breaks come back to the
    text by a key of id and text, so ids may be null or repeated. Null and empty texts have none.
    """
    keys = ["_k1", "_k2"]
    rows = df.select(
        "doc_id", F.coalesce(text, F.lit("")).alias("_t"), F.xxhash64("doc_id", text).alias("_k1"), F.xxhash64(F.lit(1), text, "doc_id").alias("_k2")
    )
    words = rows.select(*keys, T.words(F.col("_t")).alias("_w"))
    ends = words.select(*keys, "_w", F.posexplode("_w").alias("at", "word")).select(
        *keys, "at", plain(F.col("word")).alias("type"), _stopped(F.col("word")).alias("stop"),
        F.col("word").rlike(END).alias("ends"), F.get("_w", F.col("at") + 1).alias("next"),
    ).where(F.col("ends") & F.col("next").isNotNull())
    of = lambda kind, name: model.where(F.col("kind") == kind).select(F.col("type").alias(name), F.lit(True).alias(f"_{name}"))
    stopped = ends.where("stop").join(of("abbreviation", "type"), "type").withColumn("starts", plain(F.col("next")))
    bare = F.regexp_replace("next", OPENING, "")
    capital = F.substring(bare, 1, 1) != F.lower(F.substring(bare, 1, 1))
    joined = stopped.withColumn("capital", capital).join(of("starter", "starts"), "starts", "left")
    # These places are no breaks.
    held = joined.where(~(F.coalesce("_starts", F.lit(False)) & F.col("capital")))
    by_row = held.groupBy(*keys).agg(F.collect_set("at").alias("_held"))
    whole = rows.join(by_row, keys, "left")

    def breaks(w: Column) -> Column:
        last = F.size(w) - 1
        held = lambda i: F.coalesce(F.array_contains("_held", i), F.lit(False))
        return F.filter(F.transform(w, lambda x, i: F.when((i == last) | (x.rlike(END) & ~held(i)), i)), lambda i: i.isNotNull())

    def sentences(w: Column) -> Column:
        def cut(b: Column) -> Column:
            before = lambda j: F.coalesce(F.get(b, j - 1), F.lit(-1))
            return F.transform(b, lambda at, j: F.array_join(F.slice(w, before(j) + 2, at - before(j)), " "))

        return A.let(breaks(w), cut)

    return whole.select("doc_id", A.let(T.words(F.col("_t")), sentences).alias("sentences"))
