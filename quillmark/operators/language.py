"""Language of a source by naive Bayes over its pieces, with counts as the whole model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import patterns as P

#: Numbers that pieces are hashed to, by the first four digits of their md5.
PIECES = 1 << 16
#: Logarithms are whole millionths, so that their sums do not depend on their order.
UNIT = 1_000_000


def _numbers(source: Column) -> Column:
    found = F.regexp_extract_all(source, F.lit(P.CODE_TOKEN), F.lit(0))
    return F.transform(found, lambda p: F.conv(F.substring(F.md5(p), 1, 4), 16, 10).cast("int"))


def _log(x: Column) -> Column:
    return F.round(F.lit(UNIT) * F.log(x)).cast("long")


def train(df: DataFrame, source: Column, label: Column) -> DataFrame:
    """(label, prior, unseen, weights): a row per label; ``weights`` is what a piece adds to ``unseen``.

    Add-one smoothing over 65536 piece numbers, which bound the model per label. Pieces are counted
    in one aggregation with partial sums; null labels and sources are left out.
    """
    rows = df.select(label.alias("label"), source.alias("_src")).where("label is not null and _src is not null")
    pieces = rows.select("label", F.explode(_numbers(F.col("_src"))).alias("piece"))
    counts = pieces.groupBy("label", "piece").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.groupBy("label").agg(F.sum("n").alias("total"), F.collect_list(F.struct("piece", "n")).alias("_c"))
    n_rows = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).join(seen, "label", "left")
    whole = rows.agg(F.count(F.lit(1)).alias("all")).scalar()
    total = F.coalesce("total", F.lit(0)) + PIECES
    unseen = _log(1 / total)
    weights = F.transform(
        F.coalesce("_c", F.array().cast("array<struct<piece:int,n:bigint>>")),
        lambda c: F.struct(c["piece"].alias("piece"), (_log((c["n"] + 1) / total) - unseen).alias("w")),
    )
    return n_rows.select("label", _log(F.col("rows") / whole).alias("prior"), unseen.alias("unseen"), weights.alias("weights"))


def detect(df: DataFrame, keys: list[str], source: Column, model: DataFrame) -> DataFrame:
    """(keys, detected, score): the likeliest label of every source; ties go to the greater name.

    Pieces of a source are counted in its row and joined with the weights, one row per piece number.
    A source without pieces gets the most frequent label, and so does a null one.
    """
    counts = df.select(*keys, F.explode(_numbers(source)).alias("piece")).groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("c"))
    each = model.select("label", F.explode("weights").alias("x")).select("label", "x.piece", "x.w")
    # At most 65536 rows, with an entry for each label.
    by_piece = each.groupBy("piece").agg(F.collect_list(F.struct("label", "w")).alias("ws"))
    added = (
        counts.join(F.broadcast(by_piece), "piece")
        .select(*keys, "c", F.inline("ws"))
        .groupBy(*keys, "label")
        .agg(F.sum(F.col("c") * F.col("w")).alias("s"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "s"))).alias("_s"))
    )
    labels = model.agg(F.collect_list(F.struct("label", "prior", "unseen")).alias("_l")).scalar()
    size = F.coalesce(F.size(_numbers(source)), F.lit(0))
    rows = df.select(*keys, size.alias("_n")).join(added, keys, "left").withColumn("_l", labels)
    scores = F.transform("_l", lambda m: F.struct(
        (m["prior"] + F.greatest("_n", F.lit(0)) * m["unseen"] + F.coalesce(F.try_element_at("_s", m["label"]), F.lit(0))).alias("score"),
        m["label"].alias("detected"),
    ))
    best = F.array_max(scores)
    return rows.select(*keys, best["detected"].alias("detected"), best["score"].cast("long").alias("score"))
