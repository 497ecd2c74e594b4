"""K-d tree sharding: weighted medians along the widest metadata dimension, level by level.

Points are groups of documents with equal texts, placed by their metadata and weighing their bytes;
a group too heavy for an even split is a few points. Every level splits all its nodes in the same
jobs: extents by aggregation, then the cut by a radix search, which sums weights by the leading bits
of the key and looks again only inside the bin where the median lies. The driver holds one row per
node; points are never sorted, nor collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmark.llm.common import Stored

#: Bits of a coordinate; a key is a coordinate and 32 bits that order points of the same one.
COORDINATE, TIE, DIGIT = 16, 32, 16
#: A group beyond this share of a shard's bytes or rows is split: at most 100 such pieces per shard.
SHARE = 0.02
#: Rows of a shard that are numbered in one task.
NUMBERED = 1000


@dataclass
class Node:
    """A box of the tree: its first shard, and the number of shards it is to become."""

    first: int
    shards: int
    split: int = -1
    want: float = 0.0
    prefix: int = 0
    below: int = 0
    at: int = 0


def _numbers(column: Column, text: bool) -> Column:
    """A dimension's value: names by their hash, numbers by the logarithm of their size; null stays."""
    if text:
        return F.when(column.isNotNull(), F.pmod(F.xxhash64(column), F.lit(1 << COORDINATE)).cast("double"))
    size = F.log1p(F.abs(column.cast("double")))
    return F.when(column < 0, -size).otherwise(size)


def _rows(docs: DataFrame, doc_id: str, text: str, dimensions: list[str]) -> DataFrame:
    text_bytes = F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
    kinds = {f.name: isinstance(f.dataType, StringType) for f in docs.schema.fields}
    return docs.select(
        F.col(doc_id).alias("doc_id"), (text_bytes + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        *[_numbers(F.col(c), kinds[c]).alias(f"v{i}") for i, c in enumerate(dimensions)],
    )


def _cut_into_pieces(rows: DataFrame, total: int, count: int, shards: int) -> DataFrame:
    """Add ``piece``: 0, or a number by the hash of the row's id and metadata in a heavy group."""
    n, weight = F.count(F.lit(1)), F.sum("size")
    most_bytes, most_rows = max(1.0, SHARE * total / shards), max(1.0, SHARE * count / shards)
    heavy = rows.groupBy("text_hash", "text_crc32", "size").agg(
        F.when(n > 1, F.greatest(F.ceil(weight / most_bytes), F.ceil(n / most_rows))).otherwise(1).cast("int").alias("pieces")
    )
    heavy = heavy.where("pieces > 1").select(F.struct("text_hash", "text_crc32", "size").alias("_heavy"), "pieces")
    values = [c for c in rows.columns if c.startswith("v")]
    group = F.struct("text_hash", "text_crc32", "size")
    found = rows.withColumn("group", group).join(F.broadcast(heavy), F.col("group").eqNullSafe(F.col("_heavy")), "left")
    own = F.pmod(F.xxhash64("doc_id", *values), F.col("pieces").cast("long"))
    return found.select(*rows.columns, F.coalesce(own, F.lit(0)).cast("int").alias("piece"))


def _coordinates(points: DataFrame, n: int) -> DataFrame:
    """Scale every dimension to 1 .. 65535 of its extent over all points; null is 0."""
    ends = points.agg(*[f(f"v{i}").alias(f"{name}{i}") for i in range(n) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << COORDINATE) - 2

    def scaled(i: int) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None or hi <= lo:
            return F.when(F.col(f"v{i}").isNull(), 0).otherwise(1).cast("long")
        return F.coalesce((F.lit(1) + F.floor((F.col(f"v{i}") - lo) / (hi - lo) * top)).cast("long"), F.lit(0).cast("long"))

    return points.select("*", *[scaled(i).alias(f"x{i}") for i in range(n)]).drop(*[f"v{i}" for i in range(n)])


def _key(dimensions: int) -> Column:
    """A point's place along its node's dimension, and a hash that orders points of the same place."""
    along = F.coalesce(*[F.when(F.col("split") == i, F.col(f"x{i}")) for i in range(dimensions)])
    return F.shiftleft(along, TIE).bitwiseOR(F.col("tie"))


def _search(points: DataFrame, nodes: dict[int, Node], dimensions: int) -> None:
    """Find each node's cut: the least key at which the weight reaches what the left half is to hold."""
    spark = points.sparkSession
    for shift in range(COORDINATE + TIE - DIGIT, -1, -DIGIT):
        state = [(k, n.split, n.prefix, float(n.want - n.below)) for k, n in nodes.items()]
        known = spark.createDataFrame(state, "node long, split int, prefix long, want double")
        near = points.join(F.broadcast(known), "node").withColumn("key", _key(dimensions))
        near = near.where(F.shiftright("key", shift + DIGIT) == F.col("prefix"))
        bins = near.groupBy("node", "want", F.shiftright("key", shift).alias("bin")).agg(F.sum("weight").alias("at"))
        # At most 65536 bins a node.
        upto = F.sum("at").over(Window.partitionBy("node").orderBy("bin"))
        reached = bins.withColumn("upto", upto).where(F.col("upto") >= F.col("want"))
        first = reached.groupBy("node").agg(F.min(F.struct("bin", "at", "upto")).alias("b"))
        for row in first.collect():
            node = nodes[row["node"]]
            node.prefix, node.at = row["b"]["bin"], row["b"]["at"]
            node.below += row["b"]["upto"] - row["b"]["at"]


def split_points(points: DataFrame, dimensions: int, shards: int) -> DataFrame:
    """Add ``shard`` to points: weight, tie, x0, x1, ...; every level is written once."""
    spark = points.sparkSession
    nodes = {1: Node(0, shards)}
    now = Stored(points.withColumn("node", F.lit(1).cast("long")), "kd-points")
    while wide := {k: n for k, n in nodes.items() if n.shards > 1}:
        ends = [f(f"x{i}").alias(f"{name}{i}") for i in range(dimensions) for name, f in (("lo", F.min), ("hi", F.max))]
        for row in now.df.where(F.col("node").isin(list(wide)) if len(wide) < 64 else F.lit(True)).groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect():
            if node := wide.get(row["node"]):
                widths = [row[f"hi{i}"] - row[f"lo{i}"] for i in range(dimensions)]
                node.split, node.want = widths.index(max(widths)), row["w"] * (node.shards // 2) / node.shards
        filled = {k: n for k, n in wide.items() if n.split >= 0}
        _search(now.df, filled, dimensions)
        cuts, following = [], {k: n for k, n in nodes.items() if n.shards == 1}
        for k, n in wide.items():
            half = n.shards // 2
            following |= {2 * k: Node(n.first, half), 2 * k + 1: Node(n.first + half, n.shards - half)}
            if k in filled:
                # The point at the cut goes to the side that comes nearer to its share with it.
                left = n.prefix if n.want - n.below >= n.below + n.at - n.want else n.prefix - 1
                cuts.append((k, n.split, left))
        known = spark.createDataFrame(cuts, "node long, split int, cut long")
        placed = now.df.join(F.broadcast(known), "node", "left")
        side = F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + (_key(dimensions) > F.col("cut")).cast("long"))
        before, now = now, Stored(placed.withColumn("node", side).drop("split", "cut"), "kd-points")
        before.drop()
        nodes = following
    leaves = spark.createDataFrame([(k, n.first) for k, n in nodes.items()], "node long, shard int")
    return now.df.join(F.broadcast(leaves), "node").drop("node")


def _numbered(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """Add ``slot``: rows of a shard by hash bucket, then id; a bucket is ranked, and shifted by those before."""
    buckets = count // (shards * NUMBERED) + 1
    each = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = each.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = each.withColumn("place", F.row_number().over(inside))
    return ranked.join(sizes, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("place") - 1).drop("bucket", "start", "place")


def shard(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text",
    dimensions: tuple[str, ...] = ("lang", "source", "n_chars"),
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): a shard of nearly equal bytes for every row.

    ``size`` is the text's UTF-8 bytes and 1. Give the number of shards, or the bytes one is to
    have. Shards are boxes of the dimensions: a shard holds few sources, languages and lengths.
    Names are placed by hash, numbers by logarithm, null below all others. Documents with equal
    texts share a shard unless the group passes 2 % of a shard's bytes or rows; such a group is cut
    by the hash of id and metadata, and rows that agree in all of these stay together. Null and
    empty texts are groups of size 1. Slots are gapless from 0. Other columns are not looked at; an
    empty table gives an empty result. Texts are read once, whole, for their hashes.
    """
    rows = Stored(_rows(docs, doc_id, text, list(dimensions)), "shard-rows").df
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if shards is None:
        shards = max(1, -(-(total or 0) // (target_bytes or 1 << 30)))
    rows = Stored(_cut_into_pieces(rows, total or 0, count, shards), "shard-pieces").df
    name = ["text_hash", "text_crc32", "size", "piece"]
    values = [f"v{i}" for i in range(len(dimensions))]
    points = rows.groupBy(*name).agg(F.sum("size").alias("weight"), *[F.min(v).alias(v) for v in values])
    points = points.withColumn("tie", F.pmod(F.xxhash64(*name), F.lit(1 << TIE)))
    points = Stored(points, "shard-points").df
    placed = split_points(_coordinates(points, len(dimensions)), len(dimensions), shards)
    # A null text has no checksum; its group is told by the others.
    placed = placed.select(F.struct(*name).alias("point"), "shard")
    found = rows.withColumn("point", F.struct(*name)).join(placed.withColumnRenamed("point", "_point"), F.col("point").eqNullSafe(F.col("_point")))
    found = Stored(found.select("doc_id", "size", "text_crc32", "shard"), "shard-found").df
    return _numbered(found, count, shards)
