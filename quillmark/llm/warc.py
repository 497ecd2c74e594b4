"""Merkle audit of WARC replicas: compare roots, then go down only where branches differ.

A record is a leaf with a fixed slot in its file; a node's hash covers the hashes, slots and byte
lengths of its children, so it stands for an ordered range of the file's bytes. Lengths, not
absolute offsets, are hashed: a record that changed its size is found without blaming the rest of
the file. Offsets are worked out for the records that are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Stored

#: Records of a file, and children of a node: files have this many to the third.
FAN_OUT = 16
LEVELS = 3
FILE_RECORDS = FAN_OUT**LEVELS


def record(page_id: Column, url: Column, html: Column) -> Column:
    """Bytes of a response record as text; null parts are empty."""
    body = F.coalesce(html, F.lit(""))
    head = [
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:", F.coalesce(page_id.cast("string"), F.lit("")),
        ">\r\nWARC-Target-URI: ", F.coalesce(url, F.lit("")), "\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n",
    ]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head], body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """(file, slot, page_id, hash, length): one leaf per page id.

    Pages are filed by id, so that a lost record leaves a gap and moves no other. Rows that repeat
    an id are one leaf, whose hash covers the sorted distinct records. Rows without an id are filed
    after the others by the hash of their record, as leaves without id.
    """
    body = record(F.col("page_id"), F.col("url"), F.col("html"))
    each = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(body, 256).alias("h"), F.octet_length(body).cast("long").alias("n"))
    # A null id's leaf is named by its own hash, below zero, where no file of ids is.
    own = -1 - F.conv(F.substring("h", 1, 12), 16, 10).cast("long")
    each = each.withColumn("name", F.coalesce("page_id", own)).distinct()
    found = each.groupBy("name").agg(
        F.min("page_id").alias("page_id"), F.max("h").alias("h"), F.min("h").alias("h0"), F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("length"), F.bit_xor(F.xxhash64("h", "n")).alias("x"),
    )
    several = F.sha2(F.concat_ws(":", "h0", "h", "k", "x"), 256)
    file = F.floor(F.col("name") / FILE_RECORDS).cast("long")
    return found.select(
        file.alias("file"), F.pmod(F.col("name"), F.lit(FILE_RECORDS)).cast("int").alias("slot"), "page_id",
        F.when(F.col("k") == 1, F.col("h")).otherwise(several).alias("hash"), "length",
    )


def _parents(level: DataFrame, key: str) -> DataFrame:
    """Nodes over consecutive children: at most ``FAN_OUT`` of them each."""
    child = F.struct(F.col(key).alias("slot"), "hash", "length")
    grouped = level.groupBy("file", F.floor(F.col(key) / FAN_OUT).cast("int").alias("node")).agg(
        F.sort_array(F.collect_list(child)).alias("c"), F.sum("length").alias("length")
    )
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["slot"], x["hash"], x["length"])), ",")
    return grouped.select("file", "node", F.sha2(text, 256).alias("hash"), "length")


def tree(pages: DataFrame) -> list[DataFrame]:
    """Levels of a replica's trees from leaves to file roots, each a table in the shared folder."""
    levels = [Stored(leaves(pages), "warc-leaves").df]
    key = "slot"
    for _ in range(LEVELS):
        levels.append(Stored(_parents(levels[-1], key), "warc-nodes").df)
        key = "node"
    return levels


def _unequal(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left = a.select(*keys, F.col("hash").alias("_a"), F.col("length").alias("_m"))
    right = b.select(*keys, F.col("hash").alias("_b"), F.col("length").alias("_n"))
    joined = left.join(right, keys, "full")
    same = F.col("_a").eqNullSafe(F.col("_b")) & F.col("_m").eqNullSafe(F.col("_n"))
    return joined.where(~same).select(*keys)


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(page_id, status, offset_a, length_a, sha256_a, offset_b, length_b, sha256_b) of unequal records.

    ``first`` and ``second``: page_id, url, html of two replicas. status: changed, missing (from the
    second) or extra. From the file roots down, only children of unequal nodes are compared. Null
    and empty parts are hashed as empty, order and partitioning do not matter, other columns are
    not looked at, and equal or empty replicas give no rows.
    """
    a, b = tree(first), tree(second)
    bad = Stored(_unequal(a[-1], b[-1], ["file", "node"]), "warc-bad").df
    for level in range(LEVELS - 1, -1, -1):
        key = "node" if level else "slot"
        up = bad.select("file", F.col("node").alias("_up"))

        def below(side: list[DataFrame]) -> DataFrame:
            rows = side[level].withColumn("_up", F.floor(F.col(key) / FAN_OUT).cast("int"))
            return rows.join(up, ["file", "_up"], "left_semi")

        bad = Stored(_unequal(below(a), below(b), ["file", key]), "warc-bad").df
    files = bad.select("file").distinct()

    def placed(side: list[DataFrame], mark: str) -> DataFrame:
        # Only files with damage are laid out; a file has a bounded number of records.
        before = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        rows = side[0].join(files, "file", "left_semi")
        offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
        rows = rows.withColumn("offset", offset).join(bad, ["file", "slot"], "left_semi")
        return rows.select(
            "file", "slot", F.col("page_id").alias(f"id{mark}"), F.col("offset").alias(f"offset{mark}"),
            F.col("length").alias(f"length{mark}"), F.col("hash").alias(f"sha256{mark}"),
        )

    both = placed(a, "_a").join(placed(b, "_b"), ["file", "slot"], "full")
    status = F.when(F.col("sha256_b").isNull(), "missing").when(F.col("sha256_a").isNull(), "extra").otherwise("changed")
    return both.select(
        F.coalesce("id_a", "id_b").alias("page_id"), status.alias("status"), "offset_a", "length_a", "sha256_a",
        "offset_b", "length_b", "sha256_b",
    )
