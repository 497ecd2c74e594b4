"""Near-duplicate documents by 64-bit fingerprints, found through Golay codeword keys.

A fingerprint is cut in three segments of 23, 23 and 18 bits. With at most two differing bits, one
segment is free of errors; one other segment, decoded to the codewords of the binary Golay code
(23, 12) within four bits, then shares a codeword index with its partner, as every word lies within
three bits of a codeword: the one nearest to the middle of both is within four of each. So each
fingerprint has one or six keys per family, and every link meets in a key. Pairs are verified by
their bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Stored, packed, slices
from quillmark.llm.components import components

#: Generator polynomial of the Golay code, hash seed of the contract.
GENERATOR = 0b101011100011
SEED = 42
CHUNK = 1 << 16
#: Distinct fingerprints in a key's bucket beyond which its members meet by finer exact keys.
BUCKET = 64


def fingerprint(text: str | None, size: int = 3) -> int:
    """Signed 64-bit majority of the shingle hashes; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < size:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(size))))
    n = max(1, len(found) - size + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(text: Column, size: int = 3) -> Column:
    """Fingerprint of a whole text as a long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return of(text)


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _remainder(word: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials modulo the generator."""
    rest = word.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@cache
def _near_errors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of up to four bits (six at most), and how many there are."""
    patterns = np.array(
        [sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(23), w)], np.int64
    )
    syndromes = _remainder(patterns)
    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for syndrome, pattern in zip(syndromes, patterns):
        table[syndrome, count[syndrome]] = pattern
        count[syndrome] += 1
    return table, count


def golay_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of all codewords within four bits of 23-bit words, and their rows."""
    table, count = _near_errors()
    syndromes = _remainder(segment)
    slot = np.arange(6) < count[syndromes][:, None]
    codewords = segment[:, None] ^ table[syndromes]
    rows = np.nonzero(slot)[0]
    return codewords[slot] >> 11, rows


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints and the row of each: family, exact segment, codeword index."""
    bits = prints.astype(np.int64).view(np.uint64)
    a = (bits & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (bits >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (bits >> np.uint64(46)).astype(np.int64)
    keys, rows = [], []
    for family, (exact, near) in enumerate(((c, a), (a, b), (b, a))):
        index, row = golay_indices(near)
        keys.append((family << 40) | (exact[row] << 12) | index)
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _key_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 100_000):
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        keys, rows = golay_keys(prints)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows])], ["key", "fp"])


def _masks(parts: int, free: int) -> list[int]:
    """Signed masks that hide ``free`` of ``parts`` equal segments of a fingerprint."""
    width = 64 // parts
    segment = (1 << width) - 1
    hidden = [sum(segment << (width * i) for i in some) for some in combinations(range(parts), free)]
    return [int(np.uint64(~h & 0xFFFFFFFFFFFFFFFF).astype(np.int64)) for h in hidden]


def _pairs(keyed: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Pairs of fingerprints that share a key and differ in few bits."""
    left = keyed.select(*keys, F.col("fp").alias("a"))
    right = keyed.select(*keys, F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return left.join(right, keys).where(near).select("a", "b")


def _by_masks(prints: DataFrame, parts: int, distance: int) -> DataFrame:
    masks = F.array(*[F.lit(m) for m in _masks(parts, distance)])
    return prints.select("fp", F.posexplode(masks).alias("family", "mask")).select(
        "family", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )


def links(prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): every pair of distinct fingerprints (column ``fp``) at most ``distance`` <= 2 bits apart.

    A bucket of more than ``bucket`` fingerprints is not joined. Its members meet exactly by what
    is left of them when two of eight segments are hidden, and, where that is crowded too, two of
    sixteen: then at most 256 fingerprints can share a key.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the keys cover distances of 0 to 2 bits")
    spread = prints.select(F.col("fp").cast("long").alias("fp")).where("fp is not null").distinct()
    keyed = Stored(spread.mapInArrow(_key_rows, "key long, fp long"), "golay-keys").df
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key")
    found = _pairs(keyed.join(crowded, "key", "left_anti"), ["key"], distance)
    hot = Stored(keyed.join(crowded, "key", "left_semi").select("fp").distinct(), "crowded").df
    if not hot.isEmpty():
        wide = Stored(_by_masks(hot, 8, 2), "mask-keys").df
        full = wide.groupBy("family", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * bucket)
        full = full.select("family", "key")
        found = found.unionAll(_pairs(wide.join(full, ["family", "key"], "left_anti"), ["family", "key"], distance))
        rest = wide.join(full, ["family", "key"], "left_semi").select("fp").distinct()
        found = found.unionAll(_pairs(_by_masks(rest, 16, 2), ["family", "key"], distance))
    return found.distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, distance: int = 2,
    bucket: int = BUCKET,
) -> DataFrame:
    """(doc_id, fp, component_id) for every row: its fingerprint and the least id of its component.

    Null and empty texts have fingerprint 0 and are linked like any other. Equal fingerprints are
    one node, so copies cost no pairs. Repeated rows stay repeated; a null id is never a
    component's least id unless nothing else is in it, then the component is null. Other columns
    of ``docs`` are not looked at. An empty table gives an empty result.
    """
    each = docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), size).alias("fp"))
    return _rooted(each, distance, bucket).select("doc_id", "fp", "component_id")


def _rooted(each: DataFrame, distance: int, bucket: int) -> DataFrame:
    """The rows of ``each`` (doc_id, fp, ...) with the root and the least id of their component."""
    table = Stored(each, "fingerprints").df
    classes = Stored(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes").df
    roots = components(links(classes, distance, bucket))
    tied = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    heads = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = Stored(tied.join(heads, "root").select("fp", "root", "component_id"), "fingerprint-components").df
    return table.join(labels, "fp")


def _row_marks(docs: DataFrame) -> list[Column]:
    """What tells rows apart: the id, null or not, and 128 bits of the text's hash."""
    doc_id, text = docs["doc_id"], docs["text"]
    hashes = [F.xxhash64(text).alias("_x"), F.xxhash64(F.lit(1), text).alias("_y")]
    return [doc_id.isNull().alias("_none"), F.when(doc_id.isNull(), F.lit("")).otherwise(doc_id.cast("string")).alias("_id"), *hashes]


def keep_first(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """One row of each component, the one with the least (id, text); the columns of ``docs`` stay.

    Rows without an id come after those with one, and a null text after any other. Rows that are
    equal in id and text are one document, and any one of them stays. Null and empty texts are
    documents with fingerprint 0; an empty table stays empty; other columns may have any name.
    """
    keys = ["_none", "_id", "_x", "_y"]
    marked = docs.select(packed(docs).alias("_row"), "doc_id", "text", *_row_marks(docs))
    each = marked.select("doc_id", *keys, fingerprints(F.col("text"), size).alias("fp"))
    heads = _rooted(each, distance, BUCKET).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = Stored(heads.select("root", *keys).distinct(), "component-heads").df
    several = heads.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    chosen = heads.join(several, "root", "left_anti").select(*keys)
    # Only where an id or its lack is repeated in a component, texts decide.
    tied = Stored(heads.join(several, "root"), "tied-heads").df
    if not tied.isEmpty():
        first = F.struct(F.col("text").isNull().alias("no_text"), "text", *keys)
        least = marked.select(*keys, "text").join(tied, keys).groupBy("root").agg(F.min(first).alias("first"))
        chosen = chosen.unionAll(least.select(*(F.col(f"first.{k}").alias(k) for k in keys)))
    return marked.join(chosen, keys, "left_semi").dropDuplicates(keys).select("_row.*")
