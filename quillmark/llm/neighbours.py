"""Exact nearest neighbours by inner product, as a block matrix join with int8 tiles.

Queries and candidates are cut in blocks by hash and meet block by block. In a tile, int8 codes are
multiplied; norms of the rounding errors bound the true product. Pairs whose upper bound reaches the
k-th best lower bound of their query are computed again in double precision, the tile's best are
taken from a heap, and the bests of all tiles are merged.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Stored

#: Rows of a tile's sides, and candidates compared at a time within a tile.
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16384
STRIP = 2048


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(table), -1)


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, and norms of the vectors and of the rounding errors, rounded up."""
    scale = np.abs(rows).max(axis=1) / 127
    codes = np.rint(rows / scale[:, None])
    error = np.linalg.norm(rows - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, np.linalg.norm(rows, axis=1) * (1 + 1e-12), error * (1 + 1e-9)


def bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of two quantised sides.

    float32 holds the int8 products exactly up to a thousand components; wider vectors use float64.
    """
    kind = np.float32 if q[0].shape[1] <= 1000 else np.float64
    product = (q[0].astype(kind) @ c[0].astype(kind).T).astype(np.float64)
    product *= q[1][:, None]
    product *= c[1]
    # <x,y> - <x',y'> = <x-x',y> + <x',y-y'>, and |x'| <= |x| + |x-x'|.
    slack = q[3][:, None] * c[2] + (q[2] + q[3])[:, None] * c[3]
    slack += 1e-12 * q[2][:, None] * c[2]
    return product - slack, product + slack


def _best(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, k: int) -> list[list[tuple]]:
    """The k best (score, vec_id) of each query in a tile, best first."""
    coded = quantise(queries)
    heaps: list[list[tuple]] = [[] for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)
    for i in range(0, len(c_ids), STRIP):
        ids, part = c_ids[i : i + STRIP], candidates[i : i + STRIP]
        low, high = bounds(coded, quantise(part))
        own = q_ids[:, None] == ids
        low[own], high[own] = -np.inf, -np.inf
        if low.shape[1] > k:
            floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
        rows, cols = np.nonzero((high >= floor[:, None]) & ~own)
        scores = np.empty(len(rows))
        for j in range(0, len(rows), 1 << 16):
            s = slice(j, j + (1 << 16))
            scores[s] = np.einsum("ij,ij->i", queries[rows[s]], part[cols[s]])
        order = np.lexsort((ids[cols], -scores, rows))
        rows, found, scores = rows[order], ids[cols][order], scores[order]
        first = np.searchsorted(rows, np.arange(len(q_ids)))
        rank = np.arange(len(rows)) - first[rows]
        keep = rank < k
        for r, v, s in zip(rows[keep].tolist(), found[keep].tolist(), scores[keep].tolist()):
            if len(heaps[r]) < k:
                heapq.heappush(heaps[r], (s, -v))
            elif (s, -v) > heaps[r][0]:
                heapq.heapreplace(heaps[r], (s, -v))
        full = [h[0][0] if len(h) == k else -np.inf for h in heaps]
        floor = np.maximum(floor, full)
    return [[(s, -v) for s, v in sorted(h, reverse=True)] for h in heaps]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query's vector.

    Candidates are all rows but those with the query's own id; ties go to the smaller id. Vectors
    that are null, zero, or hold a null or non-finite component take no part, nor do rows without an
    id. Vectors are compared with those of their own length. A query with fewer candidates gets all
    of them; an empty table gives an empty result. Rows that repeat an id count once if they are
    equal, and are candidates each otherwise. Other columns are not looked at. Every query meets
    every block once: the work is queries times rows, cut in tiles of bounded size.
    """
    wide = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    rows = wide.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"),
        F.size(vector).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"),
    ).distinct()
    table = Stored(rows, "vectors").df
    n, m = table.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    c_blocks, q_blocks = max(1, math.ceil(n / CANDIDATE_BLOCK)), max(1, math.ceil(m / QUERY_BLOCK))

    def block(of: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(of)).cast("int")

    candidates = table.select("dim", block(c_blocks, 1).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("r"), "vec_id", "v")
    queries = table.where("q").select("dim", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c"), block(q_blocks, 2).alias("r"), "vec_id", "v")

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        q_ids, c_ids = (t.column("vec_id").to_numpy().astype(np.int64) for t in (left, right))
        found = _best(q_ids, _matrix(left, "v"), c_ids, _matrix(right, "v"), k)
        flat = [(q, v, s) for q, best in zip(q_ids.tolist(), found) for s, v in best]
        columns = list(zip(*flat)) if flat else [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    keys = ["dim", "c", "r"]
    near = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(tile, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
