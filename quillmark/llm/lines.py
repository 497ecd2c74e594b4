"""Fuzzy line deduplication: MinHash bands, exact Jaccard, union-find, one line per component.

A line is compared by the set of its character shingles, lower case and with single blanks. Exact
copies share a key and cost nothing more. Lines that share a band are candidates. Every line of a
bucket is verified against one leader and the links are joined to components; after that only
pairs between components are left. These are verified block by block, as products of shingle
matrices, so that no connection within a bucket is lost and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Stored, packed, slices, strips
from quillmark.llm.components import components

SHINGLE = 9
SIMILARITY = 0.8
#: Bands of rows: a pair at the threshold meets with probability 1 - (1 - 0.8 ** 4) ** 12 = 0.998,
#: one at 0.85 with 0.9998.
BANDS, ROWS = 12, 4
#: Every line with a word takes part; blank lines do not.
LEAST_WORDS = 1
#: Load of a block of lines, where a line counts 1 and 1 more for every 1000 characters; rows of small
#: blocks that share a task; shingles that a matrix holds at a time; pairs verified at a time.
BLOCK, PACK, COLUMNS, PAIRS = 256, 4000, 4096, 512
#: Lines that are compared pair by pair; more are compared as matrices.
FEW = 8
#: Texts at a time; characters hashed at a time; characters of the lines that are signed or made sets of
#: at a time, as they take some 50 times their size; lines a task remembers as already signed.
TEXTS = 400
STRIP = 1 << 15
GROUP = 1 << 20
REMEMBERED = 400_000


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def shingles(line: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct character shingles of a normal line as sorted 64-bit codes; a shorter line is one."""
    return np.unique(_codes([line], size)[0])


def _codes(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the shingles of all lines in a row, and where each line's begin."""
    padded = [x if len(x) >= size else x + "\0" * (size - len(x)) for x in lines]
    flat = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), "<u4")
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    starts = np.cumsum(lengths) - lengths
    code = np.empty(len(flat), np.uint64)
    # Strips keep the working set in the processor's cache.
    for a in range(0, len(flat), STRIP):
        part = _windows(flat[a : a + STRIP + size - 1].astype(np.uint64), size)[: len(flat[a : a + STRIP])]
        part ^= part >> np.uint64(31)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        code[a : a + len(part)] = part
    # Windows that run over a line's end are no shingles of it.
    inner = lengths - size + 1
    begins = np.cumsum(inner) - inner
    return code[np.arange(int(inner.sum())) + np.repeat(starts - begins, inner)], begins


def _windows(flat: np.ndarray, size: int) -> np.ndarray:
    """Polynomial of the ``size`` values from each place on, put together from windows of doubled width."""
    base = 0x9E3779B97F4A7C15
    found, have, pair, width = None, 0, flat, 1
    while True:
        if size & width:
            # Windows of what is left stand before those that are known.
            if found is None:
                found, have = pair.copy(), width
            else:
                later = np.zeros_like(found)
                later[: max(0, len(found) - width)] = found[width:]
                found, have = pair * np.uint64(pow(base, have, 1 << 64)) + later, have + width
        if 2 * width > size:
            return found
        longer = pair * np.uint64(pow(base, width, 1 << 64))
        longer[: max(0, len(pair) - width)] += pair[width:]
        pair, width = longer, 2 * width


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of codes."""
    both = shared(x, y)
    return both / (len(x) + len(y) - both)


def jaccard(a: str, b: str, size: int = SHINGLE) -> float:
    return overlap(shingles(a, size), shingles(b, size))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def groups(sizes: Iterable[int], most: int | None = None) -> list[slice]:
    """Runs of items whose sizes add up to at most ``most``; a larger item is alone."""
    out, start, load = [], 0, 0
    most, stop = GROUP if most is None else most, 0
    for stop, n in enumerate(sizes, 1):
        if load and load + n > most:
            out.append(slice(start, stop - 1))
            start, load = stop - 1, 0
        load += n
    return out + [slice(start, stop)] if stop else out


def signatures(lines: list[str], size: int = SHINGLE, n: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values (lines x n) of normal lines, computed over one flat array of characters."""
    code, begins = _codes(lines, size)
    mixed = (code >> np.uint64(32)).astype(np.uint32)
    factors = _multipliers(n)
    out = np.full((len(lines), n), 0xFFFFFFFF, np.uint32)
    # Strips that end with a line keep the working set in the processor's cache.
    edges = np.unique(np.append(np.searchsorted(begins, np.arange(0, len(mixed), STRIP)), len(lines)))
    for a, b in zip(edges[:-1], edges[1:]):
        end = begins[b] if b < len(lines) else len(mixed)
        part, at = mixed[begins[a] : end], begins[a:b] - begins[a]
        product = np.empty_like(part)
        for k in range(n):
            np.multiply(part, factors[k], out=product)
            out[a:b, k] = np.minimum.reduceat(product, at)
    return out


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """64-bit key of each band of a signature, different from band to band."""
    rows = values.shape[1] // bands
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.zeros((len(values), 1), np.uint64)
    parts = values.reshape(len(values), bands, rows).astype(np.uint64)
    for r in range(rows):
        key = (key ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


#: What a text of normal lines does not have: runs of blanks, blanks at a line's ends, other white space.
_RUNS = ("  ", "\n ", " \n")
_SPACES = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_ASCII_SPACES = tuple(c for c in _SPACES if c.isascii())


def normal_lines(text: str) -> list[str]:
    """Lines of a text, each normal; a line without a word is empty."""
    low = text.lower()
    marks = _RUNS + (_ASCII_SPACES if low.isascii() else _SPACES)
    if low[:1] == " " or low[-1:] == " " or any(m in low for m in marks):
        return [" ".join(line.split()) for line in low.split("\n")]
    return low.split("\n")


def _occurrences(least_words: int):
    """Rows (doc_id, text_hash, line_no, key, bands) of each line; bands only where the task first meets a line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in strips(slices(batches, TEXTS), "text", GROUP):
            ids, hashes, places, keys, fresh, at = [], [], [], [], [], []
            if len(seen) > REMEMBERED:
                seen.clear()
            for doc_id, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for place, line in enumerate(normal_lines(text or "")):
                    if not line or least_words > 1 and line.count(" ") + 1 < least_words:
                        continue
                    key = xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), seed=42)
                    if key not in seen:
                        seen.add(key)
                        at.append(len(ids))
                        fresh.append(line)
                    ids.append(doc_id)
                    hashes.append(text_hash)
                    places.append(place)
                    keys.append(key)
            if not ids:
                continue
            sizes = np.zeros(len(ids), np.int64)
            sizes[at] = BANDS
            parts = [band_keys(signatures(fresh[g])).ravel() for g in groups(map(len, fresh))]
            flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)), bands],
                ["doc_id", "text_hash", "line_no", "key", "bands"],
            )

    return run


def _sets(lines: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted shingle codes of each normal line, hashed over one flat array for a group of lines."""
    out = []
    for group in groups(map(len, lines)):
        code, begins = _codes(lines[group], size)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(code)]):
            part = np.sort(code[a:b])
            fresh = np.empty(len(part), bool)
            fresh[0] = True
            np.not_equal(part[1:], part[:-1], out=fresh[1:])
            out.append(part[fresh])
    return out


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Codes that two sorted sets have in common."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))


def near_pairs(left: list[str], right: list[str], similarity: float) -> np.ndarray:
    """Whether the lines of each pair are similar enough; numbers of shingles alone rule many out."""
    lines = list(dict.fromkeys([*left, *right]))
    sets = dict(zip(lines, _sets([normal(x) for x in lines])))
    out = np.zeros(len(left), bool)
    for k, (a, b) in enumerate(zip(left, right)):
        out[k] = alike(sets[a], sets[b], similarity)
    return out


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of codes have that Jaccard similarity or more."""
    n, m = len(x), len(y)
    if min(n, m) < similarity * max(n, m):
        return False
    both = shared(x, y)
    return both >= similarity * (n + m - both)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those distinct pairs of line keys whose whole lines are similar enough."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(a), PAIRS):
            x, y = a[i : i + PAIRS].tolist(), b[i : i + PAIRS].tolist()
            out += [near_pairs(x[g], y[g], similarity) for g in groups(len(p) + len(q) for p, q in zip(x, y))]
        return pd.Series(np.concatenate(out) if out else [], dtype="bool")

    left = texts.select(F.col("key").alias("a"), F.col("line").alias("_a"))
    right = texts.select(F.col("key").alias("b"), F.col("line").alias("_b"))
    return pairs.join(left, "a").join(right, "b").where(near("_a", "_b")).select("a", "b")


def similarities(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarities of all sets of codes on the left with all on the right."""
    sets = left + right
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Codes of one set alone add nothing to an overlap.
    column = (np.cumsum(times > 1) - 1)[at]
    owner, column = owner[times[at] > 1], column[times[at] > 1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, total, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        holds = np.zeros((len(sets), min(COLUMNS, total - low)), np.float32)
        holds[owner[i:j], column[i:j] - low] = 1
        both += holds[: len(left)] @ holds[len(left) :].T
    both = both.astype(np.float64)
    return both / (sizes[: len(left), None] + sizes[None, len(left) :] - both)


def forest(keys: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], cut: int, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what the similar pairs connect, beyond the roots that are known.

    Lines before ``cut`` are compared with the ones from there on, or all with all if ``cut`` is 0.
    """
    if len(keys) <= FEW:
        pairs = ((i, j) for i in range(cut or len(keys)) for j in range(cut or i + 1, len(keys)))
        pairs = [(i, j) for i, j in pairs if roots[i] != roots[j] and alike(sets[i], sets[j], similarity)]
    else:
        first, last = (slice(0, cut), slice(cut, None)) if cut else (slice(None), slice(None))
        near = similarities(sets[first], sets[last]) >= similarity
        near &= roots[first][:, None] != roots[last][None, :]
        pairs = [(i, j + cut) for i, j in zip(*(x.tolist() for x in np.nonzero(near)))]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out = []
    for i, j in pairs:
        a, b = top(int(roots[i])), top(int(roots[j]))
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((int(keys[i]), int(keys[j])))
    return out


def block_links(frame: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links within each (bucket, a, b) of a task: rows of block, key, root, line.

    A line's shingles are hashed once for the task, and a pair of blocks that holds the same lines
    as an earlier one of another bucket is not compared again.
    """
    names = ["bucket", "a", "b", "block", "key", "root"]
    bucket, first, last, block, key, root = (frame[c].to_numpy() for c in names)
    order = np.lexsort((key, block, last, first, bucket))
    bucket, first, last, block, key, root = (x[order] for x in (bucket, first, last, block, key, root))
    distinct, where = np.unique(frame["key"].to_numpy(), return_index=True)
    lines = frame["line"].to_numpy()
    sets = dict(zip(distinct.tolist(), _sets([normal(x) for x in lines[where]])))
    change = (np.diff(bucket) != 0) | (np.diff(first) != 0) | (np.diff(last) != 0)
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(key)]
    out: list[tuple[int, int]] = []
    done: set[tuple[bytes, int]] = set()
    for i, j in zip(edges[:-1], edges[1:]):
        cut = 0 if first[i] == last[i] else int((block[i:j] == first[i]).sum())
        same = (key[i:j].tobytes(), cut)
        if same not in done:
            done.add(same)
            out += forest(key[i:j], root[i:j], [sets[k] for k in key[i:j].tolist()], cut, similarity)
    return out


def _block_pairs(rest: DataFrame) -> DataFrame:
    """(task, bucket, a, b, block, key, root): the lines of every pair of blocks that may hold links.

    ``rest``: bucket, key, root, load. A root with much load has blocks of its own, dealt by key; the
    other roots of a bucket are dealt whole. Two blocks of one and the same root need no comparison.
    Pairs of small blocks share tasks; any other task holds two blocks.
    """
    sizes = rest.groupBy("bucket", "root").agg(F.sum("load").alias("own"))
    small = sizes.where(F.col("own") <= BLOCK).groupBy("bucket").agg(F.sum("own").alias("others"))
    parts = lambda load: F.ceil(F.col(load) / BLOCK)
    block = F.when(
        F.col("own") > BLOCK, F.xxhash64("root", F.pmod(F.xxhash64("key"), parts("own")))
    ).otherwise(F.pmod(F.xxhash64("root"), parts("others")))
    dealt = rest.join(sizes, ["bucket", "root"]).join(small, "bucket", "left")
    dealt = Stored(dealt.select("bucket", block.alias("block"), "key", "root", "load"), "line-blocks").df
    packs = dealt.count() // PACK + 1
    blocks = dealt.groupBy("bucket", "block").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("key").alias("first"), F.max("key").alias("last"), F.sum("load").alias("load")
    )
    names = ("block", "lo", "hi", "first", "last", "load")
    left, right = (blocks.select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in names)) for x in "ab")
    one_root = (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b"))
    pairs = left.join(right, "bucket").where((F.col("block_a") <= F.col("block_b")) & ~one_root)
    alone = F.xxhash64("bucket", "block_a", "block_b")
    # Small blocks with the same first and last line likely hold the same lines, and are compared once
    # if they meet. A line is in as many buckets as there are bands, so no more of them share ends.
    alike = F.xxhash64(*(F.col(f"{end}_{x}") for x in "ab" for end in ("first", "last")))
    task = F.when(F.col("load_a") + F.col("load_b") < BLOCK // 4, F.pmod(alike, F.lit(packs))).otherwise(alone)
    ends = pairs.select(
        task.alias("task"), "bucket", F.col("block_a").alias("a"), F.col("block_b").alias("b"),
        F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"),
    )
    return dealt.select("bucket", "block", "key", "root").join(ends, ["bucket", "block"])


def line_links(crowd: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that connect all lines which share a bucket and are similar enough.

    ``crowd``: bucket, key; ``texts``: key, line. The lines of a bucket are verified against its
    least key, and the links joined to components. In buckets that still hold several components,
    the lines are dealt to blocks, and every two blocks that do not belong to one component are
    compared as matrices of shingles. A pair of blocks gives a forest of links, not all of them.
    """
    crowd = crowd.select("bucket", "key")
    leaders = crowd.groupBy("bucket").agg(F.min("key").alias("a"))
    met = crowd.join(leaders, "bucket").where(F.col("key") > F.col("a")).select("a", F.col("key").alias("b"))
    known = _verified(met.distinct(), texts, similarity)
    roots = components(Stored(known, "leader-links").df)
    tied = crowd.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select(
        "bucket", "key", F.coalesce("root", "key").alias("root")
    )
    # Two lines have met as leader and line already.
    several = tied.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    several = several.where("n > 2 and lo <> hi").select("bucket")
    load = texts.select("key", (1 + F.length("line") / 1000).cast("long").alias("load"))
    rest = Stored(tied.join(several, "bucket").join(load, "key"), "open-buckets").df

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        out = block_links(frame, similarity)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    pairs = _block_pairs(rest).join(texts, "key")
    found = pairs.groupBy("task").applyInPandas(links, "a long, b long")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found)


def duplicate_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(doc_id, line_no, first_doc_id, first_line_no, kept, text_hash): lines that have copies or near copies.

    Lines are cut at line feeds and numbered from 0. A component keeps its first line by (doc_id,
    line_no, text_hash). Lines of fewer than ``least_words`` words, null and empty texts, and rows
    without an id have no rows here. A document is its id and the hash of its text: rows that repeat
    both count as one, and texts that share an id are told apart by ``text_hash``. Other columns are
    not looked at. An empty table gives an empty result.
    """
    table = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    table = table.where("doc_id is not null")
    schema = "doc_id long, text_hash long, line_no int, key long, bands array<long>"
    signed = Stored(table.mapInArrow(_occurrences(least_words), schema), "lines")
    lines = signed.df
    place = F.struct("doc_id", "line_no", "text_hash")
    classes = Stored(lines.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "line-classes").df
    # One shuffle by bucket: buckets of one line go, copies of a line fall together there.
    each = lines.where(F.size("bands") > 0).select("key", F.explode("bands").alias("bucket"))
    whole = Window.partitionBy("bucket")
    crowd = each.select("bucket", "key", F.min("key").over(whole).alias("lo"), F.max("key").over(whole).alias("hi"))
    crowd = Stored(crowd.where("lo <> hi").select("bucket", "key").dropDuplicates(), "buckets").df
    # The bands are most of what is written, and no longer needed.
    lines = Stored(lines.select("doc_id", "text_hash", "line_no", "key"), "line-places").df
    signed.drop()
    wanted = classes.join(crowd.select("key").distinct(), "key").select("first.doc_id", "first.text_hash", F.struct(F.col("first.line_no").alias("line_no"), "key").alias("at"))
    wanted = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("at").alias("wanted"))
    texts = table.join(wanted, ["doc_id", "text_hash"]).select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("at")).select(
        F.col("at.key").alias("key"), F.get("lines", F.col("at.line_no")).alias("line")
    )
    texts = Stored(texts.where("line is not null").dropDuplicates(["key"]), "line-texts").df
    roots = components(line_links(crowd, texts, similarity)).select(F.col("node").alias("key"), "root")
    tied = classes.join(roots, "key", "left").select("key", "first", "n", F.coalesce("root", "key").alias("root"))
    whole = tied.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    owners = Stored(tied.select("key", "root").join(whole, "root").select("key", "first"), "line-components").df
    return lines.join(owners, "key").select(
        "doc_id", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"),
        (place == F.col("first")).alias("kept"), "text_hash",
    ).distinct()


def drop_duplicate_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose texts have lost every duplicate line but the one kept.

    Other columns stay as they are, and so do rows without an id. A text all of whose lines are
    copies becomes empty; null texts stay null. Rows that repeat an id lose the lines of their own
    text only. Takes the options of ``duplicate_lines``.
    """
    gone = duplicate_lines(docs, **options).where(~F.col("kept"))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.map_from_arrays(F.collect_list("line_no"), F.collect_list(F.lit(True))).alias("_gone")
    )
    # The row travels as one struct, so that other columns may have any name.
    rows = docs.select(packed(docs).alias("_row"), F.col("doc_id").alias("_of"), F.xxhash64("text").alias("_text_hash"))
    joined = rows.join(gone, (F.col("_of") == F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    left = F.filter(F.split(F.col("_row.text"), "\n"), lambda x, i: ~F.map_contains_key("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("_row", F.col("_row").withField("text", text)).select("_row.*")
