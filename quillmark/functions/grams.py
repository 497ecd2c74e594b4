"""Character n-grams of many texts at once: packed into whole numbers, sorted and counted.

The work of a task on Arrow batches. A character is its rank among those of the strip of texts at hand, so
that n-grams and the place of their text fit 64 bits; where they do not, numbers of any size are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are counted together, unless a single text has more.
STRIP = 1 << 18


def strips(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut before the text that would take them over ``STRIP`` bytes; no text is cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes.astype(np.int64)), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + STRIP, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Counted:
    """The n-grams of ``low`` to ``high`` characters in a strip of texts, with their counts by text.

    ``keys`` rise, and rise by text (``rows``) where they are equal. Null texts have no n-grams.
    """

    def __init__(self, texts: list[str | None], low: int, high: int):
        texts, self.high = [t or "" for t in texts], high
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        row, end = np.repeat(np.arange(len(texts)), lengths), np.repeat(np.cumsum(lengths), lengths)
        self.rank = np.zeros(0x110000, np.int64)
        self.rank[codes] = 1
        self.letters = np.flatnonzero(self.rank)
        self.rank[self.letters] = np.arange(1, len(self.letters) + 1)
        # Ranks begin at 1, so an n-gram is no other one of fewer characters.
        self.bits, at = len(self.letters).bit_length(), len(texts).bit_length()
        self.kind = np.uint64 if high * self.bits + at <= 64 else object
        ranks, rows = self.rank[codes].astype(self.kind), row.astype(self.kind)
        found, key = [], ranks
        for n in range(1, high + 1):
            if n > 1:
                key = (key[:-1] << self._shift(self.bits)) | ranks[n - 1 :]
            if n >= low and len(key):
                inside = np.flatnonzero(np.arange(len(key)) + n <= end[: len(key)])
                found.append((key[inside] << self._shift(at)) | rows[inside])
        every = np.concatenate(found) if found else np.empty(0, self.kind)
        both, self.counts = np.unique(every, return_counts=True)
        self.keys = both >> self._shift(at)
        self.rows = (both & self._shift((1 << at) - 1)).astype(np.int64)

    def _shift(self, n: int):
        return n if self.kind is object else np.uint64(n)

    def totals(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Every n-gram with its count in the strip and the number of texts that have it."""
        if not len(self.keys):
            return [], np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.flatnonzero(np.append(True, self.keys[1:] != self.keys[:-1]))
        sums, texts = np.add.reduceat(self.counts, first), np.diff(np.append(first, len(self.keys)))
        own, mask = self.keys[first], self._shift((1 << self.bits) - 1)
        letters = np.append(0, self.letters).astype(np.uint32)
        ranks = np.stack([((own >> self._shift(self.bits * j)) & mask).astype(np.int64) for j in range(self.high)][::-1], axis=1)
        text = letters[ranks[ranks > 0]].tobytes().decode("utf-32-le")
        stops = np.cumsum((ranks > 0).sum(axis=1)).tolist()
        return [text[a:b] for a, b in zip([0, *stops], stops)], sums.astype(np.int64), texts.astype(np.int64)

    def entries(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, index in ``terms``, count) by text and index, of those n-grams that are in ``terms``."""
        codes = np.zeros((len(terms), self.high), np.int64)
        for i, t in enumerate(terms):
            codes[i, self.high - len(t) :] = [ord(c) for c in t]
        # Characters before a shorter term count as none, also where a text has the zero character.
        held = np.arange(self.high)[None, :] >= self.high - np.array([len(t) for t in terms])[:, None]
        ranks = np.where(held, self.rank[codes], 0)
        known = np.flatnonzero(((ranks > 0) | ~held).all(axis=1))
        if not len(known) or not len(self.keys):
            return (np.empty(0, np.int64),) * 3
        keys = np.zeros(len(known), self.kind)
        for j in range(self.high):
            keys = (keys << self._shift(self.bits)) | ranks[known, j].astype(self.kind)
        order = np.argsort(keys)
        place = np.minimum(np.searchsorted(keys[order], self.keys), len(known) - 1)
        hit = np.flatnonzero(keys[order][place] == self.keys)
        index, row = known[order[place[hit]]], self.rows[hit]
        by = np.lexsort((index, row))
        return row[by], index[by], self.counts[hit][by]


def totals_of(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of ``_text`` to (term, cf, df), one row of a term for each strip."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strip in strips(batches, "_text"):
            terms, cf, df = Counted(strip.column("_text").to_pylist(), low, high).totals()
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(cf), pa.array(df)], ["term", "cf", "df"])

    return work


def weights_of(vocab: list[tuple[str, int]], n_docs: int, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of (doc_id, ``_text``) to (doc_id, i, w): indices in ``vocab`` (term, df), and their
    weights: counts times smoothed IDF, then unit length."""
    terms = [t for t, _ in vocab]
    idf = np.array([math.log((1 + n_docs) / (1 + df)) + 1 for _, df in vocab])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strip in strips(batches, "_text"):
            row, index, count = Counted(strip.column("_text").to_pylist(), low, high).entries(terms)
            weight = count * idf[index]
            norm = np.sqrt(np.bincount(row, weight * weight, strip.num_rows))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=strip.num_rows))), pa.int32())
            i = pa.ListArray.from_arrays(ends, pa.array(index, pa.int32()))
            w = pa.ListArray.from_arrays(ends, pa.array(weight / norm[row], pa.float64()))
            yield pa.RecordBatch.from_arrays([strip.column("doc_id"), i, w], ["doc_id", "i", "w"])

    return work
