"""Quality by nearest-neighbour voting among labelled documents in a latent semantic space.

Terms of a text are its byte pairs, the shapes of its words and whether a word repeats the one
before. Term weights of a bounded labelled sample give a truncated singular value decomposition;
its labelled vectors are broadcast, and each document, whole, is compared with all of them by
blocked cosine products. The nearest vote with their similarity as weight.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.toxicity import sample

#: Documented bounds: labelled rows of each class, and bytes of text of each class.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 24 << 20
PAIRS, SHAPES, REPEATS = 2048, 512, 1
TERMS = PAIRS + SHAPES + REPEATS
DIMENSIONS = 48
NEIGHBOURS = 15
#: Documents compared with all labelled vectors at a time, and bytes counted at a time.
BLOCK = 256
BYTES = 1 << 22
#: Weight of the events of repeated words and word shapes beside byte pairs.
EMPHASIS = 3.0


def _classes() -> np.ndarray:
    """Class of each byte in a word's shape: lower, upper, digit, blank, other by value, non-ASCII."""
    out = np.arange(256) % 16 + 4
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 3
    return out


CLASSES = _classes()
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def counts(text: str | None) -> np.ndarray:
    """Term counts of a whole text, counted in pieces that end at a blank where there is one."""
    out = np.zeros(TERMS)
    data = (text or "").encode("utf-8", "replace")
    last, start = np.uint64(0), 0
    while start < len(data):
        end = min(len(data), start + BYTES)
        if end < len(data):
            end = max(data.rfind(b" ", start + 1, end), data.rfind(b"\n", start + 1, end)) + 1 or end
        last = _count(np.frombuffer(data[start:end], np.uint8), last, out)
        start = end
    return out


def _count(a: np.ndarray, last: np.uint64, out: np.ndarray) -> np.uint64:
    if len(a) > 1:
        pair = _mix(a[:-1].astype(np.uint64) << np.uint64(8) | a[1:]) >> np.uint64(53)
        out[:PAIRS] += np.bincount(pair.astype(np.int64), minlength=PAIRS)
    blank = BLANK[a]
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    if not len(starts):
        return last
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    # Two sums over each word: of its bytes by place, and of the classes of its bytes as a set.
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(a)) - starts[np.maximum(np.searchsorted(starts, np.arange(len(a)), "right") - 1, 0)]
    code = _mix((a.astype(np.uint64) + np.uint64(1)) * (np.uint64(2) * np.abs(place).astype(np.uint64) + np.uint64(1)))
    sums = np.append(np.uint64(0), np.cumsum(np.where(blank, np.uint64(0), code), dtype=np.uint64))
    word = sums[ends] - sums[starts]
    classes = np.bitwise_or.reduceat(np.where(blank, 0, 1 << CLASSES[a]), starts)
    shape = _mix(classes.astype(np.uint64) * np.uint64(8) + np.minimum(ends - starts, 28).astype(np.uint64) // np.uint64(4)) >> np.uint64(55)
    out[PAIRS : PAIRS + SHAPES] += np.bincount(shape.astype(np.int64), minlength=SHAPES)
    out[-1] += np.count_nonzero(word == np.append(last, word[:-1]))
    return word[-1]


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Relative frequencies, dampened, by inverse document frequency, to unit length."""
    rate = np.sqrt(rows / np.maximum(rows[:, :PAIRS].sum(axis=1, keepdims=True), 1)) * idf
    rate[:, PAIRS:] *= EMPHASIS
    norm = np.linalg.norm(rate, axis=1, keepdims=True)
    return (rate / np.where(norm > 0, norm, 1)).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 1e-6, norm, 1)


@dataclass
class Model:
    """Term weights, latent axes, unit vectors of the labelled rows and their labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), BLOCK):
            rows = weighted(np.stack([counts(t) for t in texts[i : i + BLOCK]]), self.idf)
            cosine = _unit(rows @ self.axes) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4 + 1e-9
            out[i : i + BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
            empty = ~rows.any(axis=1)
            out[i : i + BLOCK][empty] = self.prior
        return out


def _axes(table: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    found = np.random.default_rng(0).standard_normal((TERMS, dimensions + 16)).astype(np.float32)
    for _ in range(12):
        found, _ = np.linalg.qr(table.T @ (table @ found))
    _, values, axes = np.linalg.svd(table @ found, full_matrices=False)
    return (found @ axes.T)[:, :dimensions][:, values[:dimensions] > 1e-4].astype(np.float32)


def fit(rows: list[tuple[str | None, int]], dimensions: int = DIMENSIONS) -> Model:
    """Model of (text, 0 or 1) rows; without rows every score is 0.5."""
    if not rows:
        return Model(np.ones(TERMS), np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), 0.5)
    found = np.stack([counts(t) for t, _ in rows]).astype(np.float32)
    idf = np.log((1 + len(rows)) / (1 + (found > 0).sum(axis=0))) + 1
    table = weighted(found, idf)
    axes = _axes(table, dimensions)
    labels = np.array([y for _, y in rows], float)
    return Model(idf, axes, _unit(table @ axes).astype(np.float32), labels, float(labels.mean()))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of labelled rows; ``labels``: doc_id, quality (0 or 1)."""
    return fit(sample(docs, labels, "quality", rows, most_bytes))


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from the text alone.

    Null and empty texts, which have no vector, get the share of label 1 in the sample. Repeated
    rows are scored alike and stay repeated, null ids stay, other columns are not looked at, and an
    empty table gives an empty result. What is broadcast is bounded by the sample's rows.
    """
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pickle.loads(packed.value)
        for texts in batches:
            yield pd.Series(own.scores(texts.tolist()), dtype="float64")

    return docs.select(F.col(doc_id).alias("doc_id"), score(F.col(text)).alias("score"))
