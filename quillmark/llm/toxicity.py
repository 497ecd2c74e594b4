"""Toxicity by compression distance between zstandard dictionaries.

One dictionary is trained on ordinary text, two on the stretches of toxic text whose byte grams are
more frequent in toxic documents than in ordinary ones: one of stretches that ordinary text hardly
has, one of weaker marks. A window (a word between blanks) is compressed with each; where a toxic
dictionary gives a shorter result than the ordinary one by its threshold, the window is a hit. The
log-likelihood of a document's hits against its number of words, under the rates of toxic and of
ordinary documents, is its evidence; a monotone table, calibrated on labelled documents that no
dictionary has seen, turns it into a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from math import floor, log
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import held_out

#: Documented bounds of the labelled sample: rows of each class, and bytes of text of each class.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 24 << 20
#: Of both toxic dictionaries: bytes of a gram, least ratio of its frequencies, bytes of the
#: dictionary, least gain of a window, and standard errors beyond which a gram counts.
STRONG, WEAK = (5, 20.0, 2048, 3, 4.0), (7, 5.0, 6144, 2, 6.0)
ORDINARY_BYTES = 16384
#: Shortest match of the encoder; evidence beyond these bounds shares their table entries.
MATCH = 5
LEAST, MOST = -10, 30
WINDOW = 64
#: Texts whose windows are compressed together, and windows whose gains a worker remembers.
BLOCK = 200
REMEMBERED = 300_000
#: A phrase in both dictionaries, before each window, pays for the frame; the bytes after it let the
#: encoder match up to the end of the window.
PRIMER, TAIL = bytes(range(128, 168)), bytes(range(170, 182))
END = b"\x00"


def _normal(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").encode("utf-8", "replace").lower().split()) + b" "


def _grams(data: bytes, gram: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(a) - gram + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(gram if n > 0 else 0):
        out = out << np.uint64(8) | a[i : n + i]
    return out


def _document_frequency(texts: list[bytes], gram: int) -> tuple[np.ndarray, np.ndarray]:
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(np.concatenate([np.unique(_grams(t, gram)) for t in texts]), return_counts=True)


def _marks(toxic: list[bytes], ordinary: list[bytes], gram: int, ratio: float, errors: float) -> np.ndarray:
    """Grams that toxic texts have far more often than ordinary ones."""
    grams, hits = _document_frequency(toxic, gram)
    known, others = _document_frequency(ordinary, gram)
    other = np.zeros(len(grams))
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        other = np.where(known[at] == grams, others[at], 0)
    n1, n0 = max(1, len(toxic)), max(1, len(ordinary))
    p1, p0, p = hits / n1, other / n0, (hits + other + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return grams[(z > errors) & (p1 / (p0 + 1 / n0) > ratio)]


def _marked(text: bytes, marks: np.ndarray, gram: int) -> np.ndarray:
    """Bytes of a text that lie in a marked gram, and one more that does not."""
    covered = np.zeros(len(text) + 1, bool)
    places = np.flatnonzero(np.isin(_grams(text, gram), marks))
    for i in range(gram):
        covered[places + i] = True
    return covered


def _stretches(texts: list[bytes], marks: np.ndarray, gram: int) -> list[bytes]:
    found = []
    for text in texts:
        edges = np.flatnonzero(np.diff(_marked(text, marks, gram).astype(np.int8), prepend=0))
        found += [text[a:b] + END for a, b in zip(edges[::2], edges[1::2])]
    return found


def _train(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary; too few samples for the trainer serve as they are."""
    if not samples:
        return b""
    try:
        return zstd.train_dictionary(size, samples, k=32, d=6, dict_id=1).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    parameters = zstd.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=16, search_log=5, min_match=MATCH, target_length=64,
        strategy=zstd.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    words = zstd.ZstdCompressionDict(content + PRIMER, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=words, compression_params=parameters)


def _lengths(compressor: zstd.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    if not windows:
        return np.empty(0, np.int64)
    sizes = np.fromiter(map(len, windows), np.uint64, len(windows)) + np.uint64(len(PRIMER) + len(TAIL) + 2)
    segments = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype(np.uint64)
    data = PRIMER + b" " + (b" " + TAIL + PRIMER + b" ").join(windows) + b" " + TAIL
    packed = compressor.multi_compress_to_buffer(zstd.BufferWithSegments(data, segments.tobytes()))
    return np.fromiter(map(len, packed), np.int64, len(windows))


def _windows(text: str | None) -> list[bytes]:
    """Windows of a whole text: its words, long ones cut in consecutive pieces."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if max(map(len, found), default=0) <= WINDOW:
        return found
    return [w[i : i + WINDOW] for w in found for i in range(0, len(w), WINDOW)]


@dataclass
class Model:
    """The dictionaries, rates of strong and weak hits per word in toxic and in ordinary documents,
    and the score of each whole number of evidence from ``LEAST`` to ``MOST``."""

    strong: bytes
    weak: bytes
    ordinary: bytes
    rates: tuple[tuple[float, float], tuple[float, float]]
    levels: list[float]

    def open(self) -> "Model":
        names = (self.strong, self.weak, self.ordinary, self.weak + self.strong)
        self._strong, self._weak, self._ordinary, self._both = map(_compressor, names)
        # Length beyond its own of a window in which nothing matches.
        self._frame = int(_lengths(self._both, [bytes(range(1, 6))])[0]) - 5
        self._known: dict[bytes, int] = {}
        return self

    def kinds(self, windows: list[bytes]) -> list[int]:
        """Of each window: 1 for a strong hit, 2 for a weak one, else 0."""
        out = np.zeros(len(windows), np.int64)
        raw = np.fromiter(map(len, windows), np.int64, len(windows)) + self._frame
        # A dictionary that does not shorten a window cannot beat the ordinary one.
        open_ = np.flatnonzero(raw - _lengths(self._both, windows) >= min(STRONG[3], WEAK[3]))
        rest = [windows[i] for i in open_]
        plain = _lengths(self._ordinary, rest)
        out[open_[plain - _lengths(self._weak, rest) >= WEAK[3]]] = 2
        out[open_[plain - _lengths(self._strong, rest) >= STRONG[3]]] = 1
        return out.tolist()

    def hits(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int, int]]:
        """Strong hits, weak hits and windows of each whole text."""
        texts = iter(texts)
        while block := list(islice(texts, BLOCK)):
            if len(self._known) > REMEMBERED:
                self._known.clear()
            known = self._known
            found = [_windows(t) for t in block]
            new = list(set().union(*found) - known.keys())
            known.update(zip(new, self.kinds(new)))
            for windows in found:
                kinds = list(map(known.__getitem__, windows))
                yield kinds.count(1), kinds.count(2), len(kinds)

    def weigh(self, strong: int, weak: int, n: int) -> int:
        """Log-likelihood ratio of hits in n windows, as a whole number in the table."""
        toxic, plain = self.rates
        gain = strong * log(toxic[0] / plain[0]) + weak * log(toxic[1] / plain[1])
        return max(LEAST, min(MOST, floor(gain - n * (sum(toxic) - sum(plain)))))

    def evidence(self, texts: Iterable[str | None]) -> Iterator[int]:
        return (self.weigh(*h) for h in self.hits(texts))

    def score(self, evidence: int) -> float:
        return self.levels[evidence - LEAST]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def _rising(rate: list[float], weight: list[float]) -> list[float]:
    """Pool adjacent violators: the closest table that never falls."""
    blocks: list[list[float]] = []
    for r, w in zip(rate, weight):
        blocks.append([r, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            r1, w1, n1 = blocks.pop()
            r0, w0, n0 = blocks.pop()
            blocks.append([(r0 * w0 + r1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return [r for r, _, n in blocks for _ in range(int(n))]


def _trained(toxic: list[str | None], plain: list[str | None]) -> Model:
    """Dictionaries of both classes. Ordinary text leaves out what is marked as toxic: a mark that
    it has by chance must not hide there; how often that happens is in the rates."""
    seen, marked = [_normal(t) for t in plain], [_normal(t) for t in toxic]
    strong, weak = (_marks(marked, seen, kind[0], kind[1], kind[4]) for kind in (STRONG, WEAK))
    rest = []
    for text in seen:
        gone = _marked(text, strong, STRONG[0]) | _marked(text, weak, WEAK[0])
        rest.append(np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes())
    return Model(
        _train(_stretches(marked, strong, STRONG[0]), STRONG[2]), _train(_stretches(marked, weak, WEAK[0]), WEAK[2]),
        _train([t[i : i + 256] for t in rest for i in range(0, len(t), 256)], ORDINARY_BYTES), ((1.0, 1.0), (1.0, 1.0)), [],
    ).open()


def fit(samples: list[tuple[str | None, int]]) -> Model:
    """Model of (text, 0 or 1) rows: two rows in three of a class train, the others calibrate.

    Rows are dealt in the order of a hash of their text, so that their own order does not matter.
    """
    dealt = sorted(samples, key=lambda s: crc32((s[0] or "").encode("utf-8", "replace")))
    classes = [[t for t, y in dealt if y == 1], [t for t, y in dealt if y == 0]]
    prior = (len(classes[0]) + 0.5) / (len(samples) + 1) if samples else 0.0
    model = _trained(*([t for i, t in enumerate(c) if i % 3] for c in classes))
    found = [np.array([(0, 0, 0), *model.hits(c[::3])]) for c in classes]
    toxic, plain = ((f[:, :2].sum(axis=0) + 0.5) / (f[:, 2].sum() + 1) for f in found)
    model.rates = (tuple(np.maximum(toxic, plain).tolist()), tuple(plain.tolist()))
    size = MOST - LEAST + 1
    counts = [np.bincount([model.weigh(*h) - LEAST for h in f[1:].tolist()], minlength=size) for f in found]
    weight = counts[0] + counts[1] + 0.02
    model.levels = [float(x) for x in _rising(list((counts[0] + 0.02 * prior) / weight), list(weight))]
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int) -> list[tuple[str | None, int]]:
    """Labelled rows outside the held-out quarter: of each class the first ``rows`` by a hash of
    the id, then as many of them as ``most_bytes`` allow; whole texts. Both bounds hold for the
    driver, and the ids that are broadcast are at most two times ``rows``."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max(label).alias("_y"))
    # Only ids, hashes and sizes are joined; texts are fetched for the chosen rows alone. A row is its
    # id and the hash of its text: texts that share an id are chosen, and counted, one by one.
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    each = sizes.join(marks, "doc_id").dropDuplicates(["doc_id", "_h"]).withColumn("_o", F.xxhash64(F.lit("sample"), "doc_id"))
    chosen: list[tuple[int, int, int]] = []
    for y in (0, 1):
        total = 0
        order = ["_o", "doc_id", "n", "_h"]
        for key in each.where(F.col("_y") == y).select(*order).orderBy(*order).limit(rows).collect():
            if total + key["n"] <= most_bytes:
                chosen.append((key["doc_id"], key["_h"], y))
                total += key["n"]
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, _h long, y int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text")
    found = found.join(F.broadcast(wanted), ["doc_id", "_h"]).groupBy("doc_id", "_h", "y").agg(F.min("text").alias("text"))
    return [(r["text"], r["y"]) for r in found.orderBy("doc_id", "_h").collect()]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of labelled rows; ``labels``: doc_id, toxic (0 or 1)."""
    return fit(sample(docs, labels, "toxic", rows, most_bytes))


def _score(docs: DataFrame, model: Model):
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pickle.loads(packed.value).open()
        for texts in batches:
            yield pd.Series([own.score(g) for g in own.evidence(texts)], dtype="float64")

    return score


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from the text alone.

    Null and empty texts have no window and get the score of no evidence. Repeated rows are scored
    alike and stay repeated, null ids stay, other columns are not looked at, and an empty table
    gives an empty result. Without labels of either kind the score is one constant.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), _score(docs, model)(F.col(text)).alias("score"))


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows whose score is below ``threshold``, with the columns of ``docs``."""
    return docs.where(_score(docs, model)(F.col("text")) < threshold)
