"""Byte-pair encoding and decoding of whole texts with a given public vocabulary.

Texts are cut in pieces at white space and the pieces in words by the vocabulary's pattern. Words
that a worker has not met are merged together: all their symbols stand in one flat array, and each
round finds the rank of every adjacent pair by binary search over sorted pair keys, takes the
lowest rank of each word and merges its places. Pieces already known are looked up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from quillmark.llm.common import slices, strips

#: Unicode white space, and the pattern of the byte-level vocabularies over it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+"
    r"|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + "]+"
)
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Bounds of a worker's memory: bytes of text and id lists at a time, pieces remembered, and the
#: length of a remembered piece.
STRIP = 1 << 18
TEXTS = 500
REMEMBERED = 200_000
SHORT = 48
NO_RANK = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """Byte of each letter that stands for it in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, letters = data["model"], _byte_letters()
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", []) if t["content"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        lengths = np.fromiter(map(len, self.bytes), np.int64, self.size)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.known: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            same = word[:-1] == word[1:]
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            start = np.flatnonzero(np.append(True, ~same))
            size = np.diff(np.append(start, len(symbols)))
            least = np.minimum.reduceat(rank, start)
            live = np.repeat(least < NO_RANK, size)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_words.append(word[~live])
            hit = live & (rank == np.repeat(least, size))
            place = np.flatnonzero(hit)
            if not len(place):
                break
            # In a run of overlapping hits every second one is merged, from the left.
            fresh = np.append(True, np.diff(place) > 1)
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - head) % 2 == 0]
            symbols[place] = self.merged[rank[place]]
            live[place + 1] = False
            symbols, word = symbols[live], word[live]
        if not done_symbols:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def learn(self, pieces: list[str], known: dict[str, bytes]) -> None:
        """Encode new pieces, their distinct words all at once."""
        cuts = [self.words.findall(p) for p in pieces]
        distinct = list(dict.fromkeys(w for cut in cuts for w in cut))
        ids, counts = self.merge([w.encode("utf-8", "replace") for w in distinct])
        ends = np.cumsum(counts) * 4
        raw = ids.astype("<i4").tobytes()
        code = {w: raw[e - 4 * n : e] for w, e, n in zip(distinct, ends.tolist(), counts.tolist())}
        for piece, cut in zip(pieces, cuts):
            known[piece] = b"".join([code[w] for w in cut])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text; strings of added tokens become those tokens; null is empty."""
        parts: list[list] = []
        for text in texts:
            row: list = []
            for k, run in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
                row.append(self.special[run] if k % 2 else PIECES.findall(run))
            parts.append(row)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        wanted = {p for row in parts for run in row if isinstance(run, list) for p in run}
        new = [p for p in wanted if p not in self.known]
        self.learn([p for p in new if len(p) <= SHORT], self.known)
        known = self.known
        if long := [p for p in new if len(p) > SHORT]:
            self.learn(long, known := dict(known))
        out = []
        for row in parts:
            raw = [
                b"".join([known[p] for p in run]) if isinstance(run, list) else np.int32(run).astype("<i4").tobytes()
                for run in row
            ]
            out.append(np.frombuffer(b"".join(raw), "<i4"))
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists that stand in one flat array; bytes that are no text are replaced."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.flat[np.arange(total) + np.repeat(self.starts[ids] - (ends - lengths), lengths)].tobytes()
        cuts = np.append(0, ends)[offsets]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _as_lists(found: list[np.ndarray]) -> pa.ListArray:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.concatenate(found) if found else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat.astype(np.int32)))


def _replace(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    i = batch.schema.get_field_index(name)
    columns = [*batch.columns]
    names = [*batch.schema.names]
    if i >= 0:
        columns[i] = values
    else:
        columns, names = [*columns, values], [*names, name]
    return pa.RecordBatch.from_arrays(columns, names)


def _with_column(docs: DataFrame, name: str, kind) -> StructType:
    kept = [f for f in docs.schema.fields]
    field = StructField(name, kind)
    if name in docs.columns:
        return StructType([field if f.name == name else f for f in kept])
    return StructType([*kept, field])


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of whole texts as array<int>; a column named ``out`` is replaced.

    ``path`` is the vocabulary file, present on every executor. Null and empty texts have no ids.
    Rows are independent: repeated rows stay, an empty table stays empty, texts of any length are
    encoded whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in strips(batches, text, STRIP):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield _replace(batch, out, _as_lists(words.encode(texts)))

    return docs.mapInArrow(run, _with_column(docs, out, ArrayType(IntegerType(), True)))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of token ids; null ids give an empty text; special tokens are not skipped."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices(batches, TEXTS):
            column = batch.column(batch.schema.get_field_index(ids))
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = words.decode(column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)).astype(np.int64))
            yield _replace(batch, out, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, _with_column(docs, out, StringType()))


def round_trip(
    docs: DataFrame, path: str, keep: list[str], text: str = "text", ids: str = "ids", decoded: str | None = "decoded",
    exact: str | None = None,
) -> DataFrame:
    """The columns ``keep``, the token ids of whole texts, and what they decode to, in one pass.

    ``decoded`` names the column of the decoded text, ``exact`` that of whether it is the text; either
    may be left out. A worker holds about 256 KB of text, or one longer text, at a time, with its ids.
    Null texts are empty: no ids, an empty decoded text, exact. Repeated rows stay, an empty table
    stays empty; none of ``keep`` may have the name of an added column.
    """
    added = [(ids, ArrayType(IntegerType(), True)), (decoded, StringType()), (exact, BooleanType())]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(n, t) for n, t in added if n])
    # The text last, so that a kept column of its name is found first.
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in strips(batches, "_text", STRIP):
            texts = batch.column(len(keep)).to_pylist()
            found = words.encode(texts)
            offsets = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))
            back = words.decode(np.concatenate(found) if found else np.empty(0, np.int32), offsets)
            columns = [batch.column(i) for i in range(len(keep))] + [_as_lists(found)]
            if decoded:
                columns.append(pa.array(back, pa.string()))
            if exact:
                columns.append(pa.array([a == (b or "") for a, b in zip(back, texts)]))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
