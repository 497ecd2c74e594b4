"""Valence of many texts at once: words looked up in a lexicon, and the rules of ``polarity`` summed up.

The work of a task on Arrow batches. Words of a strip of texts are numbered, each different word is looked
up once, and the rules run over all words of the strip together, with the same numbers in the same order as
the expressions of ``polarity``. What comes back are sums, which the expressions then squash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmark.functions import constants as K
from quillmark.functions.polarity import CONTRACTED_NOT

#: Bytes of text that are scored together, unless a single text has more.
STRIP = 1 << 21
#: The word that stands between two sentences.
BREAK = "\n"
SUMS = pa.struct([("total", pa.float64()), ("sums", pa.list_(pa.float64()))])

_UP, _DOWN, _NOT = frozenset(K.BOOSTERS_UP), frozenset(K.BOOSTERS_DOWN), frozenset(K.NEGATIONS)


class Lexicon:
    """Terms with their scores, and for each first word the numbers of words, two or more, of terms that begin so."""

    def __init__(self, terms: Iterable[tuple[str, float, int]]):
        self.scores, sizes = {}, {}
        for term, score, size in terms:
            self.scores[term] = score
            if size > 1:
                sizes.setdefault(term.partition(" ")[0], set()).add(size)
        self.sizes = {first: sorted(found, reverse=True) for first, found in sizes.items()}


def _boost(word: str) -> float:
    return K.BOOST if word in _UP else -K.BOOST if word in _DOWN else 0.0


class Items:
    """Words and terms of a strip, in order, with the sentence and the text (numbered from 0) that each stands in."""

    def __init__(self, plain: pa.Array, low: pa.Array, up: pa.Array, lexicon: Lexicon):
        plain, lows, up = (pc.list_flatten(found) for found in (pc.split_pattern(a, " ") for a in (plain, low, up)))
        text = pc.list_parent_indices(pc.split_pattern(low, " ")).to_numpy()
        breaks = pc.equal(lows, BREAK).to_numpy(zero_copy_only=False)
        sentence = text + np.cumsum(breaks)
        self.sentences = 1 + np.bincount(text[breaks], minlength=len(low))
        # Words of one character are dropped, and with them the breaks.
        long = pc.greater(pc.utf8_length(plain), 1)
        shout = pc.and_(pc.not_equal(plain, lows), pc.equal(plain, up)).filter(long).to_numpy(zero_copy_only=False)
        words = lows.filter(long).dictionary_encode()
        kept, codes = long.to_numpy(zero_copy_only=False), words.indices.to_numpy()
        text, sentence, words = text[kept], sentence[kept], words.dictionary.to_pylist()
        score = [lexicon.scores.get(w) for w in words]
        known, value = np.array([s is not None for s in score], bool)[codes], np.array([s or 0.0 for s in score], float)[codes]
        degree, but = np.array([w in _UP or w in _DOWN for w in words], bool)[codes], np.array([w == "but" for w in words], bool)[codes]
        shouted, covered = shout.copy(), np.zeros(len(codes), bool)
        # Terms of several words: the longest at a place, from left to right; what one covers begins no other.
        begins = np.flatnonzero(np.array([w in lexicon.sizes for w in words], bool)[codes])
        stops, end = np.searchsorted(sentence, sentence[begins], "right"), 0
        for i, stop in zip(begins.tolist(), stops.tolist()):
            if i < end or i + 2 > stop:
                continue
            for n in lexicon.sizes[words[codes[i]]]:
                if i + n > stop:
                    continue
                term = " ".join([words[c] for c in codes[i : i + n]])
                if term in lexicon.scores:
                    end = i + n
                    known[i], value[i], degree[i], but[i] = True, lexicon.scores[term], term in _UP or term in _DOWN, False
                    shouted[i], covered[i + 1 : end] = shout[i:end].all(), True
                    break
        left = ~covered
        boost, negates = np.array([_boost(w) for w in words], float)[codes], np.array([w in _NOT or CONTRACTED_NOT in w for w in words], bool)[codes]
        self.text, self.sentence = text[left], sentence[left]
        self.known, self.value, self.degree, self.but = known[left], value[left], degree[left], but[left]
        self.shout, self.boost, self.negates = shouted[left], boost[left], negates[left]

    def sums(self, group: np.ndarray, n: int) -> np.ndarray:
        """The weighed scores of each of ``n`` groups, whose numbers rise, added up in order."""
        at = np.flatnonzero(self.known & ~self.degree)
        own, start = group[at], np.searchsorted(group, group[at])
        shouts, size = np.bincount(group, self.shout, n), np.bincount(group, minlength=n)
        mixed = (shouts >= 1) & (shouts <= size - 1)
        score = self.value[at]
        sign = np.where(score < 0, -1.0, 1.0)
        score = score + np.where(mixed[own] & self.shout[at], sign * K.CAPS_BOOST, 0.0)
        for back, damping in enumerate(K.DAMPING, start=1):
            before = np.maximum(at - back, 0)
            counts = (at - back >= start) & ~self.known[before]
            score = score + np.where(counts, sign * self.boost[before] * damping, 0.0)
            score = score * np.where(counts & self.negates[before], K.NEGATION, 1.0)
        turn, buts = np.full(n, -1), np.flatnonzero(self.but)[::-1]
        turn[group[buts]] = buts
        turn = turn[own]
        weight = np.where((turn < 0) | (at == turn), 1.0, np.where(at < turn, 0.5, 1.5))
        return np.bincount(own, score * weight, n).astype(float)


def _strips(low: pa.Array) -> Iterator[tuple[int, int]]:
    """Places of texts that are scored together: cut before the text that would take them over ``STRIP`` bytes."""
    ends, start = np.cumsum(pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < len(low):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + STRIP, "right")))
        yield start, stop
        start = stop


def sums_of(plain: pa.Array, low: pa.Array, up: pa.Array, lexicon: Lexicon) -> pa.Array:
    """struct<total, sums>: the sum of each text, and of each of its sentences.

    Words stand between blanks, as they are written, in lower and in upper case; ``BREAK`` is the word
    between two sentences. An empty text has one empty sentence.
    """
    parts = []
    for start, stop in _strips(low):
        strip = Items(*(a.slice(start, stop - start) for a in (plain, low, up)), lexicon)
        ends = np.append(0, np.cumsum(strip.sentences))
        each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(strip.sums(strip.sentence, int(ends[-1]))))
        parts.append(pa.StructArray.from_arrays([pa.array(strip.sums(strip.text, stop - start)), each], fields=list(SUMS)))
    return pa.concat_arrays(parts) if parts else pa.array([], SUMS)
