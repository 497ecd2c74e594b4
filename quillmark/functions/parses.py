"""The parse that the catalogue gives to texts, for strips of texts at once.

Words are those between white space, a sentence ends after a word of 7, 14, ... characters, and the lengths of
words give the root and the heads, which lead towards it. Texts of one id are one text whose words follow each
other by their number, those of equal number ending where their texts end together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are parsed together, unless an id has more.
STRIP = 1 << 21
FIELDS = {"parse_id": "long", "tok_id": "int", "head_id": "long", "word": "string", "start": "long", "end": "long"}
TYPE = f"array<struct<{', '.join(f'`{k}`: {t}' for k, t in FIELDS.items())}>>"
_ARROW = pa.struct([("parse_id", pa.int64()), ("tok_id", pa.int32()), ("head_id", pa.int64()), ("word", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _firsts(changes: np.ndarray) -> np.ndarray:
    """For each place the place of the last change up to it; the first place is one."""
    return np.maximum.accumulate(np.where(changes, np.arange(len(changes)), 0))


def _changes(*keys: np.ndarray) -> np.ndarray:
    changed = np.zeros(len(keys[0]), bool)
    changed[:1] = True
    for k in keys:
        changed[1:] |= k[1:] != k[:-1]
    return changed


def _strip(texts: pa.ListArray) -> pa.ListArray:
    flat, of = pc.list_flatten(texts), pc.list_parent_indices(texts).to_numpy()
    pieces = pc.split_pattern(flat, " ")
    words, text = pc.list_flatten(pieces), pc.list_parent_indices(pieces).to_numpy()
    length = pc.utf8_length(words).to_numpy().astype(np.int64)
    # A piece that ends a text is followed by one blank more than there is.
    upto = np.cumsum(length + 1)
    first = _firsts(_changes(text))
    stop = upto - 1 - (upto[first] - length[first] - 1) if len(upto) else upto
    kept = np.flatnonzero(length)
    text, size, stop = text[kept], length[kept], stop[kept]
    new = _changes(text)
    nth = np.arange(len(kept)) - _firsts(new)
    piece = np.where(new, stop, np.diff(stop, prepend=0))
    # Words of an id by their number; the words of equal number end at the sum of them all.
    group = of[text]
    order = np.lexsort((nth, group))
    kept, group, nth, size, piece = kept[order], group[order], nth[order], size[order], piece[order]
    begins = _firsts(_changes(group))
    total = np.cumsum(piece)
    last = np.append(_changes(group, nth)[1:], True) if len(group) else np.zeros(0, bool)
    peers = len(last) - 1 - _firsts(last[::-1])[::-1]
    end = total[peers] - (total - piece)[begins]
    ends = size % 7 == 0
    before = np.cumsum(ends) - ends
    parse = before - before[begins]
    opens = _firsts(_changes(group, parse))
    n = np.bincount(opens, minlength=len(opens))[opens]
    tok = np.arange(len(opens)) - opens + 1
    root = size[opens] % np.maximum(n, 1) + 1
    head = np.where(tok < root, tok + 1 + size % np.maximum(root - tok, 1), tok - 1 - size % np.maximum(tok - root, 1))
    head[tok == root] = 0
    columns = [pa.array(parse), pa.array(tok, pa.int32()), pa.array(head), words.take(pa.array(kept)), pa.array(end - size), pa.array(end)]
    each = pa.StructArray.from_arrays(columns, fields=list(_ARROW))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(group, minlength=len(texts)))), pa.int32()), each)


def edges_of(texts: pa.ListArray) -> pa.Array:
    """The edges of each id, from arrays of its texts, in which a blank is the only white space."""
    sizes = pc.fill_null(pc.binary_length(pc.list_flatten(texts)), 0).to_numpy().astype(np.int64)
    bytes_ = np.bincount(pc.list_parent_indices(texts).to_numpy(), sizes, len(texts))
    ends, start, parts = np.cumsum(bytes_), 0, []
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + STRIP, "right")))
        parts.append(_strip(texts.slice(start, stop - start)))
        start = stop
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_ARROW))
