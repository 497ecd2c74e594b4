"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources.shared import Stored, new_path  # noqa: F401

#: White space of the word rule [^\x20\x09-\x0D]+, as a Java character class and as characters.
BLANKS = r"[ \t-\r]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where a lambda uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that none clashes with the names of a plan."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that a task holds few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def strips(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut before the text that would take them over ``most`` bytes; no text is cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes.astype(np.int64)), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept away from training: crc32 of its text mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
