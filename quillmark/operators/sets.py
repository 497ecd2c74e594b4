"""Concatenation and positional pairing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.scale import number_rows


def concat_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_by_position(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column position, named as the first; a width mismatch fails."""
    widths = {len(f.columns) for f in frames}
    if len(widths) != 1:
        raise ValueError(f"frames have different numbers of columns: {sorted(widths)}")
    return reduce(lambda a, b: a.union(b), frames)


def positional_zip(
    left: DataFrame, left_order: str, left_bucket: Column,
    right: DataFrame, right_order: str, right_bucket: Column,
) -> DataFrame:
    """Pair the i-th row of one frame with the i-th of the other; the shorter one decides."""
    a = number_rows(left, [], [F.col(left_order)], left_bucket, "position")
    b = number_rows(right, [], [F.col(right_order)], right_bucket, "position")
    return a.join(b, "position")
