"""Hook for a tagger, parser or analyser of one's own, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Annotator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def annotate_with(df: DataFrame, columns: list[str], annotator: Annotator, schema: str) -> DataFrame:
    """Send only ``columns`` to the annotator, which sees an iterator of batches per task, so a
    model is loaded once per worker; ``schema`` declares its output."""
    return df.select(*columns).mapInPandas(annotator, schema)
