"""The corpus pipeline: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, lines, mixing, simhash, toxicity
from quillmark.llm.common import Stored
from quillmark.llm.queries import vocabulary_path
from quillmark.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model learns from ``labels``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_ordinary(docs, model, threshold=0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their duplicate lines."""
    return lines.drop_duplicate_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: three words a shingle, two bits at most."""
    return simhash.keep_first(docs, size=3, distance=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in its order."""
    return mixing.mixture(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and whether decoding gives the text back."""
    rows = bpe.round_trip(docs, vocabulary_path(), ["doc_id", "source"], decoded=None, exact="round_trip")
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: Compression, signatures, merges and seeded draws have no SQL; tests check each stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = Stored(stage(spark, docs, sf_dir), f"stage-{name}").df
    return docs
