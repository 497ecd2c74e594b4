"""Assembly of labelled corpora from conversations, documents, tokens and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.constants import CODE_EXTENSIONS
from quillmark.functions.patterns import NOT_WS
from quillmark.operators import sampling, sets
from quillmark.operators.labels import label_of
from quillmark.plans import prose, source_code


def from_conversations(turns: DataFrame, **options) -> DataFrame:
    """Every non-null turn of chat logs as a machine document."""
    texts = turns.where(F.col("text").isNotNull()).select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text"
    )
    return prose.annotate_documents(texts, F.lit("LLM"), **options)


def human_texts(sources: dict[str, DataFrame], per_source: int, seed: int) -> DataFrame:
    """Union of seeded samples of each source of (doc_id, text); blank texts are left out."""
    picked = [
        sampling.sample_groups(
            df.where(F.col("text").rlike(NOT_WS)).select("doc_id", "text", F.lit(name).alias("source")),
            ["source"], "doc_id", per_source, seed,
        )
        for name, df in sources.items()
    ]
    return sets.concat_by_name(picked)


def from_human_sources(sources: dict[str, DataFrame], per_source: int, seed: int, **options) -> DataFrame:
    return prose.annotate_documents(human_texts(sources, per_source, seed), F.lit("HUMAN"), **options)


def human_code(files: DataFrame, per_language: int) -> DataFrame:
    """First rows of each language, annotated as human source."""
    taken = sampling.take_per_group(files, "lang", "doc_id", per_language)
    return source_code.profile(taken, F.lit("HUMAN"))


def paired(machine: DataFrame, human: DataFrame, seed: int, **options) -> DataFrame:
    """Balanced and annotated pair of (doc_id, text[, source]) tables in one labelled table."""
    both = sampling.balanced_pair(machine, human, "source", "doc_id", seed)
    return prose.annotate_documents(both, F.col("label"), **options)


def split_manifest(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files (path, text) joined with a manifest (path, is_ai): prose, code and rejects."""
    named = files.join(manifest, "path").withColumns(
        {
            "lang": F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)),
            "label": label_of(F.col("is_ai")),
        }
    )
    is_prose = F.col("lang") == "txt"
    is_code = F.col("lang").isin(CODE_EXTENSIONS)
    return named.where(is_prose), named.where(is_code), named.where(~is_prose & ~is_code)
