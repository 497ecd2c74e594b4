"""Roll sentence rows up to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXTS = ["sentence", "pos", "lemmas"]


def _roll(df: DataFrame, keys: list[str], order: str, aggregates: dict, texts: list[str]) -> DataFrame:
    """One grouping by the keys and one row per key: texts joined in order, numbers folded.

    ``aggregates``: output name -> (column, "mean" | "sum" | "first").
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    aggs = []
    for t in texts:
        value = F.array_join(t, " ") if dict(df.dtypes)[t].startswith("array") else F.col(t)
        items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
        aggs.append(F.array_join(F.transform(items, lambda x: x["v"]), " ").alias(t))
    for out, (col, kind) in aggregates.items():
        if kind == "first":
            present = F.when(F.col(col).isNotNull(), F.struct(F.col(order).alias("o"), F.col(col).alias("v")))
            aggs.append(F.min(present)["v"].alias(out))
        else:
            fold = F.sum if kind == "sum" else F.avg
            aggs.append(fold(F.col(col).cast("double")).alias(out))
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_sentences"))


def rollup_mean(
    df: DataFrame, keys: list[str], metrics: list[str], order: str = "sent_id", texts: list[str] = TEXTS
) -> DataFrame:
    """Ordered text joins and the mean of every metric; null keys are dropped."""
    return _roll(df, keys, order, {m: (m, "mean") for m in metrics}, texts)


def rollup_sum(
    df: DataFrame, keys: list[str], metrics: list[str], order: str = "sent_id", texts: list[str] = TEXTS
) -> DataFrame:
    """As ``rollup_mean``, but the first non-null ``document_ttr`` and the sum of ``balanced``."""
    aggregates = {m: (m, "mean") for m in metrics}
    aggregates |= {"document_ttr": ("document_ttr", "first"), "balanced": ("balanced", "sum")}
    return _roll(df, keys, order, aggregates, texts)


def rollup_all(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row of means over everything; a metric that is not there counts as 0."""
    return df.agg(
        F.count(F.lit(1)).alias("n_sentences"),
        *[
            (F.avg(F.col(m).cast("double")) if m in df.columns else F.lit(0.0)).alias(m)
            for m in metrics
        ],
    )


def metric_matrix(df: DataFrame, metrics: list[str], keep_balance: bool = False) -> DataFrame:
    """The metric columns; ``balanced`` becomes 0 or 1 by truncation unless kept."""
    cols = [
        F.col(m).cast("int").alias(m) if m == "balanced" and not keep_balance else F.col(m)
        for m in metrics
    ]
    return df.select("doc_id", *cols)


def size_report(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
