"""Annotation of source text: one row per snippet, all languages in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import arrays as A
from quillmark.functions import code as C
from quillmark.operators.scale import range_bucket


def profile(df: DataFrame, label: Column, src: str = "src", lang: str = "lang") -> DataFrame:
    """Lines, tokens, nodes, functions, name length, depth, control density and complexity."""
    language = F.col(lang)
    staged = (
        df.withColumn("_masked", C.masked(F.col(src), language))
        .withColumn("_tree", C.nesting(F.col("_masked"), language))
        .withColumn("loc", C.line_count(F.col(src), language))
        .withColumn("_names", C.name_lengths(F.col("_masked"), language))
        .withColumn("_fn", C.function_count(F.col("_masked"), language))
        .withColumn("n_tokens", C.token_count(F.col(src), language))
    )
    loc = F.col("loc")
    names = F.size("_names").cast("long")
    return staged.select(
        *[c for c in df.columns],
        "loc",
        "n_tokens",
        F.col("_tree.nodes").alias("n_nodes"),
        F.col("_fn").alias("n_functions"),
        A.mean_of(names, A.sum_long(F.col("_names"))).alias("avg_variable_length"),
        F.col("_tree.depth").alias("max_depth"),
        F.when(loc > 0, C.control_blocks(F.col("_masked"), language) / loc)
        .otherwise(F.lit(0.0))
        .alias("control_density"),
        F.when(F.col("_fn") > 0, (C.decision_points(F.col("_masked"), language) + F.col("_fn")) / F.col("_fn"))
        .otherwise(F.lit(0.0))
        .alias("complexity"),
        label.alias("label"),
    )


def from_generation_log(log: DataFrame) -> DataFrame:
    """Annotate the replies of a generation log; a null language or reply is left out.

    The language is a column of the one pass, so no language is collected or looped over.
    """
    known = log.where(F.col("language").isNotNull() & F.col("response").isNotNull())
    snippets = known.withColumnsRenamed({"response": "src"}).withColumn(
        "lang", F.trim(F.lower("language"))
    )
    return profile(snippets, F.lit("LLM"))


def work_lists(df: DataFrame, lang: str, key: str, text: str, most_bytes: int) -> DataFrame:
    """(lang, list_id, responses, n_responses, n_bytes): the responses of each language in lists.

    Responses stand in the order of ``key``, a number. No list has more than ``most_bytes``, but one
    that holds a single longer response. Sums run in two levels, over ranges of keys and within a
    range, so a language is never sorted in one task: a list holds what begins within one half of
    the bound, and what is longer than that half has a list of its own. Null languages and texts are
    left out.
    """
    half = max(1, most_bytes // 2)
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(key).alias("_key"), F.col(text).alias("_text"), F.octet_length(text).cast("long").alias("_size")
    )
    long = F.col("_size") > half
    short = rows.where(~long).withColumn("_range", range_bucket(rows.select("_key"), "_key"))
    sums = short.groupBy("lang", "_range").agg(F.sum("_size").alias("_n"))
    lower = Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("lang", "_range", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("lang", "_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    placed = short.join(starts, ["lang", "_range"]).withColumn("list_id", F.concat(F.lit("s"), F.floor(at / half).cast("string")))
    own = rows.where(long).withColumn("list_id", F.concat(F.lit("l"), F.col("_key").cast("string")))
    columns = ["lang", "list_id", "_key", "_text", "_size"]
    return (
        placed.select(*columns)
        .unionByName(own.select(*columns))
        .groupBy("lang", "list_id")
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_key", "_text"))), lambda x: x["_text"]).alias("responses"),
            F.count(F.lit(1)).alias("n_responses"),
            F.sum("_size").alias("n_bytes"),
        )
    )
