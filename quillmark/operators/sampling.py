"""Seeded shuffles, quotas, splits and balancing, all in md5 order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.scale import hash_bucket, seeded_key, sort_digits, take_in_order


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Rows in a reproducible random order (range-partitioned sort)."""
    return df.orderBy(seeded_key(seed, key), key)


def sample_groups(df: DataFrame, by: list[str], key: str, quota: Column | int, seed: int) -> DataFrame:
    """Up to ``quota`` random rows of each group; all of a group that has fewer."""
    return take_in_order(df, by, seeded_key(seed, key), [F.col(key)], quota)


def skip_take(df: DataFrame, key: str, text: str, skip: int, n: int) -> DataFrame:
    """The n rows after the first ``skip`` non-blank ones, in key order."""
    return df.where(F.col(text).rlike(r"[^\s\p{Z}]")).orderBy(key).offset(skip).limit(n)


def take_per_group(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The first n rows of each group in the order of ``key``, a whole number."""
    return take_in_order(df, [by], sort_digits(F.col(key)), [F.col(key)], n)


def split(df: DataFrame, key: str, test_share: float, seed: int, by: list[str] | None = None) -> DataFrame:
    """Add ``split``: the first ceil(share x n) rows in random order are "test", per stratum.

    Only the bucket that holds the boundary of a stratum is ranked; every other bucket is wholly
    on one side.
    """
    by = by or []
    keyed = df.withColumn("_h", seeded_key(seed, key)).withColumn("_b", hash_bucket(F.col("_h")))
    names = [*by, "_b"]
    sizes = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    strata = Window.partitionBy(*(by or [F.lit(0)]))
    running = strata.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sizes.select(
        *[F.col(n).alias(f"_k{n}") for n in names],
        (F.sum("_n").over(running) - F.col("_n")).alias("_before"),
        F.sum("_n").over(running).alias("_upto"),
        F.ceil(F.round(F.sum("_n").over(strata) * F.lit(test_share), 6)).alias("_quota"),
    )
    same = F.lit(True)
    for n in names:
        same = same & keyed[n].eqNullSafe(cut[f"_k{n}"])
    placed = keyed.join(cut if by else F.broadcast(cut), same)
    boundary = (F.col("_before") < F.col("_quota")) & (F.col("_upto") > F.col("_quota"))
    inside = Window.partitionBy(*names).orderBy("_h", key)
    out = [*df.columns, "split"]
    whole = placed.where(~boundary).withColumn(
        "split", F.when(F.col("_upto") <= F.col("_quota"), "test").otherwise("train")
    )
    cut_rows = placed.where(boundary).withColumn(
        "split",
        F.when(F.col("_before") + F.row_number().over(inside) <= F.col("_quota"), "test").otherwise("train"),
    )
    return whole.select(*out).unionByName(cut_rows.select(*out))


def human_quota(machine_rows: Column, sources: int = 3, small: int = 60) -> Column:
    """Rows to draw per human source for a given number of machine rows."""
    return F.when(machine_rows > small, F.floor(machine_rows / sources)).otherwise(machine_rows)


def balanced_pair(
    machine: DataFrame, human: DataFrame, source: str, key: str, seed: int
) -> DataFrame:
    """Machine rows plus, of each human source, the quota that balances them."""
    n = machine.agg(F.count(F.lit(1)).alias("_n_machine"))
    quota = human_quota(F.col("_n_machine"))
    with_quota = human.withColumn("_n_machine", n.scalar())
    drawn = sample_groups(with_quota, [source], key, quota, seed).drop("_n_machine")
    return machine.withColumn("label", F.lit("LLM")).unionByName(
        drawn.withColumn("label", F.lit("HUMAN")), allowMissingColumns=True
    )


def augment(
    existing: DataFrame, pool: DataFrame, source: str, key: str, extra: int, seed: int
) -> DataFrame:
    """Add extra // 3 unseen rows of each source to an existing set."""
    unseen = pool.join(existing.select(key), key, "left_anti")
    return existing.unionByName(sample_groups(unseen, [source], key, extra // 3, seed))
