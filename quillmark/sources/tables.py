"""Reading tables, and spreading a small file count over the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the largest split, in even shares of a slot, from which a table is dealt anew, and tasks that
#: each slot then gets: a slot that is slow, or has long texts, does fewer of them.
SHARE, TASKS = 0.5, 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str, share: float = SHARE, tasks: int = TASKS) -> DataFrame:
    """Repartition by unique keys when slots would wait for few tasks, as there are hardly more splits than
    slots or a file has few row groups, which no split divides.

    A large input in even splits is left alone, so nothing is shuffled there. The rows of the splits are
    counted without reading a column.
    """
    slots, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= slots:
        each = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
        n, most = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if most * slots <= share * n:
            return df
    return df.repartition(max(tasks * slots, splits), *keys)
