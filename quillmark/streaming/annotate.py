"""Incremental annotation whose result does not depend on how the input was cut or in which order.

A word's lemma depends on which words are known, so the stream owns the vocabulary: a table of
words by the version, the number of the micro-batch, that brought them. A batch is annotated with the
words known by then. What its tokens might have become, had a word been known, is kept as pending;
when a later batch brings that word, the documents concerned are annotated again and written once
more under the new version. Readers take each document's latest version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.plans import prose

#: Annotates documents (doc_id, text, ...) with a vocabulary (word); the result keeps ``doc_id``.
Job = Callable[[DataFrame, DataFrame], DataFrame]


def _table(spark: SparkSession, master: str, name: str, upto: int, schema) -> DataFrame:
    """Rows of a table of the master with versions up to ``upto``."""
    paths = [f"{master}/{name}/version={v}" for v in range(upto + 1)]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("version", F.lit(0))
    return spark.read.schema(schema).option("basePath", f"{master}/{name}").parquet(*paths)


def _put(df: DataFrame, master: str, name: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{master}/{name}/version={version}")


def annotate_stream(
    spark: SparkSession,
    source: str,
    schema,
    job: Job,
    master: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    clean: bool = True,
) -> None:
    """Process all files that arrived since the last run and stop.

    ``schema`` has ``doc_id`` and ``text``; ``clean`` tells whether the job cleans its texts. Each
    micro-batch reads the tables of earlier versions only and overwrites its own, so a batch that is
    repeated after a failure leaves one copy. Ids may be null or come again: a document is what one
    batch holds of an id.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    words_schema, pending_schema = "word string", f"doc_id {types['doc_id']}, candidate string"

    def write_batch(batch: DataFrame, version: int) -> None:
        own = batch.sparkSession
        _put(batch, master, "inputs", version)
        batch = own.read.schema(batch.schema).parquet(f"{master}/inputs/version={version}")
        before = _table(own, master, "words", version - 1, words_schema).select("word")
        _put(prose.words_of(batch, clean=clean).join(before, "word", "left_anti"), master, "words", version)
        words = _table(own, master, "words", version, words_schema)
        vocabulary, fresh = words.select("word"), words.where(F.col("version") == version)
        waiting = prose.candidates_of(batch, clean=clean).join(
            vocabulary.withColumnRenamed("word", "candidate"), "candidate", "left_anti"
        )
        _put(waiting.select("doc_id", "candidate"), master, "pending", version)
        pending = _table(own, master, "pending", version - 1, pending_schema)
        touched = pending.join(fresh.select(F.col("word").alias("candidate")), "candidate", "left_semi")
        touched = touched.select(F.col("doc_id").alias("_id"), F.col("version").alias("_born")).distinct()
        inputs = _table(own, master, "inputs", version - 1, batch.schema)
        again = inputs.join(
            touched, inputs["doc_id"].eqNullSafe(touched["_id"]) & (inputs["version"] == touched["_born"]), "left_semi"
        )
        rows = batch.withColumn("born", F.lit(version)).unionByName(again.withColumnRenamed("version", "born"))
        # An id may be in several batches: the batch is part of the id while the job runs.
        named = rows.withColumn("doc_id", F.struct("born", "doc_id")).drop("born")
        done = job(named, vocabulary).withColumn("born", F.col("doc_id.born")).withColumn("doc_id", F.col("doc_id.doc_id"))
        _put(done, master, "rows", version)

    query = (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_master(spark: SparkSession, master: str) -> DataFrame:
    """Every document as of its latest version."""
    rows = spark.read.parquet(f"{master}/rows")
    latest = F.max("version").over(Window.partitionBy("born", "doc_id"))
    return rows.withColumn("_latest", latest).where(F.col("version") == F.col("_latest")).drop("_latest", "version", "born")


def changes(spark: SparkSession, master: str, version: int) -> DataFrame:
    """The documents that a version has written again, with the batch that brought them (``born``)."""
    rows = spark.read.parquet(f"{master}/rows").where(F.col("version") == version)
    return rows.where(F.col("born") < version).drop("version")


def read_vocabulary(spark: SparkSession, master: str) -> DataFrame:
    """(word): all words that the stream has met, for batch jobs and for serving."""
    return spark.read.parquet(f"{master}/words").select("word").distinct()
