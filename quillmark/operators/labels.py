"""Labels, language names, stamps and model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.constants import EXTENSIONS, KNOWN_EXTENSIONS


def label_of(machine: Column) -> Column:
    return F.when(machine, "LLM").otherwise("HUMAN")


def encode_label(label: Column) -> Column:
    """0 for LLM; 1 for HUMAN and for anything else, null included."""
    return F.when(label == "LLM", 0).otherwise(1)


def decode_label(code: Column) -> Column:
    return F.when(code == 1, "HUMAN").otherwise("LLM")


def _mapped(col: Column, table: dict[str, str]) -> Column:
    out = None
    for value in dict.fromkeys(table.values()):
        hit = col.isin([k for k, v in table.items() if v == value])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def extension_of(language: Column) -> Column:
    """File extension of a language alias; an unknown alias passes through in lower case."""
    name = F.trim(F.lower(language))
    return F.coalesce(_mapped(name, EXTENSIONS), name)


def known_extension(language: Column) -> Column:
    """Extension of an accepted language; null means a reject."""
    return _mapped(F.trim(F.lower(language)), KNOWN_EXTENSIONS)


def language_from_content(src: Column) -> Column:
    """cpp when it shows an include or a semicolon, else py on import or def, else null."""
    return F.when(src.contains("#include") | src.contains(";"), "cpp").when(
        src.contains("import") | src.contains("def"), "py"
    )


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("support"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then macro and weighted averages and
    accuracy, computed from the confusion counts alone."""
    cells = confusion(df, label, prediction)
    per_class = (
        cells.select(F.explode(F.array(
            F.struct(F.col(label).cast("string").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
            F.struct(F.col(prediction).cast("string").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
        )).alias("c"), (F.col(label) == F.col(prediction)).alias("hit"), "n")
        .groupBy("c.class")
        .agg(
            F.sum("c.support").alias("support"),
            F.sum("c.predicted").alias("predicted"),
            F.sum(F.when(F.col("hit"), F.col("c.support")).otherwise(0)).alias("hits"),
        )
    )
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    scored = per_class.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(F.col("hits") * 2.0, F.col("predicted") + F.col("support")), F.lit(0.0)).alias("f1"),
        "support", "hits",
    )
    names = ["precision", "recall", "f1"]
    macro = scored.agg(*[F.avg(x).alias(x) for x in names], F.sum("support").alias("support"))
    weighted = scored.agg(
        *[(F.sum(F.col(x) * F.col("support")) / F.sum("support")).alias(x) for x in names],
        F.sum("support").alias("support"),
    )
    share = F.sum("hits") / F.sum("support")
    overall = scored.agg(*[share.alias(x) for x in names], F.sum("support").alias("support"))
    rows = scored.select("class", *names, "support")
    for title, part in (("macro avg", macro), ("weighted avg", weighted), ("accuracy", overall)):
        rows = rows.unionByName(part.select(F.lit(title).alias("class"), *names, "support"))
    return rows
