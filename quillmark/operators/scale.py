"""Joins, numbering and sampling that hold when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.shared import settle

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64
#: Rows of a group that are ranked in one task, and digits that a round adds to a cut.
RANKED, DIGITS = 1000, 3


def table_bytes(df: DataFrame) -> int:
    """Rough size: string bytes plus a flat cost per value."""
    per_row = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            per_row = per_row + F.coalesce(F.octet_length(name), F.lit(0))
    return df.agg(F.coalesce(F.sum(per_row.cast("long")), F.lit(0))).first()[0]


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a large table with a lookup table that is unique on ``on``.

    The lookup is settled and measured: within the bound it is broadcast, beyond it both sides are
    salted, so a frequent key is spread over many tasks.
    """
    right = settle(right, "lookup")
    if table_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def seeded_key(seed: int, *ids: Column | str) -> Column:
    """Reproducible pseudo-random order, independent of partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *ids))


def hash_bucket(key: Column) -> Column:
    """First three hex digits of an md5 key: 4096 even buckets in key order."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def range_bucket(df: DataFrame, col: str, buckets: int | None = None) -> Column:
    """Bucket of a numeric column in its own order, cut at approximate quantiles.

    Without a number of buckets there is one for every 10,000 rows, at most 10,000 of them.
    """
    if buckets is None:
        buckets = min(10_000, df.count() // 10_000 + 2)
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(col, probabilities, 1 / (4 * buckets))))
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(float(c)) for c in cuts])
    return F.size(F.filter(bounds, lambda b: b <= F.col(col)))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[f"_k_{n}"]) for n in names])


def _with_offsets(df: DataFrame, by: list[str], bucket: Column) -> DataFrame:
    """Add the bucket of each row and the number of rows of its group in lower buckets."""
    keyed = df.withColumn("_bucket", bucket)
    names = [*by, "_bucket"]
    sizes = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *[F.col(n).alias(f"_k_{n}") for n in names],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    # Without group keys there is one row per bucket, a number fixed by the bucket function.
    right = offsets if by else F.broadcast(offsets)
    return keyed.join(right, _same(keyed, offsets, names)).drop(*[f"_k_{n}" for n in names])


def _ranked_in_bucket(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return df.withColumn(out, F.col("_before") + F.row_number().over(inside)).drop(
        "_bucket", "_before"
    )


def number_rows(
    df: DataFrame, by: list[str], order: list[Column], bucket: Column, out: str = "rn"
) -> DataFrame:
    """Row numbers from 1 within ``by``, in ``order``, without sorting a group in one task.

    ``bucket`` must rise with the order. Rows are ranked inside (group, bucket) and shifted by the
    number of rows in the lower buckets of the group.
    """
    return _ranked_in_bucket(_with_offsets(df, by, bucket), by, order, out)


def sort_digits(column: Column) -> Column:
    """16 hexadecimal digits whose order as text is that of a whole number."""
    return F.lpad(F.lower(F.hex(column.cast("long").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")


def _group_name(by: list[str]) -> Column:
    """One string for a group, null members included."""
    return F.to_json(F.struct(*by)) if by else F.lit("")


def cut_points(keys: DataFrame, ranked: int = RANKED) -> DataFrame:
    """(_g, _cut, _before, _quota) of groups that have more rows than their quota.

    ``keys``: _g, _h (digits, in whose order rows are taken) and _quota. The cut is found by its
    leading digits: a histogram of the first ones finds the bin where a group's quota ends, and only
    that bin is looked at again, with more digits, until it holds at most ``ranked`` rows or all
    digits are used. Rows whose digits begin below the cut are taken, ``_before`` in number.
    """
    sizes = keys.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.max("_quota").alias("_quota"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    # Digits that all keys of a group share tell nothing.
    shared = F.expr("aggregate(sequence(1, 8 * 16), 0, (a, i) -> if(a = i - 1 AND i <= length(_lo) AND left(_lo, i) = left(_hi, i), i, a))")
    opened = sizes.where(F.col("_n") > F.col("_quota")).withColumn("_p", shared).select(
        "_g", F.expr("left(_lo, _p)").alias("_cut"), F.lit(0).cast("long").alias("_before"), "_quota", F.col("_n").alias("_in"), F.length("_hi").alias("_digits")
    )
    opened = settle(opened, "cuts")
    while opened.where((F.col("_in") > ranked) & (F.length("_cut") < F.col("_digits"))).limit(1).count():
        more = (F.col("_in") > ranked) & (F.length("_cut") < F.col("_digits"))
        near = lookup_join(keys.select("_g", "_h"), opened.where(more), ["_g"], "inner")
        near = near.where(F.expr("left(_h, length(_cut)) = _cut"))
        wider = F.expr(f"left(_h, length(_cut) + {DIGITS})")
        bins = near.groupBy("_g", wider.alias("_bin")).agg(F.count(F.lit(1)).alias("_in"), *[F.first(c).alias(c) for c in ("_before", "_quota", "_digits")])
        # At most 16 ** 3 bins a group.
        upto = F.sum("_in").over(Window.partitionBy("_g").orderBy("_bin"))
        placed = bins.withColumn("_upto", F.col("_before") + upto)
        first = placed.where(F.col("_upto") > F.col("_quota")).groupBy("_g").agg(F.min(F.struct("_bin", "_in", "_upto", "_quota", "_digits")).alias("b"))
        refined = first.select(
            "_g", F.col("b._bin").alias("_cut"), (F.col("b._upto") - F.col("b._in")).alias("_before"), "b._quota", "b._in", "b._digits"
        )
        opened = settle(opened.where(~more).unionByName(refined), "cuts")
    return opened.select("_g", "_cut", "_before", "_quota")


def take_in_order(
    df: DataFrame, by: list[str], digits: Column, ties: list[Column], quota: Column | int
) -> DataFrame:
    """First ``quota`` rows of each group in the order of ``digits``, the quota being a number or a column.

    ``digits`` are hexadecimal digits of equal length. The cut is found on keys alone; then rows are
    let through or dropped where they are, and only those of a group's last bin are ranked, by
    digits and ``ties``. No group meets in one task, and no text moves but that of these few.
    """
    limit = (F.lit(quota) if isinstance(quota, int) else quota).cast("long")
    rows = df.withColumns({"_g": _group_name(by), "_h": digits, "_quota": limit})
    cuts = cut_points(rows.select("_g", "_h", "_quota"))
    placed = lookup_join(rows.drop("_quota"), cuts, ["_g"])
    head = F.expr("left(_h, length(_cut))")
    whole = placed.where(F.col("_cut").isNull() | (head < F.col("_cut"))).select(*df.columns)
    inside = Window.partitionBy("_g").orderBy("_h", *ties)
    last = placed.where(head == F.col("_cut")).withColumn("_rn", F.row_number().over(inside))
    return whole.unionAll(last.where(F.col("_before") + F.col("_rn") <= F.col("_quota")).select(*df.columns))


def joined_text(df: DataFrame, keys: list[str], position: str, value: Column, sep: str) -> DataFrame:
    """(keys, text, n_items): the strings of each key joined in position order, one row per key."""
    return (
        df.select(*keys, F.col(position).alias("_p"), value.alias("_v"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_p", "_v"))).alias("_items"))
        .select(
            *keys,
            F.array_join(F.transform("_items", lambda x: x["_v"]), sep).alias("text"),
            F.size("_items").cast("long").alias("n_items"),
        )
    )
