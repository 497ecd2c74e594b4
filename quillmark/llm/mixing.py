"""Mixing sources to target weights, by exact block quotas split down a tree of output shards.

Each source has a target in words and draws from an endless sequence of epochs, each a new random
order of its blocks of documents. Whole epochs are taken whole; the last one up to the document that
brings the source nearest to its target. The number of blocks that
each source gives is split from the root of a binary tree over output shards to its leaves, each
time by a multivariate hypergeometric draw; a shard then owns disjoint runs of the permuted blocks
and orders its documents at random. Everything is DataFrame operations over ids and sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Stored, let, packed, words

#: Fixed values of the contract: repeating source weights, and most repeats of a document.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Rows of a block, blocks of a run in the two-level running totals, and words of an output shard.
BLOCK_ROWS = 64
RUN = 1024
SHARD_WORDS = 4_000_000


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _uniform(seed: int, *keys: Column | str) -> Column:
    """Reproducible number in [0, 1) of some keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its size, rows, weight and target; ``sizes``: source, size.

    Shares of all sizes by weight; a target stops at ``most`` times the source's size and what it
    leaves is shared again by weight. That is the level at which sources, taken in the order of
    size over weight, are either full or proportional to their weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    # One row per source from here on; the dimension is small against the documents.
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    cap = F.col("source_size") * float(most)
    fill = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    # Level at which this source and all later ones share what the earlier, full ones left.
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("_level", level).withColumn("_full", cap <= F.col("_level") * F.col("weight"))
    shared = F.max(F.when(~F.col("_full"), F.col("_level"))).over(every)
    target = F.when(F.col("_full") | shared.isNull(), cap).otherwise(F.least(cap, shared * F.col("weight")))
    return per.select("source", "source_size", "n_rows", "weight", target.cast("double").alias("target"))


def _log_factorial(n: Column) -> Column:
    """Natural logarithm of n!, exact below 16, by Stirling's series from there."""

    def of(n: Column) -> Column:
        small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), F.least(n, F.lit(15)).cast("int") + 1)
        x = F.greatest(n, F.lit(1)).cast("double")
        series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
        return F.when(n < 16, small).otherwise(series)

    return let(n, of)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` of ``total``, by inversion of ``u`` outwards from the mode.

    Steps over some standard deviations around the mode; the mode is returned beyond them. Every value
    that is used again is computed once, by ``let``: written out in full, the plan is several times as
    long, and the driver holds all of it for every level of a tree.
    """
    given = F.struct(total.alias("total"), marked.alias("marked"), drawn.alias("drawn"), u.alias("u"))
    return let(given, lambda g: _inverted(g["total"], g["marked"], g["drawn"], g["u"]))


def _inverted(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """``hypergeometric`` of plain columns or fields."""
    low = F.greatest(F.lit(0), drawn + marked - total)
    high = F.least(drawn, marked)

    def at_mode(b: Column) -> Column:
        low, high = b["low"], b["high"]
        mode = F.least(high, F.greatest(low, F.floor((drawn + 1) * (marked + 1) / (total + 2)))).cast("long")
        return let(mode, lambda mode: let(
            F.exp(_log_choose(marked, mode) + _log_choose(total - marked, drawn - mode) - _log_choose(total, drawn)),
            lambda first: walked(low, high, mode, first),
        ))

    def walked(low: Column, high: Column, mode: Column, first: Column) -> Column:
        spread = F.sqrt(drawn * marked / F.greatest(total, F.lit(1)).cast("double"))
        reach = (F.ceil(12 * spread) + 16).cast("int")

        def up(p: Column, k: Column) -> Column:
            return F.when(k >= high, 0.0).otherwise(p * (marked - k) * (drawn - k) / ((k + 1.0) * (total - marked - drawn + k + 1.0)))

        def down(p: Column, k: Column) -> Column:
            return F.when(k <= low, 0.0).otherwise(p * k * (total - marked - drawn + k) / ((marked - k + 1.0) * (drawn - k + 1.0)))

        start = F.struct(
            (u - first).alias("left"), first.alias("p_up"), mode.alias("k_up"), first.alias("p_down"),
            mode.alias("k_down"), F.when(u < first, mode).alias("found"),
        )

        def step(s: Column, _: Column) -> Column:
            sides = F.struct(up(s["p_up"], s["k_up"]).alias("more"), down(s["p_down"], s["k_down"]).alias("less"))
            return let(sides, lambda x: moved(s, x["more"], x["less"]))

        def moved(s: Column, more: Column, less: Column) -> Column:
            after_up = s["left"] - more
            after_down = after_up - less
            fresh = (
                F.when(s["found"].isNotNull(), s["found"])
                .when((more > 0) & (after_up < 0), s["k_up"] + 1)
                .when((less > 0) & (after_down < 0), s["k_down"] - 1)
            )
            return F.struct(
                after_down.alias("left"), more.alias("p_up"), (s["k_up"] + 1).alias("k_up"),
                less.alias("p_down"), (s["k_down"] - 1).alias("k_down"), fresh.alias("found"),
            )

        # Only as many steps as the spread asks for; where both sides are closed nothing changes.
        steps = F.sequence(F.lit(1), F.least(reach, (high - low + 1).cast("int")))
        return F.coalesce(F.aggregate(steps, start, step)["found"], mode)

    return let(F.struct(low.alias("low"), high.alias("high")), at_mode)


def split_tree(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """(shard, source, quota): block quotas of each source per shard, of 2 ** levels shards.

    ``quotas``: source, quota. At each node the left half of its blocks is drawn without replacement:
    the count of each source is hypergeometric given the counts of the sources before it. Every
    source's quotas add up exactly, and shards differ by one block at most.
    """
    node = quotas.groupBy(F.lit(0).cast("long").alias("node")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("quota").cast("long").alias("q")))).alias("parts")
    )
    for level in range(levels):
        total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        width = 1 << (levels - level)
        # Shards of a node hold n div width blocks, the first n mod width of them one more.
        half = F.floor(total / width) * (width // 2) + F.least(total % width, F.lit(width // 2))
        kept = node.select("node", "parts", total.alias("total"), half.cast("long").alias("half"))
        start = F.struct(
            F.col("total").alias("total"), F.col("half").alias("half"), F.array().cast("array<bigint>").alias("left")
        )

        def draw(s: Column, x: Column) -> Column:
            u = _uniform(seed, F.lit(level), F.col("node"), x["source"])
            drawn = F.when(s["total"] == 0, F.lit(0).cast("long")).otherwise(hypergeometric(s["total"], x["q"], s["half"], u))
            return let(drawn, lambda k: F.struct(
                (s["total"] - x["q"]).alias("total"), (s["half"] - k).alias("half"), F.concat(s["left"], F.array(k)).alias("left")
            ))

        kept = kept.withColumn("left", F.aggregate("parts", start, draw, lambda s: s["left"]))
        sides = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.zip_with("parts", "left", lambda p, k: F.struct(p["last"].alias("last"), p["source"].alias("source"), k.alias("q"))).alias("parts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("parts", "left", lambda p, k: F.struct(p["last"].alias("last"), p["source"].alias("source"), (p["q"] - k).alias("q"))).alias("parts")),
        )
        node = Stored(kept.select(F.inline(sides)), "quota-tree").df
    each = node.select(F.col("node").alias("shard"), F.explode("parts").alias("p"))
    return each.select("shard", F.col("p.source").alias("source"), F.col("p.q").alias("quota"))


def _dealt(blocks: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(_src, epoch, _block, place, start): where each block stands in its source's epochs.

    ``blocks``: _src, _block, words. Every epoch is an order of its own, by the hash of epoch and
    block; ``start`` counts the words before. Totals are of two levels, parts of the hash's range and
    blocks within a part, so that a large source is not ordered in one task.
    """
    each = blocks.join(sources.select("_src", "_epochs", "_n"), "_src").select(
        "_src", "_block", "words", "_n", F.explode(F.sequence(F.lit(0).cast("long"), "_epochs")).alias("epoch")
    )
    each = each.withColumn("_u", _uniform(seed, F.lit("order"), "epoch", "_src", "_block"))
    each = each.withColumn("_run", F.floor(F.col("_u") * F.ceil(F.col("_n") / RUN)))
    lower = Window.partitionBy("_src", "epoch").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("_src", "epoch", "_run").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("k")).select(
        "_src", "epoch", "_run", F.coalesce(F.sum("w").over(lower), F.lit(0)).alias("_words"),
        F.coalesce(F.sum("k").over(lower), F.lit(0)).alias("_blocks"),
    )
    inside = Window.partitionBy("_src", "epoch", "_run").orderBy("_u", "_block")
    start = F.col("_words") + F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("_blocks") + F.row_number().over(inside) - 1
    return each.join(sums, ["_src", "epoch", "_run"]).select("_src", "epoch", "_block", place.alias("place"), start.alias("start"))


def plan(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 0,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The rows of ``docs`` with a struct ``_mix``: size, source_size, target, and ``copies``, an array
    of (epoch, shard), one entry for each time the mix takes the row, at most ``most``.

    ``docs`` needs doc_id, text and source. Null and empty texts have size 0; in a source without
    words they are taken once. A null source is a source, the last one. Rows that repeat an id are
    told apart by their text; full repeats are interchangeable. Texts of any length are counted
    whole. An empty table gives an empty result. Further columns stay, whatever their names; only
    ``_mix`` is replaced. Sources are weighed and split in one task, as one row each.
    """
    kept = ["`" + c.replace("`", "``") + "`" for c in docs.columns if c != "_mix"]
    return _planned(docs, weights, most, seed, shard_words).select(*[F.col(f"_row.{c}") for c in kept], "_mix")


def _planned(docs: DataFrame, weights: tuple[float, ...], most: int, seed: int, shard_words: int) -> DataFrame:
    """(_row, _key, _mix): every row of ``docs`` in a struct, a hash of id and text, and its plan."""
    # A source's name with a mark before it, so that a null source is a plain join key too.
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_src")
    key = F.xxhash64("doc_id", "text").alias("_key")
    sizes = Stored(docs.select("source", src, key, size_of(F.col("text")).alias("size")), "mix-sizes").df
    sources = targets(sizes, weights, most)
    epochs = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(most)).cast("long")
    left = F.col("target") - epochs * F.col("source_size")
    rest = F.when(F.col("source_size") == 0, 0.0).when((epochs >= most) | (left <= 0), -1.0).otherwise(left)
    sources = Stored(sources.select(
        src, "source_size", "target", epochs.alias("_epochs"), rest.alias("_rest"),
        F.ceil(F.col("n_rows") / BLOCK_ROWS).cast("long").alias("_n"),
    ), "mix-sources").df
    block = F.floor(_uniform(seed, "_key") * F.col("_n")).cast("long").alias("_block")
    blocks = sizes.join(sources.select("_src", "_n"), "_src").select("_src", block, "size")
    blocks = blocks.groupBy("_src", "_block").agg(F.sum("size").alias("words"))
    dealt = Stored(_dealt(blocks, sources, seed), "mix-blocks").df
    # Whole epochs give all their blocks; the last one those that begin before the target is met.
    whole = dealt.join(sources.select("_src", "_epochs", "_rest"), "_src")
    given = whole.where((F.col("epoch") < F.col("_epochs")) | (F.col("start") <= F.col("_rest")))
    # Places of a source's blocks, epoch after epoch, in one row of draws.
    counts = given.groupBy("_src", "epoch").agg(F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy("_src").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_src", "epoch", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("_first"))
    quotas = counts.groupBy("_src").agg(F.sum("k").alias("quota"))
    quotas = sources.select("_src").join(quotas, "_src", "left").select(F.col("_src").alias("source"), F.coalesce("quota", F.lit(0)).alias("quota"))
    mixed = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    shares = split_tree(quotas, max(0, math.ceil(math.log2(max(1.0, mixed / shard_words)))), seed)
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    owned = shares.select(F.col("source").alias("_src"), "shard", "quota", F.coalesce(F.sum("quota").over(upto), F.lit(0)).alias("first"))
    draws = owned.where("quota > 0").select("_src", "shard", F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("draw"))
    given = given.join(firsts, ["_src", "epoch"]).select("_src", "epoch", "_block", (F.col("_first") + F.col("place")).alias("draw"))
    shards = given.join(draws, ["_src", "draw"]).groupBy("_src", "_block").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("_shards")
    )
    starts = whole.where(F.col("epoch") == F.col("_epochs")).select("_src", "_block", F.col("start").alias("_start"))
    blocks = Stored(starts.join(shards, ["_src", "_block"], "left").join(sources.drop("_n"), "_src"), "mix-plan").df
    # One shuffle of the documents, by block; the running total within a block uses it as well.
    rows = docs.select(packed(docs).alias("_row"), src, key, size_of(F.col("text")).alias("_size"))
    placed = rows.join(sources.select("_src", "_n"), "_src").withColumn("_block", block).drop("_n").join(blocks, ["_src", "_block"])
    inside = Window.partitionBy("_src", "_block").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    placed = placed.withColumn("_at", at)
    nearer = F.col("_at") + F.col("_size") / 2 <= F.col("_rest")
    copies = F.filter(F.coalesce("_shards", F.array().cast("array<struct<epoch:bigint,shard:bigint>>")), lambda c: (c["epoch"] < F.col("_epochs")) | nearer)
    mix = F.struct(F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"))
    return placed.select("_row", "_key", mix.alias("_mix"))


def mixture(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 0, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """The mix itself: every row as often as it is taken, in the columns of ``docs``, shard by shard
    and in random order within a shard. Takes the options of ``plan`` and treats rows as it does."""
    each = _planned(docs, weights, most, seed, shard_words).select("_row", "_key", F.explode("_mix.copies").alias("_copy"))
    place = F.xxhash64(F.lit(seed), F.col("_copy.epoch"), "_key")
    each = each.select("_row", F.col("_copy.shard").alias("_shard"), place.alias("_place"))
    return each.repartition("_shard").sortWithinPartitions("_shard", "_place").select("_row.*")
