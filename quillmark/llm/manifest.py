"""Merkle manifest of a dataset, with leaf coordinates from ranks in compressed bitmaps.

The ids of a group are set in a bitmap of 64-bit words, of which only those that are not zero are
stored. Words are merged by bitwise or before they are shuffled. A directory of popcounts stands
over them, 256 entries to a node, so an id's coordinate is the directory's count up to its word
and the popcount of the lower bits within; the ids are never sorted. Nodes then meet in arrays that
are keyed by their slots, 512 to a row, where three levels of the tree are reduced at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Stored

#: Children of a node, levels that are reduced in a row, and so the slots of a row.
FAN_OUT, LEVELS = 8, 3
SLOTS = FAN_OUT**LEVELS
#: Bits of an id that address a bit in its word, and of a word that address an entry of a node.
WORD_BITS, NODE_BITS = 6, 8
#: Hexadecimal digits of a leaf that serve as its number among the leaves of one id.
DIGITS = 11
#: An empty path, as a type: what stands before and after a node in its run, level by level.
PATH = "array<struct<before:string,after:string>>"


def digest(parts: Column) -> Column:
    """H: lowercase hexadecimal SHA-256 of strings, concatenated."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf(*fields: Column) -> Column:
    """H of fields, each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    shown = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*shown), 256)


def _tree(group: Column) -> Column:
    """Name of a group's tree; bytewise order of names is that of groups, null first."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def ranks(ids: DataFrame) -> DataFrame:
    """(tree, word, bits, extra, before, total): the words of each tree's bitmap, with their ranks.

    ``ids``: tree, word, bit, n, one row per id of a tree; ``n`` is the number of places it takes.
    ``before`` counts the places of lower words, ``extra`` the places beyond the first of ids in
    this word, ``total`` those of the whole tree. The directory has as many levels as the range
    of words needs, at most eight; an entry holds 256 others, so no group grows with the table.
    """
    more = F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more")))
    words = Stored(
        ids.groupBy("tree", "word").agg(
            F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.collect_list(more).alias("extra"), F.sum("n").alias("n")
        ),
        "bitmap-words",
    ).df
    low, high = words.agg(F.min("word"), F.max("word")).first()
    low = low or 0
    level, span, directory = words.select("tree", (F.col("word") - low).alias("entry"), "n"), (high or 0) - low, []
    while span > 0:
        node = level.groupBy("tree", F.shiftright("entry", NODE_BITS).alias("node")).agg(
            F.collect_list(F.struct("entry", "n")).alias("entries"), F.sum("n").alias("n")
        )
        directory.append(Stored(node, "bitmap-directory").df)
        level, span = directory[-1].select("tree", F.col("node").alias("entry"), "n"), span >> NODE_BITS
    placed = level.select("tree", "entry", F.lit(0).cast("long").alias("before"), F.col("n").alias("total"))
    for node in reversed(directory):
        inner = F.expr(
            "transform(entries, e -> struct(e.entry AS entry,"
            " before + aggregate(entries, 0L, (s, x) -> s + if(x.entry < e.entry, x.n, 0L)) AS before))"
        )
        placed = node.join(placed.withColumnRenamed("entry", "node"), ["tree", "node"])
        placed = placed.select("tree", "total", F.inline(inner)).select("tree", "entry", "before", "total")
    placed = placed.withColumn("word", F.col("entry") + low).drop("entry")
    return words.drop("n").join(placed, ["tree", "word"])


#: Rank of a bit in its word: places of lower words, lower bits, and further places of lower bits.
RANK = "before + bit_count(bits & ~shiftleft(-1L, bit)) + aggregate(extra, 0L, (s, x) -> s + if(x.bit < bit, x.more, 0L))"


def _within(kinds: DataFrame) -> DataFrame:
    """(tree, word, bit, leaf, inner): places of the lesser leaves that share an id with this one."""
    number = F.conv(F.substring("leaf", 1, DIGITS), 16, 10).cast("long")
    own = F.concat_ws(":", "tree", "word", "bit")
    rows = kinds.select(
        "tree", "word", "bit", "leaf", "n", own.alias("crowd"), F.shiftright(number, WORD_BITS).alias("part"),
        number.bitwiseAND(F.lit(63)).cast("int").alias("place"),
    )
    ids = rows.groupBy(F.col("crowd").alias("tree"), F.col("part").alias("word"), F.col("place").alias("bit")).agg(F.sum("n").alias("n"))
    found = ranks(ids).select(F.col("tree").alias("crowd"), F.col("word").alias("part"), "bits", "extra", "before")
    # Leaves that agree in all digits used are the few that a window orders.
    lesser = Window.partitionBy("crowd", "part", "place").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.expr(RANK.replace("bit)", "place)").replace("x.bit < bit", "x.bit < place"))
    return rows.withColumn("_less", F.coalesce(F.sum("n").over(lesser), F.lit(0))).join(found, ["crowd", "part"]).select(
        "tree", "word", "bit", "leaf", (rank + F.col("_less")).alias("inner")
    )


def slots(leaves: DataFrame) -> DataFrame:
    """(tree, total, slot, doc_id, leaf, shown): each row's coordinate in its tree, from 0.

    ``leaves``: tree, doc_id, leaf, shown. Leaves ascend by doc_id, null ids last; leaves that
    share an id ascend by their hash. Equal rows take adjacent slots.
    """
    kinds = Stored(leaves.groupBy("tree", "doc_id", "leaf", "shown").agg(F.count(F.lit(1)).alias("n")), "leaves").df
    top = kinds.agg(F.max(F.shiftright("doc_id", WORD_BITS))).first()[0]
    kinds = kinds.select(
        "*", F.coalesce(F.shiftright("doc_id", WORD_BITS), F.lit(0 if top is None else top + 1)).alias("word"),
        F.coalesce(F.col("doc_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"),
    )
    ids = kinds.groupBy("tree", "word", "bit").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    index = Stored(ranks(ids.drop("kinds")), "bitmap-ranks").df
    crowded = Stored(kinds.join(ids.where("kinds > 1").select("tree", "word", "bit"), ["tree", "word", "bit"]), "crowded-ids").df
    inner = F.lit(0).cast("long")
    if crowded.limit(1).count():
        kinds = kinds.join(_within(crowded), ["tree", "word", "bit", "leaf"], "left")
        inner = F.coalesce("inner", F.lit(0).cast("long"))
    first = F.expr(RANK) + inner
    return kinds.join(index, ["tree", "word"]).select(
        "tree", "total", "doc_id", "leaf", "shown", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot")
    )


def _levels(nodes: Column, steps: Column) -> Column:
    """The nodes and every level above them that the steps reach, each an array."""

    def above(level: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(level), F.lit(FAN_OUT))
        return F.transform(starts, lambda i: digest(F.slice(level, i, FAN_OUT)))

    turns = F.slice(F.array(*[F.lit(i) for i in range(LEVELS)]), 1, steps)
    return F.aggregate(turns, F.array(nodes), lambda a, _: F.concat(a, F.array(above(F.element_at(a, -1)))))


def _path(levels: str, place: str) -> str:
    """SQL: what stands before and after the node at a place, on each level but the last."""
    at = f"cast({place} div element_at(array({', '.join(str(FAN_OUT**j) for j in range(LEVELS))}), j + 1) AS int)"
    return f"""transform(slice(array({', '.join(map(str, range(LEVELS)))}), 1, size({levels}) - 1), j -> struct(
        array_join(slice({levels}[j], {at} - {at} % {FAN_OUT} + 1, {at} % {FAN_OUT}), '') AS before,
        array_join(slice({levels}[j], {at} + 2, {FAN_OUT - 1} - {at} % {FAN_OUT}), '') AS after))"""


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rows of at most 512 nodes, pass by pass, and (tree, top) of every tree.

    ``nodes``: tree, total, slot, node, and more columns, which the first pass keeps.
    """
    passes, tops, now = [], None, nodes
    while True:
        keep = [c for c in now.columns if c not in ("tree", "total", "slot")]
        item = F.struct((F.col("slot") % SLOTS).cast("int").alias("place"), *keep)
        rows = now.groupBy("tree", "total", F.expr(f"slot div {SLOTS}").alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        steps = F.when(F.col("total") <= 1, 0).when(F.col("total") <= FAN_OUT, 1).when(F.col("total") <= FAN_OUT**2, 2).otherwise(LEVELS)
        rows = Stored(rows.withColumn("levels", _levels(F.col("items.node"), steps)), "tree-rows").df
        passes.append(rows)
        heads = rows.select("tree", "total", "chunk", F.element_at("levels", -1)[0].alias("node"))
        done = heads.where(F.col("total") <= SLOTS).select("tree", F.col("node").alias("top"))
        tops = done if tops is None else tops.unionAll(done)
        open_rows = heads.where(F.col("total") > SLOTS)
        if not open_rows.limit(1).count():
            return passes, tops
        now = open_rows.select("tree", F.expr(f"(total + {SLOTS - 1}) div {SLOTS}").alias("total"), F.col("chunk").alias("slot"), "node")


def descend(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first pass, each with the path from it to the root.

    ``above``: tree, path (of the tree's top), and more columns, which all nodes of a tree get. A
    row of nodes meets what is above it before its nodes are laid out.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    children = None
    for rows in reversed(passes):
        whole = rows.where(F.col("total") <= SLOTS).join(above, "tree")
        if children is not None:
            parents = children.select("tree", F.col("slot").alias("chunk"), "path", *more)
            whole = whole.unionByName(rows.where(F.col("total") > SLOTS).join(parents, ["tree", "chunk"]))
        item = f"transform(items, x -> struct(x AS item, concat({_path('levels', 'x.place')}, path) AS path))"
        laid = whole.select("tree", "chunk", *more, F.inline(F.expr(item)))
        children = laid.select("tree", (F.col("chunk") * SLOTS + F.col("item.place")).alias("slot"), "item", "path", *more)
    return children


def proofs(docs: DataFrame, leaf: Column, group: Column, doc_id: Column, shown: Column | None = None) -> DataFrame:
    """(tree, slot, doc_id, leaf, shown, path, subroot, root): every row's leaf and the way to the root.

    Groups have trees of their own, whose roots are the leaves of the last tree, null group first,
    then bytewise. ``shown`` is a second leaf to be checked against the manifest, by default the
    same. A path has one struct per level: the siblings before and those after the node, joined.
    Texts are read whole, once, for their hash; after that a row is its id and its hashes. Other
    columns are not looked at. Null ids are leaves after all others; repeated rows are leaves of
    their own; an empty table has no rows and no root. Groups are ranked in one task, as there is
    one row for each; rows are not.
    """
    leaves = docs.select(_tree(group).alias("tree"), doc_id.cast("long").alias("doc_id"), leaf.alias("leaf"), (leaf if shown is None else shown).alias("shown"))
    passes, tops = climb(slots(leaves).withColumnRenamed("leaf", "node"))
    tops = Stored(tops, "subroots").df
    order = Window.partitionBy(F.lit(0)).orderBy("tree")
    named = tops.select(
        F.lit("").alias("tree"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("total"),
        (F.row_number().over(order).cast("long") - 1).alias("slot"), F.col("top").alias("node"), F.col("tree").alias("name"),
    )
    upper, roots = climb(named)
    root = roots.first()
    start = roots.select("tree", F.expr(f"cast(array() AS {PATH})").alias("path"), F.lit(root["top"] if root else None).cast("string").alias("root"))
    above = descend(upper, start).select(F.col("item.name").alias("tree"), "path", F.col("item.node").alias("subroot"), "root")
    return descend(passes, above).select(
        "tree", "slot", "item.doc_id", F.col("item.node").alias("leaf"), "item.shown", "path", "subroot", "root"
    )


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, node, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def proof_digest(path: Column) -> Column:
    """H of all siblings on the path, level by level and from left to right."""
    return digest(F.transform(path, lambda p: F.concat(p["before"], p["after"])))
