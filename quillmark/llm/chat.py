"""Conversations from reply trees: paths from root to leaf, ranked by score, one text each.

Messages are rows (tree, node, parent, role, text, score). Paths are found by self-joins of ids
that double their reach each time, so a reply chain of n messages takes about log(n) of them;
texts move once, when chosen paths are formatted.

Template: each turn is ``### role`` on a line, the text, and ``</turn>`` on a line. A backslash, the
mark ``###`` and the mark ``</turn>`` inside a text get a backslash before them, so neither mark
stands in a text unescaped, and removing the backslashes gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Stored

HEAD, END = "### ", "\n</turn>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """Control strings and backslashes get a backslash; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"(\\|###|</turn>)"), F.lit(r"\\$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def escape_role(role: Column) -> Column:
    """As texts, and a line break as backslash and N, so that a role stays on its line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\N"))


def unescape_role(role: Column) -> Column:
    # Between doubled backslashes no other pair begins, so the parts can be undone on their own.
    parts = F.split(role, r"\\\\")
    plain = F.transform(parts, lambda p: unescape(F.replace(p, F.lit("\\N"), F.lit("\n"))))
    return F.array_join(plain, "\\")


def reply_trees(turns: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as reply chains (tree, node, parent, role, text, score).

    Turns reply to the one before; ties of ``turn`` go by role and text, null turns come first. A
    null conv_id is a conversation as well. ``tree`` is the conversation as a string, empty for null.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("tree")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", tree, "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        "conv_id", "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.lit(1.0).alias("score"),
    )


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth): nodes of the ``best`` root-to-leaf paths of each tree.

    A path's score is the mean of its messages' scores, null as 0; ties go to the smaller leaf. A
    parent that is not in the tree counts as none. Repeated rows of a node count once. Messages
    whose parents form a circle have no root and no path.
    """
    nodes = messages.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    nodes = Stored(nodes, "messages").df
    heads = nodes.select("tree", F.col("node").alias("up"))
    step = nodes.withColumnRenamed("parent", "up")
    rooted = step.join(heads, ["tree", "up"], "left_semi").select("tree", "node", "up", "score")
    lone = step.join(rooted.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node", F.lit(None).cast("long").alias("up"), "score")
    one = F.lit(1).cast("long").alias("depth")
    first = Stored(rooted.unionByName(lone).select("tree", "node", "up", one, "score"), "jumps").df
    # A round's open nodes know their 2^k-th ancestor, and depth and score of the messages below it;
    # nodes whose path has reached its root are done and are only looked up.
    open_, done = first.where("up is not null"), first.where("up is null")
    parents = open_.select("tree", F.col("up").alias("node")).distinct()
    jumps, left, rounds = [], open_.count(), max(1, nodes.count()).bit_length() + 1
    while left and len(jumps) < rounds:
        jumps.append(open_)
        above = done.unionByName(open_).select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("score").alias("_s"))
        after = Stored(open_.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"),
            (F.col("score") + F.col("_s")).alias("score"),
        ), "jumps").df
        open_, done = after.where("up is not null"), done.unionByName(after.where("up is null"))
        left = open_.count()
    leaves = done.join(parents, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("score") / F.col("depth")).desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    found = chosen.select("tree", F.col("node").alias("leaf"), "rank", "node")
    # Back down: each round adds, to every node found, its ancestor at the round's distance.
    for jump in reversed(jumps):
        more = found.join(jump.select("tree", "node", "up"), ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"))
        found = Stored(found.unionByName(more), "paths").df
    return found.join(done.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "leaf", "rank", "node", "depth")


def conversations(messages: DataFrame, best: int = 1, learned: str = LEARNED) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, n_turns, ``formatted``, ``segments`` and ``loss_spans``.

    ``segments`` are consecutive pieces (text, loss) whose texts joined give ``formatted``; ``loss``
    marks the escaped text of each turn of role ``learned``. ``loss_spans`` are the same places as
    character offsets (start, end). Null texts and roles are empty. An empty table gives an empty
    result. Columns beyond the six named ones are not looked at. A conversation ends as one row,
    which is the only place where its turns come together.
    """
    chosen = paths(messages, best)
    texts = messages.groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("m"))
    turns = chosen.join(texts, ["tree", "node"]).select(
        "tree", "leaf", "rank", "depth",
        F.concat(F.lit(HEAD), escape_role(F.col("m.role")), F.lit("\n")).alias("head"),
        escape(F.col("m.text")).alias("body"),
        F.coalesce(F.col("m.role") == learned, F.lit(False)).alias("loss"),
    )
    before = Window.partitionBy("tree", "leaf", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    item = F.struct("depth", "head", "body", "loss", "start")
    kept = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(item)).alias("_t"))
    pieces = F.flatten(F.transform("_t", lambda t: F.array(
        F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )))
    spans = F.transform(F.filter("_t", lambda t: t["loss"]), lambda t: F.struct(
        t["start"].alias("start"), (t["start"] + F.length(t["body"])).alias("end")
    ))
    return kept.select(
        "tree", "leaf", "rank", F.size("_t").cast("long").alias("n_turns"),
        F.array_join(F.transform("_t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        pieces.alias("segments"), spans.alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, END), lambda t: t != "")

    def turn(t: Column) -> Column:
        line = F.substring_index(t, "\n", 1)
        # The text begins after the first line break; a turn has one always.
        return F.struct(
            unescape_role(F.substr(line, F.lit(len(HEAD) + 1))).alias("role"),
            unescape(F.substr(t, F.length(line) + 2)).alias("text"),
        )

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
