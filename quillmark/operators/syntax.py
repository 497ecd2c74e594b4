"""Numbers over a dependency-edge table of a parser, and their alignment with our sentences.

An edge is (doc_id, parse_id, tok_id, head_id, dep, word, start, end). Token ids run from 1 within a
parsed sentence, whose root has head 0; ``start`` and ``end`` are offsets in the text, from 0, the
end not included. Parsers cut sentences differently: one of ours takes the first parsed sentence
that it overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import tokens, trees
from quillmark.functions.constants import COORDINATOR_DEP, SUBORDINATE_DEPS

PARSE = ["doc_id", "parse_id"]
DOCUMENT = ["doc_id", "text_hash"]
SENTENCE = [*DOCUMENT, "sent_id"]
#: Characters of a bucket in which spans meet.
WIDTH = 512


def _heads() -> Column:
    """Heads of a sentence in token order; a sentence is never longer than its document's row."""
    pairs = F.sort_array(F.collect_list(F.struct("tok_id", "head_id")))
    return F.transform(pairs, lambda x: x["head_id"])


def tree_depth(edges: DataFrame) -> DataFrame:
    """Depth per parsed sentence: one grouping into head arrays, then pointer doubling in the row."""
    grouped = edges.groupBy(*PARSE).agg(_heads().alias("_heads"))
    return grouped.select(*PARSE, trees.tree_depth(F.col("_heads")).cast("long").alias("depth"))


def _counts() -> list[Column]:
    right = F.col("tok_id") > F.col("head_id")
    child = F.col("head_id") > 0
    n = F.count(F.lit(1))
    lefts = F.count_if(child & ~right)
    rights = F.count_if(child & right)
    return [
        n.alias("n_tokens"),
        (F.min(F.when(~child, F.col("tok_id") - 1)) / n).alias("head"),
        F.count_if(F.col("dep").isin(SUBORDINATE_DEPS)).alias("sub_clauses"),
        F.count_if(F.col("dep") == COORDINATOR_DEP).alias("coord_clauses"),
        ((rights - lefts) / n).alias("branching"),
        (F.abs(lefts - rights) <= 2).alias("balanced"),
    ]


def parse_counts(edges: DataFrame) -> DataFrame:
    """Length, root position, clause counts, branching and balance by partial aggregation."""
    return edges.groupBy(*PARSE).agg(*_counts())


def parse_syntax(edges: DataFrame) -> DataFrame:
    """Counts, depth and span of each parsed sentence from one grouping of its edges."""
    span = [F.min("start").alias("start"), F.max("end").alias("end")]
    grouped = edges.groupBy(*PARSE).agg(*_counts(), *span, _heads().alias("_heads"))
    return grouped.withColumn("depth", trees.tree_depth(F.col("_heads")).cast("long")).drop("_heads")


def sentence_spans(docs: DataFrame, text: str = "text", carry: list[str] = ()) -> DataFrame:
    """(doc_id, text_hash, sent_id, start, end, n_words, carry): where our sentences stand in their texts.

    Lengths of the pieces are added up over the document; no text is shuffled. Rows that repeat id
    and text are one document here. ``carry`` are columns that follow from id and text.
    """
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), *carry, tokens.sentence_pieces(F.col(text)).alias("_ps"))
    # One shuffle by document: repeated rows go before their pieces are dealt to rows.
    pieces = texts.dropDuplicates(DOCUMENT).select(*DOCUMENT, *carry, F.posexplode("_ps").alias("_i", "_p"))
    within = Window.partitionBy(*DOCUMENT).orderBy("_i")
    start = F.sum("_p.size").over(within) - F.col("_p.size") + F.col("_p.lead")
    placed = pieces.withColumn("start", start).where(F.col("_p.length") > 0)
    return placed.select(
        *DOCUMENT, (F.row_number().over(within).cast("long") - 1).alias("sent_id"),
        "start", (F.col("start") + F.col("_p.length")).alias("end"), F.col("_p.n_words").alias("n_words"), *carry,
    )


def _in_buckets(spans: DataFrame, width: int) -> DataFrame:
    """A row for every bucket that a span touches; one over a boundary is in both."""
    return spans.withColumn("_bucket", F.explode(F.sequence(
        F.floor(F.col("start") / width), F.floor((F.greatest("end", F.col("start") + 1) - 1) / width)
    )))


def _met(spans: DataFrame, parsed: DataFrame, width: int) -> DataFrame:
    """Our sentences beside each parsed one, ``_parsed``, that they overlap; the first has the least of them."""
    ours = _in_buckets(spans, width)
    numbers = [c for c in parsed.columns if c not in (*PARSE, "start", "end")]
    each = F.struct(F.col("start").alias("_start"), "parse_id", F.col("end").alias("_end"), *numbers).alias("_parsed")
    theirs = _in_buckets(parsed, width).select("doc_id", "_bucket", each)
    met = ours.join(theirs, ["doc_id", "_bucket"])
    return met.where((F.col("start") < F.col("_parsed._end")) & (F.col("_parsed._start") < F.col("end")))


def aligned(spans: DataFrame, parsed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, sent_id, parse_id): the first parsed sentence that each of ours overlaps.

    An interval join on character offsets: spans meet in buckets of ``width`` characters of their
    document, so a long document is not compared sentence with sentence. Sentences that no parse
    overlaps, and documents without an id, have no row.
    """
    met = _met(spans.select(*SENTENCE, "start", "end"), parsed.select(*PARSE, "start", "end"), width)
    return met.groupBy(*SENTENCE).agg(F.min("_parsed")["parse_id"].alias("parse_id"))


def sentence_syntax(spans: DataFrame, parses: DataFrame) -> DataFrame:
    """Our sentences (doc_id, text_hash, sent_id, n_words, what spans carry) with the numbers of their parses.

    The numbers travel with the spans of the parses, so edges are grouped once and joined once.
    """
    parsed = parse_syntax(parses)
    own = [c for c in spans.columns if c not in (*SENTENCE, "start", "end")]
    first = _met(spans, parsed, WIDTH).groupBy(*SENTENCE).agg(*[F.first(c).alias(c) for c in own], F.min("_parsed").alias("_parsed"))
    numbers = [c for c in parsed.columns if c not in (*PARSE, "start", "end")]
    return first.select(*SENTENCE, *own, *[F.col(f"_parsed.{c}").alias(c) for c in ("parse_id", *numbers)])


def document_syntax(sentences: DataFrame, normalise_head: bool = True, keys: list[str] = DOCUMENT) -> DataFrame:
    """Numbers of sentences rolled up to documents (doc_id, text_hash), or other keys of theirs.

    With ``normalise_head`` each root position is divided by the sentence's number of words between
    white space before averaging.
    """
    head = F.col("head") / F.col("n_words") if normalise_head else F.col("head")
    return sentences.groupBy(*keys).agg(
        F.max("depth").alias("depth"),
        F.avg(head).alias("head"),
        F.avg("sub_clauses").alias("sub_clauses"),
        F.avg("coord_clauses").alias("coord_clauses"),
        F.avg("branching").alias("branching"),
        F.avg(F.col("balanced").cast("int")).alias("balanced"),
    )
