"""Quality rules as a ledger: each rule once, its failures as bits beside the measurements.

Policies are versioned sets of rules, masks over the bits, and are applied or compared without a
second look at the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import let, words

#: Fixed values of the contract: symbols, and words of a repeat window.
SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 5

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
]


def _replaced(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def _repeat_words(found: Column) -> Column:
    """Words that lie in windows which occur twice or more in the text.

    Windows are compared by 64-bit hash. Texts whose windows are all different, nearly all texts,
    stop there; for others windows are sorted with their places, and the words that repeated
    windows cover are counted from the gaps between their places.
    """
    n = F.size(found) - (REPEAT_WORDS - 1)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def again(x: Column, k: Column) -> Column:
                before = (k > 0) & (F.get(s, k - 1)["h"] == x["h"])
                after = F.get(s, k + 1)["h"].eqNullSafe(x["h"])
                return F.when(F.coalesce(before, F.lit(False)) | after, x["i"])

            return F.sort_array(F.array_compact(F.transform(s, again)))

        def count(p: Column) -> Column:
            start = F.struct(F.lit(-REPEAT_WORDS).alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                p, start,
                lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(REPEAT_WORDS), i - a["last"])).alias("n")),
                lambda a: a["n"],
            )

        return let(let(placed, places), count)

    def measured(hashes: Column) -> Column:
        all_new = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(all_new, F.lit(0).cast("long")).otherwise(covered(hashes))

    windows = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(REPEAT_WORDS)])
    )
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(windows, measured))


def _measures(text: Column) -> Column:
    def of(t: Column) -> Column:
        def with_words(w: Column) -> Column:
            lines = F.filter(F.split(t, "\\n"), lambda x: x.rlike("[^ \\t-\\r]"))
            letters = _replaced(t, r"[^\p{L}]+")
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.length(_replaced(t, "[^#*$%&|<>]+")).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(lines).cast("long").alias("n_lines"),
                F.length(_replaced(letters, r"[^\p{Lu}]+")).cast("long").alias("n_upper"),
                F.length(letters).cast("long").alias("n_letters"),
            )

        return let(words(t), with_words)

    return let(F.coalesce(text, F.lit("")), of)


def rules() -> dict[str, Column]:
    """Failure condition of each rule over the measurements; its place is its bit, new ones go last."""
    n = F.col("n_words")
    return {
        "few_words": n < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "short_words": F.col("word_chars") < 2 * n,
        "long_words": F.col("word_chars") > 20 * n,
        "duplicate_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "upper_case": 2 * F.col("n_upper") > F.col("n_letters"),
    }


#: Versioned policies: names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "short_words", "long_words"),
    "v2": ("few_words", "repeated_words", "symbols", "short_words", "long_words", "duplicate_lines", "upper_case"),
}


def mask(policy: str | tuple[str, ...]) -> int:
    """Bits of a policy, given by its version or by rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {name: 1 << i for i, name in enumerate(rules())}
    return sum(bits[name] for name in names)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, measurements, bits) for every row.

    Null and empty texts have no words and fail the rules that say so. Repeated rows stay repeated,
    null ids stay, other columns are not looked at, and an empty table gives an empty ledger. All
    is computed within the row, over whole texts; nothing is shuffled.
    """
    each = docs.select(F.col(doc_id).alias("doc_id"), _measures(F.col(text)).alias("_m")).select("doc_id", "_m.*")
    failed = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(rules().values())]
    return each.withColumn("bits", reduce(lambda a, b: a.bitwiseOR(b), failed).cast("long"))


def apply(entries: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """The ledger with ``kept``: whether no rule of the policy failed."""
    return entries.withColumn("kept", F.col("bits").bitwiseAND(F.lit(mask(policy))) == 0)


def rules_names() -> tuple[str, ...]:
    """Names of the rules in the order of their bits."""
    return POLICIES["v2"]


def ablation(entries: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): per rule of the policy, rows that fail it, rows that
    fail nothing else, and rows kept if it is left out. One aggregation by distinct bit sets."""
    whole = mask(policy)
    sets = entries.groupBy(F.col("bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    bits = {name: 1 << i for i, name in enumerate(rules()) if whole >> i & 1}
    each = sets.select("bits", "n", F.explode(F.create_map(*[F.lit(x) for item in bits.items() for x in item])).alias("rule", "bit"))

    def rows(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return each.groupBy("rule").agg(
        rows(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        rows(F.col("bits") == F.col("bit")).alias("n_only"),
        rows((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )
