"""Numbers of a dependency tree held in one row as an array of heads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import arrays as A

# Words that mark a clause or a coordination.
MARKED_DEPS = {
    "cc": "and or but et ou und oder aber y o".split(),
    "advcl": "because if while when since unless although weil wenn si cuando quand".split(),
    "ccomp": "that dass que".split(),
    "relcl": "which who whom qui".split(),
}


#: An ancestor and the distance to it stand in one number: the distance above this, the ancestor below.
UP = 1 << 32


def tree_depth(heads: Column) -> Column:
    """Nodes on the longest path from the root.

    ``heads[i]`` is the 1-based head of token i + 1, 0 for the root. Pointer doubling: each round
    adds the distance known to the present ancestor, so log2(n) rounds reach every root; rounds
    after that change nothing and are left out.
    """

    def ancestor(x: Column) -> Column:
        return x.bitwiseAND(F.lit(UP - 1))

    def doubled(h: Column) -> Column:
        # A head that is not there stays one that is not there, whatever its number.
        start = F.transform(h, lambda x: F.lit(UP) + F.when(x > 0, F.least(x, F.size(h) + 1)).otherwise(F.lit(0)))

        def step(acc: Column, _: Column) -> Column:
            up = F.transform(
                acc, lambda x: F.when(ancestor(x) > 0, x - ancestor(x) + F.get(acc, (ancestor(x) - 1).cast("int"))).otherwise(x)
            )
            return F.when(F.exists(acc, lambda x: ancestor(x) > 0), up).otherwise(acc)

        rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(h))).cast("int") + 1)
        return F.shiftright(F.array_max(F.aggregate(rounds, start, step)), 32).cast("int")

    return F.when(F.size(heads) > 0, A.let(heads, doubled)).otherwise(F.lit(0))
