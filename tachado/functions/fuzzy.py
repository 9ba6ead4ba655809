"""Token-sort ratio: 200 * LCS / (both lengths) of the sorted tokens' text.

The longest common subsequence is bit-parallel (one word of bits a text, one step a character of the other), in Arrow
batches of candidate pairs; pairs whose lengths alone rule out the wanted score, or that are equal, are settled in the JVM
and cost the batch a null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.array_sort(words(x)), " ")


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole  # bit i is 0 where the subsequence grows at a's character i
    for c in b:
        both = row & places.get(c, 0)
        row = ((row + both) | (row - both)) & whole
    return len(a) - row.bit_count()


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of two columns' longest common subsequence; null where either is null."""
    import pandas as pd

    def count(x, y):
        return pd.Series([None if p is None or q is None else subsequence(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    count.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(count, "int")(a, b)


def token_sort_ratio(a: Column, b: Column, least: float = 0.0, needed: Column | None = None) -> Column:
    """0 to 100; null-safe (null counts as empty); 0 where the lengths rule out `least`, or where not needed."""
    x, y = sorted_tokens(F.coalesce(a, F.lit(""))), sorted_tokens(F.coalesce(b, F.lit("")))
    total = F.length(x) + F.length(y)
    open_ = (x != y) & (F.lit(200.0) * F.least(F.length(x), F.length(y)) >= F.lit(float(least)) * total)
    open_ = open_ if needed is None else open_ & needed
    same = common_subsequence(F.when(open_, x), F.when(open_, y))
    ratio = F.when(x == y, 100.0).otherwise(F.coalesce(F.lit(200.0) * same / total, F.lit(0.0)))
    return ratio if needed is None else F.when(needed, ratio).otherwise(0.0)
