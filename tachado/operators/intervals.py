"""Interval operators on a document's span arrays (structs with start and end), as folds inside one row.

Defined cases: a null array gives null, an empty one an empty one; of equal spans the first in order stays; empty spans
(start = end) clash with nothing but what reaches over them; null bounds never clash and never begin an island;
merge takes null keys as one key, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pack(spans: Column, kind: str) -> Column:
    """First come, first kept: each span in array order stays if it overlaps none that stayed. kind: the array's type."""
    clash = lambda acc, x: F.exists(acc, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    return F.aggregate(spans, F.array().cast(kind), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def sweep(spans: Column, kind: str, keep: Callable[[Column], Column] = lambda x: F.lit(True)) -> Column:
    """Spans in order of start: one stays if it begins at or after the last kept end and `keep` allows it."""
    begin = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("kept"))
    add = lambda acc, x: F.when(
        (x["start"] >= acc["end"]) & keep(x), F.struct(x["end"].alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))
    ).otherwise(acc)
    return F.aggregate(spans, begin, add, lambda acc: acc["kept"])


def merge(df: DataFrame, keys: list[str], gap: int = 0, start: str = "start", end: str = "end") -> DataFrame:
    """Rows of spans -> islands (keys, start, end): joined where one begins at most `gap` after the greatest end so far."""
    order = W.partitionBy(*keys).orderBy(start, end)
    far = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce((F.col(start) > far + gap).cast("int"), F.lit(1)))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
