"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

DataFrame functions only. A budget of tokens goes down the tree: each node's budget is dealt to its children
by weight, no child getting more than its subtree can give (its tokens times `epochs`); what a child cannot
use goes to its siblings, and only what none of them can use was never given to their parent. So shortages
are met among siblings before ancestors. With children sorted by capacity per weight the filling level is
one pass of running sums over the children, who are rows of a table of leaves, not of documents.

A leaf with budget b and T tokens gives every document floor(b / T) times (whole epochs) and then the
longest prefix of the next epoch's seeded order within the rest. The order is an md5 of seed, epoch and key.
The prefix's end is found by sums over 4096 ranges of the order, then over 4096 ranges of the one that holds
the end, then by a running sum inside the last range (about one in 16 million of a leaf); so no leaf, however hot,
is sorted by one task. What remains a leaf is one row (epochs, last key of the prefix), and documents are selected
by a join with these rows, without moving their texts.

Defined cases: null branch names count as ""; null texts have no tokens; documents without tokens follow the
order like others; a leaf without tokens gives none; a null key sorts first within equal orders; repeated
rows are documents of their own with the same order, taken or left together only if they fit; columns of the
caller may have any names (where one is named epoch, ours is epoch_); an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialise, small, text_of

#: Hex digits of the order, and of its coarse and fine ranges.
HEX, RANGES = 15, (3, 6)


def token_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_of(seed: int, epoch: Column, key: str) -> Column:
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), k).cast("binary")), 1, HEX)


def _weight(level: str, weights: dict[str, float]) -> Column:
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights are above zero")
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*map(F.lit, chain(*((k, float(w)) for k, w in weights.items()))))[F.col(level)], F.lit(1.0))


def _fill(nodes: DataFrame, level: str, parents: list[str], weights: dict[str, float]) -> DataFrame:
    """nodes (parents, level, capacity, above) with `budget`, the share of `above` that this node gets."""
    n = nodes.withColumn("_w", _weight(level, weights)).withColumn("_ratio", F.col("capacity") / F.col("_w"))
    order = W.partitionBy(*parents).orderBy("_ratio", level) if parents else W.partitionBy(F.lit(0)).orderBy("_ratio", level)
    all_of = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    n = n.withColumn("_level", (F.col("above") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / (F.sum("_w").over(all_of) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    n = n.withColumn("_full", F.col("_ratio") <= F.col("_level"))
    n = n.withColumn("_open", F.min(F.when(~F.col("_full"), F.struct("_ratio", level, "_level"))).over(all_of)["_level"])
    return n.withColumn("budget", F.when(F.col("_full"), F.col("capacity").cast("double")).otherwise(F.col("_open") * F.col("_w"))).drop("_w", "_ratio", "_level", "_full", "_open")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], epochs: int, share: float) -> DataFrame:
    """leaves (levels, tokens) with `budget`, whole tokens. share: of all tokens, the budget at the root."""
    given = leaves.withColumn("capacity", F.col("tokens") * epochs)
    above = given.agg(F.least(F.floor(F.sum("tokens") * F.lit(float(share))), F.sum("capacity")).cast("double").alias("above"))
    parents: list[str] = []
    for level in levels:
        nodes = given.groupBy(*parents, level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(above, parents) if parents else nodes.crossJoin(F.broadcast(above))  # one row: the root
        filled = _fill(nodes, level, parents, weights.get(level, {}))
        parents = [*parents, level]
        above = filled.select(*parents, F.col("budget").alias("above"))
    return leaves.join(above, levels).withColumn("budget", F.floor(F.col("above") + F.lit(1e-6))).drop("above")


def plan(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], key: str, text: str, epochs: int, share: float, seed: int) -> DataFrame:
    """A row a leaf: levels, tokens, budget, whole (epochs), and the last (order, key) of the next epoch's prefix."""
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in levels), F.col(key).alias("_key"), token_count(text).alias("_n"))
    rows = materialise(own, "mixing")
    leaves = rows.groupBy(*levels).agg(F.sum("_n").alias("tokens"))
    dealt = budgets(leaves, levels, weights, epochs, share).withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)))
    dealt = materialise(dealt.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mixing-leaves")
    placed = rows.join(small(dealt.select(*levels, "whole", "rest")), levels).where("rest > 0").withColumn("_order", order_of(seed, F.col("whole"), "_key"))
    near, ends = placed.withColumn("_from", F.lit(0).cast("long")), None
    to_here = W.partitionBy(*levels).orderBy("_range")
    for digits in RANGES:
        near = near.withColumn("_range", F.substring("_order", 1, digits))
        ranges = near.groupBy(*levels, "rest", "_from", "_range").agg(F.sum("_n").alias("_sum"))
        ranges = ranges.withColumn("_end", F.col("_from") + F.sum("_sum").over(to_here)).withColumn("_from", F.col("_end") - F.col("_sum"))
        ends = ranges.where("_end > rest").groupBy(*levels).agg(F.min(F.struct("_range", "_from")).alias("_at")).select(*levels, "_at.*")
        ends = small(materialise(ends, "mixing-ends"))
        near = near.drop("_from").join(ends, [*levels, "_range"])
    running = near.withColumn("_to", F.col("_from") + F.sum("_n").over(W.partitionBy(*levels).orderBy("_order", "_key").rangeBetween(W.unboundedPreceding, 0)))
    last = running.where("_to <= rest").groupBy(*levels).agg(F.max(F.struct("_order", "_key")).alias("_last"))
    return dealt.join(ends.select(*levels, "_range"), levels, "left").join(last, levels, "left")


def mix(
    docs: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], key: str = "doc_id", text: str = "text", epochs: int = 4, share: float = 1.0, seed: int = 7
) -> DataFrame:
    """docs' selected rows with `epoch` (from 0), a row for each epoch a document is taken in."""
    leaves = plan(docs, levels, weights, key, text, epochs, share, seed)
    names = [f"l{i}" for i in range(len(levels))]
    table = leaves.select(*(F.col(c).alias(n) for c, n in zip(levels, names, strict=True)), "whole", "rest", F.col("_range").alias("end"), F.col("_last").alias("last"))
    table = materialise(table, "mixing-plan")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(key).alias("key"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in zip(levels, names, strict=True)))
    order = order_of(seed, F.col("whole"), "key")
    within = F.col("end").isNull() | (F.substring(order, 1, RANGES[-1]) < F.col("end"))
    within = within | (F.col("last").isNotNull() & (F.struct(order.alias("_order"), F.col("key").alias("_key")) <= F.col("last")))
    times = F.col("whole") + F.when((F.col("rest") > 0) & within, 1).otherwise(0)
    taken = rows.join(small(table), names).withColumn("times", times).where("times > 0")
    return taken.select("own.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias(fresh("epoch", docs.columns)))
