"""All pairs of rows in a block, with a score of their texts that is worked out once for each pair of different texts.

Rows of one block and text are a class. Classes are paired and scored, and only then spread into the pairs of their rows, so
the scoring grows with the different texts and the rest is plain copying in the JVM. Classes are cut into chunks and blocks
dealt over tasks, so neither a common text nor a large block is one task's.

Defined cases: null texts count as empty; rows with a null key or a null in the block have no pairs; rows that repeat a key
pair with all others, but not with each other; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a class that lie in one array, and tasks that a block's pairs are dealt over.
CHUNK, DEALT = 1024, 8


def scored_pairs(df: DataFrame, key: str, block: list[str], text: str, score: Callable[[Column, Column], Column]) -> DataFrame:
    """src, dst, score: each pair of rows of one block, the smaller key first. score: symmetric, of two texts."""
    by = [f"b{i}" for i in range(len(block))]
    rows = df.select(F.col(key).alias("k"), *(F.col(c).alias(n) for c, n in zip(block, by, strict=True)), F.coalesce(F.col(text), F.lit("")).alias("t")).dropna(subset=["k", *by])
    chunk = F.floor((F.row_number().over(W.partitionBy(*by, "t").orderBy("k")) - 1) / CHUNK)
    classes = rows.withColumn("n", chunk).groupBy(*by, "t", "n").agg(F.collect_list("k").alias("ks"))
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = classes.select(*by, F.pmod(F.xxhash64("t", "n"), F.lit(DEALT)).cast("int").alias("part"), F.col("t").alias("x"), F.col("n").alias("xn"), F.col("ks").alias("xs"))
    right = classes.select(*by, F.explode(F.array(*map(F.lit, range(DEALT)))).alias("part"), F.col("t").alias("y"), F.col("n").alias("yn"), F.col("ks").alias("ys"))
    both = left.repartition(tasks, *by, "part").join(right, [*by, "part"]).where("x < y or x = y and xn <= yn")
    scored = both.select("xs", "ys", F.expr("x = y and xn = yn").alias("own"), score(F.col("x"), F.col("y")).alias("score"))
    each = scored.select(F.explode("xs").alias("p"), "ys", "own", "score").select("p", F.explode("ys").alias("q"), "own", "score")
    return each.where("p < q or p > q and not own").select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"), "score")
