"""Shared helpers of the corpus operators: work folders, whole-text inputs, bounded lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side table may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 50_000


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local run gets one of its own.

    On a cluster a folder of the driver's own would be another one on each executor, so there the setting must be given.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tachado-')}"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/tachado/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Written tables of one operator, which go together once what is made of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_folder(self.spark, name))
        return materialise(df, name, self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(name: str, columns: list[str]) -> str:
    """A name that none of the columns has (Spark's names know no case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bits of the fixed-size id filter below (2 MiB in all, whatever the input's size).
FILTER_BITS = 24


def _slot(column: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(column)), 64 - FILTER_BITS)


def id_filter(ids: DataFrame, column: str) -> DataFrame:
    """A one-hash bit filter of ids: at most 2**(FILTER_BITS-6) rows (word, bits), so safe to broadcast."""
    return (
        ids.where(F.col(column).isNotNull())
        .select(_slot(column).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    )


def maybe_in(df: DataFrame, column: str, bits: DataFrame, hit: str = "_hit") -> DataFrame:
    """df with a boolean `hit`: false only if the row's id is certainly not in the filter's ids."""
    slot, word, found = (fresh(x, [*df.columns, hit]) for x in ("_slot", "_word", "_bits"))
    table = F.broadcast(bits.select(F.col("word").alias(word), F.col("bits").alias(found)))
    joined = df.withColumn(slot, _slot(column)).withColumn(word, F.shiftright(slot, 6)).join(table, word, "left")
    inside = F.expr(f"coalesce(shiftrightunsigned({found}, cast({slot} & 63 as int)) & 1, 0) = 1")
    return joined.withColumn(hit, inside & F.col(column).isNotNull()).select(*df.columns, hit)


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df's rows whose key is not in ids (key). Only rows that pass the id filter are joined; others do not move."""
    columns, hit = df.columns, fresh("_hit", df.columns)
    marked = maybe_in(df, key, id_filter(ids, key), hit)
    return marked.where(~F.col(hit)).select(*columns).unionByName(marked.where(hit).join(ids, key, "left_anti").select(*columns))
