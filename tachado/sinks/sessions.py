"""Session persistence: an upsert by id over append-only files.

Saving appends a file of (session_id, data, updated_at), so writers never rewrite what is there and a lost task leaves
nothing half done; loading takes each session's latest row, by time, then by data.

Defined cases: rows with a null id are not saved; of repeated ids in one save the greatest data counts; a null data is a
session without data; loading from a folder that nothing was saved to gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "session_id string, data string, updated_at timestamp"


def state(**columns: Column) -> Column:
    """Columns as one JSON text, nulls kept."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())), {"ignoreNullFields": "false"})


def save(sessions: DataFrame, path: str) -> None:
    """sessions: session_id, data (see state), and updated_at if it is not to be now."""
    at = F.col("updated_at") if "updated_at" in sessions.columns else F.current_timestamp()
    rows = sessions.where("session_id is not null").select(F.col("session_id").cast("string").alias("session_id"), F.col("data").cast("string").alias("data"), at.cast("timestamp").alias("updated_at"))
    rows.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """session_id, data, updated_at: each session as it was saved last."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    last = spark.read.schema(SCHEMA).parquet(path).groupBy("session_id").agg(F.max(F.struct("updated_at", "data")).alias("x"))
    return last.select("session_id", "x.data", "x.updated_at")
