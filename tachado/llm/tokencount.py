"""Token counts of whole texts by heap-and-linked-list byte-pair merging (see bpe.TokenCounter).

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null key stays null; repeated rows each
get a row; an empty table gives an empty one. Texts are never cut, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TokenCounter
from .common import text_of


def token_counts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit). vocabulary: path of a word-end BPE .json."""

    def count(batches):
        import pyarrow as pa

        counter = TokenCounter(vocabulary)
        for b in batches:
            texts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([counter.count(t) for t in texts], pa.int64())], names=["k", "n_bytes", "n_tokens"])

    own = df.select(F.col(key).alias("k"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("t"))
    kind = dict(own.dtypes)["k"]
    out = own.mapInArrow(count, f"k {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
