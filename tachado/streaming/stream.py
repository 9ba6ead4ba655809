"""The per-document stages on a stream: detection and substitution need no state, so append mode suffices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon, load
from ..operators import anonymize, detect, detections


def anonymize_stream(docs: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "cat", lexicon: Lexicon | None = None, catalog: str | None = None) -> DataFrame:
    """docs (a stream or a table) -> key, anonymized_text, mentions; all inside one row, without a shuffle.

    Numbers run by first appearance of a surface in its category, as in the batch analysis; contained persons are not
    pruned, so their names don't stay in clear. Null texts stay null; null and repeated keys are documents of their own.
    """
    lex = lexicon or load()
    rows = detect.scan(docs, lex, key, text, catalog).toDF("key", "text", "hits").withColumn("m", detections.mention_array(F.col("hits"), lex))
    spans = F.transform("m", lambda h: F.struct(h["cat"].alias("cat"), h["surface"].alias("surface"), h["start"].alias("start"), h["end"].alias("end")))
    return rows.select(F.col("key").alias(key), anonymize.in_row(F.col("text"), detections.in_row(F.col("m"), mode)).alias("anonymized_text"), spans.alias("mentions"))
