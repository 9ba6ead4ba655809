"""Accent- and case-blind literal search with offsets in the original text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, fold_search
from .scan import literal, spans


def fold(query: str) -> str:
    return query.lower().translate(str.maketrans(ACCENTED, PLAIN))


def matches(text: Column, query: str) -> Column:
    """array<struct<start,end,raw>> of non-overlapping matches; raw is the original's text. Empty queries match nothing."""
    if not query.strip():
        return F.array().cast("array<struct<start:int,end:int,raw:string>>")
    found = spans(fold_search(text), literal(fold(query.strip())))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("raw")))


def search(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a match: key, start, end, raw."""
    return docs.select(key, F.explode(matches(F.col(text), query)).alias("m")).select(key, "m.start", "m.end", "m.raw")
