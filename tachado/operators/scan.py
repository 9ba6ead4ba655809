"""One pattern's spans as Column expressions, without Python: mark, split, and fold running offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private-use marks put around each match; texts that hold them lose them first (see `has_marks`).
OPEN, CLOSE = chr(0xE000), chr(0xE001)
SPAN = "array<struct<start:int,end:int,raw:string>>"


def has_marks(text: Column) -> Column:
    """True where a text holds the marks themselves, so that spans() would count offsets without them."""
    return F.coalesce(text.rlike(f"[{OPEN}{CLOSE}]"), F.lit(False))


def spans(text: Column, pattern: str, fold: bool = False) -> Column:
    """array<struct<start,end,raw>> of all matches, in code points, half-open; null text gives an empty array."""
    clean = F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "")
    marked = F.regexp_replace(clean, ("(?iuUd)" if fold else "(?uUd)") + f"({pattern})", f"{OPEN}$1{CLOSE}")
    parts = F.split(marked, OPEN, -1)
    begin = F.struct(F.length(F.element_at(parts, 1)).cast("int").alias("at"), F.array().cast(SPAN).alias("found"))

    def add(acc: Column, part: Column) -> Column:
        raw = F.substring_index(part, CLOSE, 1)
        hit = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(raw)).cast("int").alias("end"), raw.alias("raw"))
        return F.struct((acc["at"] + F.length(part) - 1).cast("int").alias("at"), F.concat(acc["found"], F.array(hit)).alias("found"))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), begin, add, lambda acc: acc["found"])


def literal(value: str) -> str:
    """A pattern that matches a literal text."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in value)
