"""Substitution of placeholders, and highlight ranges.

Texts never leave in clear by mistake: `anonymize` matches documents and detections by key, so a document without a key, or
one whose detections don't stand where they say (two documents of one key), gets no text at all (null). The analysis
substitutes inside each document's own row and needs no match.

Defined cases: a null text stays null; documents without detections keep their text; overlapping spans are replaced one
after the other; columns of the caller may have any names but anonymized_text; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trim_white

REPLACED = "array<struct<start:int,end:int,placeholder:string>>"


def substitute(text: Column, spans: Column) -> Column:
    """text with each span's placeholder, from the last start to the first, so that earlier offsets hold.

    spans: REPLACED; overlapping ones are replaced one after the other, as they come.
    """
    back = F.array_sort(spans, lambda x, y: F.when(x["start"] > y["start"], -1).when(x["start"] < y["start"], 1).otherwise(0))
    put = lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), s["placeholder"], F.substr(acc, s["end"] + 1))
    return F.aggregate(back, text, put)


def places(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each position of an enabled detection."""
    return found.where("enabled").select(key, "id", "cat", "placeholder", "cluster_id", F.explode("positions").alias("p")).select(
        key, "id", "cat", "placeholder", "cluster_id", "p.start", "p.end", "p.raw"
    )


def in_row(text: Column, found: Column) -> Column:
    """A document's text with the placeholders of its own detections (see detections.in_row)."""
    spans = F.flatten(F.transform(F.filter(found, lambda d: d["enabled"]), lambda d: F.transform(d["positions"], lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), d["placeholder"].alias("placeholder")))))
    return F.when(F.size(spans) > 0, substitute(text, F.sort_array(spans))).otherwise(text)


def anonymize(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", confirmed_only: bool = False) -> DataFrame:
    """docs with anonymized_text, null where it can't be told which detections are the document's.

    confirmed_only: only detections that belong to a group. Texts move only where detections of their key exist.
    """
    spans = places(found.where("cluster_id is not null") if confirmed_only else found, key)
    spans = spans.select(F.col(key).alias("key"), F.struct("start", "end", "placeholder", "raw").alias("s"))
    per_doc = spans.groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(per_doc, "key", "left")
    there = F.forall("spans", lambda s: trim_white(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])) == trim_white(s["raw"]))
    safe = F.col("key").isNotNull() & (F.col("spans").isNull() | F.coalesce(there, F.lit(False)))
    new = F.when(F.col("spans").isNull(), F.col("text")).otherwise(substitute(F.col("text"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["placeholder"].alias("placeholder")))))
    # Worked out first: inside a function of array elements, names would mean the columns that own.* brings.
    return rows.withColumn("new", F.when(safe, new)).select("own.*", F.col("new").alias("anonymized_text"))


def highlights(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Enabled positions in order of start, each beginning at or after the last kept end."""
    from .intervals import sweep

    kind = "array<struct<start:int,end:int,id:int,cat:string,placeholder:string,cluster_id:string>>"
    per_doc = places(found, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "id", "end", "cat", "placeholder", "cluster_id"))).alias("s"))
    ordered = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["id"].alias("id"), x["cat"].alias("cat"), x["placeholder"].alias("placeholder"), x["cluster_id"].alias("cluster_id")))
    return per_doc.select(key, F.explode(sweep(ordered, kind)).alias("h")).select(key, "h.start", "h.end", "h.cat", "h.placeholder", "h.cluster_id")


def propagate(found: DataFrame, pruned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pruned detections plus the dropped persons' positions under the longest kept name that contains them.

    Not the default: a pruned short name otherwise stays in clear text.
    """
    lost = found.where("cat = 'PERSONA'").join(pruned.select(key, "cat", F.lower("original").alias("_o")), [key, "cat"], "left_semi")
    lost = lost.withColumn("_low", F.lower("original")).alias("a")
    kept = pruned.where("cat = 'PERSONA'").select(F.col(key).alias("_k"), F.col("placeholder").alias("_p"), F.lower("original").alias("_long")).alias("b")
    pairs = lost.join(kept, (F.col(f"a.{key}") == F.col("b._k")) & (F.length("_low") < F.length("_long")) & F.contains("_long", F.col("_low")))
    best = pairs.withColumn("_r", F.row_number().over(W.partitionBy(f"a.{key}", "a.id").orderBy(F.desc(F.length("_long")), "_long"))).where("_r = 1")
    extra = best.withColumn("placeholder", F.col("_p")).select(*pruned.columns)
    return pruned.unionByName(extra)
