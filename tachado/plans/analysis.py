"""The whole analysis: scan, validity, sweep, detections, pruning, substitution and linking, each in the document's own row.

One table is written: a row a document with its mentions, detections and anonymised text, under a number of its own
(`row`). All else is read from it, and nothing is shuffled. Documents of one key, or without a key, are therefore told
apart.

Defined cases: a null text has no mentions and stays null; repeated and null keys are documents of their own (their rows
tell them apart); an empty table gives empty ones; columns other than key and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CATEGORIES, Lexicon, load
from ..functions.text import trim_white
from ..operators import anonymize, detect, detections, filters, resolve, review
from .work import settle


@dataclass
class Analysis:
    mentions: DataFrame
    detections: DataFrame
    edges: DataFrame
    clusters: DataFrame
    statistics: DataFrame
    anonymized: DataFrame


def in_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "cat", categories: list[str] | None = None, lexicon: Lexicon | None = None, catalog: str | None = None
) -> DataFrame:
    """key, mentions, detections (pruned), anonymized_text: all of a document in its own row, nothing shuffled."""
    lex = lexicon or load()
    rows = detect.scan(docs, lex, key, text, catalog).toDF("key", "text", "hits")
    rows = rows.withColumn("m", filters.held(detections.mention_array(F.col("hits"), lex, categories))).withColumn("d", filters.held(detections.pruned_row(detections.in_row(F.col("m"), mode))))
    return rows.select(F.col("key").alias(key), F.col("m").alias("mentions"), F.col("d").alias("detections"), anonymize.in_row(F.col("text"), F.col("d")).alias("anonymized_text"))


def mention_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """in_rows()'s mentions as a table: the columns to keep, ord, mention_id, cat, surface, start, end, norm, source_layer, left, right."""
    m = rows.select(*keep, F.posexplode("mentions").alias("ord", "m"))
    return m.select(
        *keep, "ord", F.concat(F.lit("m"), F.col("ord").cast("string")).alias("mention_id"), "m.cat", "m.surface", "m.start", "m.end", F.lower(trim_white(F.col("m.surface"))).alias("norm"),
        F.col("m.layer").alias("source_layer"), "m.left", "m.right",
    )


def detection_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """in_rows()'s detections as a table."""
    return rows.select(*keep, F.explode("detections").alias("d")).select(*keep, "d.*")


def _place(h: Column, i: Column) -> Column:
    return F.struct(i.cast("int").alias("ord"), F.concat(F.lit("m"), i.cast("string")).alias("mention_id"), h["cat"].alias("cat"), h["surface"].alias("surface"), h["start"].alias("start"))


def link_rows(rows: DataFrame, lex: Lexicon, *keep: str) -> DataFrame:
    """The columns to keep, edges and groups (arrays) of in_rows()'s mentions."""
    return resolve.linked(rows, F.transform("mentions", _place), lex, *keep)


def statistics_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, a column a category (enabled detections, zeros included), TOTAL; of documents with a detection."""
    n = lambda c: F.size(F.filter("detections", lambda d: (d["cat"] == c) & d["enabled"])).cast("bigint").alias(c)
    return rows.where(F.size("detections") > 0).select(*keep, *map(n, CATEGORIES), F.size("detections").cast("bigint").alias("TOTAL"))


def reviewed(docs: DataFrame, key: str = "doc_id", text: str = "text", acts: str = "acts", mode: str = "cat", lexicon: Lexicon | None = None, catalog: str | None = None) -> DataFrame:
    """review.replay() of documents that bring their actions, all in the document's own row: nothing is written, shuffled or joined.

    acts: array of seq, action, args (map of strings); documents without any are left out.
    """
    lex = lexicon or load()
    ordered = F.sort_array(F.transform(acts, lambda a: F.struct(a["seq"].cast("bigint").alias("seq"), a["action"].alias("action"), F.map_entries(a["args"]).alias("args"))))
    own = docs.where(F.size(acts) > 0).select(F.col(key).alias("k"), F.col(text).alias("text"), ordered.alias("acts"))
    rows = detect.scan(own, lex, "k", "text", catalog, carry=["acts"])
    rows = rows.withColumn("m", filters.held(detections.mention_array(F.col("hits"), lex))).withColumn("d", filters.held(detections.pruned_row(detections.in_row(F.col("m"), mode))))
    # Without the text about each span, which nothing below needs.
    named = lambda m, i: F.struct(F.concat(F.lit("m"), i.cast("string")).alias("mention_id"), m["cat"].alias("cat"), m["surface"].alias("surface"), m["start"].alias("start"), m["end"].alias("end"))
    mentions = F.coalesce(F.transform("m", named), F.array()).cast(f"array<{review.MENTION}>")
    found = F.transform("d", lambda d: d.dropFields("left", "right")).cast(f"array<{review.DETECTION}>")
    rows = rows.select("k", "text", "acts", filters.held(mentions).alias("mentions"), filters.held(found).alias("detections"))
    state = rows.withColumn("linkable", resolve.prepared(F.transform("mentions", _place), lex))
    return review.replayed(state, lex, mode).withColumnRenamed("k", key)


def analyze(docs: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "cat", categories: list[str] | None = None, lexicon: Lexicon | None = None, catalog: str | None = None) -> Analysis:
    """Tables of everything an analysis yields, each with key and row. Documents are written once; the rest is lazy."""
    lex = lexicon or load()
    rows = settle(in_rows(docs, key, text, mode, categories, lex, catalog).withColumn("row", F.monotonically_increasing_id()), "analysis")
    links = link_rows(rows, lex, key, "row")
    each = lambda column: links.select(key, "row", F.explode(column).alias("x")).select(key, "row", "x.*")
    return Analysis(mention_rows(rows, key, "row"), detection_rows(rows, key, "row"), each("edges"), each("groups"), statistics_rows(rows, key, "row"), rows.select(key, "row", "anonymized_text"))


def cancel(spark, tag: str) -> None:
    """Interrupts the jobs started under a tag (see spark.addTag)."""
    spark.interruptTag(tag)
