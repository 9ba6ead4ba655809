"""What a reviewer is shown: similar detections, candidates for a group, labels, filters, summaries.

Defined cases: null keys meet nothing; texts without letters or digits are like nothing; a group without surfaces or label
is named by placeholder or id; of equally long surfaces the first names the group; repeated rows are rows of their own;
empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_accents, trim_white


def matching_text(x: Column) -> Column:
    """Without accents, a copy's label in front, and marks; lower case."""
    t = F.regexp_replace(strip_accents(x), r"(?i)^(original|duplicado|triplicado|cuadruplicado|copia|anexo)\s+", "")
    return F.lower(trim_white(F.regexp_replace(F.regexp_replace(t, r"[^\w\s]", " "), r"\s+", " ")))


def similar(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, a, b (detection ids, a before b): same category and equal, contained, equal digits, or shared words."""
    flat = matching_text(F.col("original"))
    tokens = F.filter(F.split(flat, " "), lambda t: (F.length(t) > 2) & ~t.isin("de", "del", "la", "las", "los", "y"))
    rows = found.select(key, "id", "cat", flat.alias("t"), F.regexp_replace(flat, r"\D", "").alias("d"), tokens.alias("w")).where("t <> ''")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.cat") == F.col("b.cat")) & (F.col("a.id") < F.col("b.id")))
    shared = F.size(F.filter("a.w", lambda t: F.array_contains(F.col("b.w"), t)))
    words = (shared >= 2) | ((shared == 1) & (F.least(F.size("a.w"), F.size("b.w")) <= 2))
    other = F.when(F.col("a.cat") == "PERSONA", words).otherwise((F.col("a.d") != "") & (F.col("a.d") == F.col("b.d")))
    return pairs.where(F.contains("a.t", F.col("b.t")) | F.contains("b.t", F.col("a.t")) | other).select(F.col(f"a.{key}").alias(key), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def available(found: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, cluster_id, id: detections without a group that a group could take."""
    inside = F.transform("surfaces", lambda s: F.lower(trim_white(s)))
    g = groups.select(F.col(key).alias("_k"), "cluster_id", F.col("cat").alias("_cat"), inside.alias("_in"))
    d = found.where("cluster_id is null").select(key, "id", "cat", F.lower(trim_white(F.col("original"))).alias("_low"))
    fits = (F.col(key) == F.col("_k")) & ((F.col("cat") == F.col("_cat")) | (F.col("_cat") == "PERSONA"))
    return d.join(g, fits).where(~F.array_contains(F.col("_in"), F.col("_low"))).select(key, "cluster_id", "id")


def labelled(groups: DataFrame) -> DataFrame:
    """groups with `label`: a canonical label that is no placeholder, else the longest surface, else placeholder or id."""
    canonical = F.when(F.col("canonical_label").isNotNull() & (F.col("canonical_label") != "") & ~F.col("canonical_label").rlike(r"^\s*\[[A-Z_]+(?:_\d+)?\]\s*$"), F.col("canonical_label"))
    longest = F.array_sort(F.transform("surfaces", lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))
    return groups.withColumn("label", F.coalesce(canonical, F.try_element_at(longest, F.lit(1))["s"], F.col("placeholder"), F.col("cluster_id")))


def filtered(groups: DataFrame, query: str) -> DataFrame:
    """Groups whose label, placeholder, category or surfaces hold the query, whatever the case."""
    text = F.lower(F.concat_ws(" ", "label", "placeholder", "cat", F.array_join("surfaces", " ")))
    return labelled(groups).where(F.contains(text, F.lit(query.strip().lower())))


def merge_candidates(groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, source, target: other groups of the document of the same category, or where either is of persons."""
    a, b = groups.select(key, "cluster_id", "cat").alias("a"), groups.select(key, "cluster_id", "cat").alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.cluster_id") != F.col("b.cluster_id")))
    fits = (F.col("a.cat") == F.col("b.cat")) | (F.col("a.cat") == "PERSONA") | (F.col("b.cat") == "PERSONA")
    return pairs.where(fits).select(F.col(f"a.{key}").alias(key), F.col("a.cluster_id").alias("source"), F.col("b.cluster_id").alias("target"))


def summary(docs: DataFrame, found: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chars, detections, clusters."""
    counts = found.groupBy(key).agg(F.count("*").alias("detections"))
    grouped = groups.groupBy(key).agg(F.count("*").alias("clusters"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select(key, F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars")).join(counts, key, "left").join(grouped, key, "left").select(key, "chars", zero("detections"), zero("clusters"))
