"""Mentions to detections: grouping by surface, placeholders, pruning, statistics, equivalences.

Two forms of the same semantics. `in_row` and `pruned_row` work on one document's array of spans, so nothing moves and
documents can't be mixed up, whatever their keys; the analysis uses them. `detections`, `prune` and `drop_contained`
work on tables of mentions by key, for mentions that were stored or edited.

Defined cases: a null array has no detections; a document without mentions has no rows in the tables; rows of one key are
one document to the table form (a null key is a key like others there); of equal surfaces the first in order names the
detection; columns of the caller beyond the named ones are not looked at; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import CATEGORIES, Lexicon
from ..functions.text import guard_formula, placeholder, trim_white
from . import filters, intervals
from .detect import SPAN

POSITIONS = "array<struct<start:int,end:int,raw:string>>"


def mention_array(hits: Column, lex: Lexicon, categories: list[str] | None = None) -> Column:
    """The valid, swept spans of a document's hits. categories: those enabled, all if none are given."""
    wanted = categories or CATEGORIES
    good = F.filter(hits, lambda h: filters.valid(h["cat"], h["surface"], h["left"], h["right"], lex))
    return intervals.sweep(good, f"array<{SPAN}>", lambda h: h["cat"].isin(*wanted))


def mentions(scanned: DataFrame, lex: Lexicon, key: str = "doc_id", categories: list[str] | None = None) -> DataFrame:
    """scanned (key, hits) -> a row a mention: key, ord, mention_id, cat, surface, start, end, norm, source_layer, left, right."""
    rows = scanned.select(key, filters.held(mention_array(F.col("hits"), lex, categories)).alias("all")).select(key, F.posexplode("all").alias("ord", "m"))
    return rows.select(
        key, "ord", F.concat(F.lit("m"), F.col("ord").cast("string")).alias("mention_id"), "m.cat", "m.surface", "m.start", "m.end",
        F.lower(trim_white(F.col("m.surface"))).alias("norm"), F.col("m.layer").alias("source_layer"), "m.left", "m.right",
    )


#: What in_row and pruned_row give of a document, in order of id.
DETECTION = (
    "struct<id:int,cat:string,original:string,placeholder:string,enabled:boolean,positions:array<struct<start:int,end:int,raw:string>>,mention_ids:array<string>,"
    "cluster_id:string,manual_placeholder:boolean,user_added:boolean,left:string,right:string>"
)


def in_row(spans: Column, mode: str = "cat") -> Column:
    """array<DETECTION> of a document's valid, swept spans: one for each (cat, surface without case), by first appearance."""

    def mention(h: Column, i: Column) -> Column:
        s = trim_white(h["surface"])
        whole = F.struct(i.cast("int").alias("ord"), s.alias("s"), F.lower(s).alias("low"), h.alias("h"))
        return whole

    def one(all_of: Column, kinds: Column):
        def build(k: Column, j: Column) -> Column:
            own = F.filter(all_of, lambda x: (x["h"]["cat"] == k["cat"]) & (x["low"] == k["low"]))
            n = F.size(F.filter(F.slice(kinds, F.lit(1), j + 1), lambda y: y["cat"] == k["cat"]))
            return filters.let(own, lambda m: _detection(j, k["cat"], n, m, mode))

        return build

    kinds = lambda all_of: F.array_distinct(F.transform(all_of, lambda x: F.struct(x["h"]["cat"].alias("cat"), x["low"].alias("low"))))
    found = filters.let(F.transform(spans, mention), lambda m: filters.let(kinds(m), lambda k: F.transform(k, one(m, k))))
    return F.coalesce(found, F.array()).cast(f"array<{DETECTION}>")


def _detection(j: Column, cat: Column, n: Column, m: Column, mode: str) -> Column:
    first = m[0]
    return F.struct(
        j.cast("int").alias("id"), cat.alias("cat"), first["s"].alias("original"), placeholder(cat, first["s"], n, mode).alias("placeholder"), F.lit(True).alias("enabled"),
        F.transform(m, lambda x: F.struct(x["h"]["start"].alias("start"), x["h"]["end"].alias("end"), x["h"]["surface"].alias("raw"))).alias("positions"),
        F.transform(m, lambda x: F.concat(F.lit("m"), x["ord"].cast("string"))).alias("mention_ids"), F.lit(None).cast("string").alias("cluster_id"),
        F.lit(False).alias("manual_placeholder"), F.lit(False).alias("user_added"), first["h"]["left"].alias("left"), first["h"]["right"].alias("right"),
    )


def pruned_row(found: Column, lex: Lexicon | None = None) -> Column:
    """A document's detections without persons contained in longer kept ones; ids run anew, persons last, longest first.

    lex: also drops those that fail validity at their first place (detections fresh from valid mentions can't).
    """
    low = lambda d: F.lower(trim_white(d["original"]))
    if lex is not None:
        found = F.filter(found, lambda d: d["user_added"] | filters.valid(d["cat"], d["original"], d["left"], d["right"], lex))
    person = lambda d: d["cat"] == "PERSONA"
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    some = lambda all_of, x, test: F.exists(all_of, lambda y: person(y) & (F.length(low(y)) > F.length(low(x))) & test(low(y), low(x)))
    whole = lambda big, part: F.contains(pad(big), pad(part))
    free = lambda x: ~person(x) | x["user_added"]
    long = lambda d: F.filter(d, lambda x: free(x) | (F.length(low(x)) < 4) | ~some(d, x, F.contains))
    short = lambda d: F.filter(d, lambda x: free(x) | (F.length(low(x)) >= 4) | ~some(d, x, whole))

    def ordered(d: Column) -> Column:
        placed = F.transform(F.filter(d, person), lambda x: F.struct((-F.length(x["original"])).alias("n"), x["id"].alias("id"), x.alias("d")))
        persons = F.transform(F.array_sort(placed, lambda a, b: _order(a, b)), lambda x: x["d"])
        both = F.concat(F.filter(d, lambda x: ~person(x)), persons)
        return F.transform(both, lambda x, i: x.withField("id", i.cast("int")))

    return filters.let(found, lambda a: filters.let(long(a), lambda b: filters.let(short(b), ordered)))


def _order(a: Column, b: Column) -> Column:
    by = lambda x, y, rest: F.when(x < y, -1).when(x > y, 1).otherwise(rest)
    return by(a["n"], b["n"], by(a["id"], b["id"], 0))


def detections(found: DataFrame, key: str = "doc_id", mode: str = "cat") -> DataFrame:
    """mentions -> a row for each (cat, surface without case): id and placeholder number by first appearance."""
    surface = trim_white(F.col("surface"))
    rows = found.withColumn("_key", F.lower(surface))
    span = F.struct("ord", "start", "end", F.col("surface").alias("raw"), "mention_id", surface.alias("original"), F.col("left"), F.col("right"))
    out = rows.groupBy(key, "cat", "_key").agg(F.array_sort(F.collect_list(span)).alias("_m"))
    out = out.withColumn("_first", F.col("_m")[0])
    number = F.row_number().over(W.partitionBy(key, "cat").orderBy("_first.ord"))
    out = out.withColumn("id", (F.row_number().over(W.partitionBy(key).orderBy("_first.ord")) - 1).cast("int")).withColumn("_n", number)
    return out.select(
        key, "id", "cat", F.col("_first.original").alias("original"), placeholder(F.col("cat"), F.col("_first.original"), F.col("_n"), mode).alias("placeholder"),
        F.lit(True).alias("enabled"), F.transform("_m", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["raw"].alias("raw"))).alias("positions"),
        F.transform("_m", lambda m: m["mention_id"]).alias("mention_ids"), F.lit(None).cast("string").alias("cluster_id"), F.lit(False).alias("manual_placeholder"),
        F.lit(False).alias("user_added"), F.col("_first.left").alias("left"), F.col("_first.right").alias("right"),
    )


def drop_contained(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leaves out persons contained in a longer kept person; manual ones stay. Shorter than 4: only whole words.

    For names of at least 4 characters containment is transitive, so testing against all longer names is the same as
    against the kept ones; the few shorter names are then tested against the kept. A document's detections (bounded by
    its own text) meet in one array, so there is one shuffle by document and no join.
    """
    low = F.when(F.col("cat") == "PERSONA", F.lower(trim_white(F.col("original")))).otherwise(F.lit(None)).alias("low")
    rows = found.groupBy(key).agg(F.collect_list(F.struct(low, F.struct(*found.columns).alias("row"))).alias("all"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    stays = lambda x: x["low"].isNull() | x["row"]["user_added"]
    longer = lambda x, y: F.length(y["low"]) > F.length(x["low"])
    some = lambda array, x, test: F.exists(array, lambda y: F.coalesce(longer(x, y) & test(y["low"], x["low"]), F.lit(False)))
    whole = lambda big, part: F.contains(pad(big), pad(part))
    kept = rows.withColumn("kept", F.filter("all", lambda x: stays(x) | (F.length(x["low"]) < 4) | ~some(F.col("all"), x, F.contains)))
    kept = kept.withColumn("kept", F.filter("kept", lambda x: stays(x) | (F.length(x["low"]) >= 4) | ~some(F.col("kept"), x, whole)))
    return kept.select(F.explode("kept.row").alias("row")).select("row.*")


def prune(found: DataFrame, lex: Lexicon, key: str = "doc_id") -> DataFrame:
    """Drops detections that fail validity at their first place, then contained persons; ids run anew, persons last.

    Placeholders keep their numbers, so numbering may have gaps.
    """
    good = found.where(F.col("user_added") | filters.valid(F.col("cat"), F.col("original"), F.col("left"), F.col("right"), lex))
    kept = drop_contained(good, key)
    person = F.col("cat") == "PERSONA"
    order = W.partitionBy(key).orderBy(person, F.when(person, -F.length("original")).otherwise(0), "id")
    return kept.withColumn("id", (F.row_number().over(order) - 1).cast("int"))


def statistics(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, a column a category (enabled detections, zeros included) and TOTAL (all)."""
    cells = [F.sum(F.when((F.col("cat") == c) & F.col("enabled"), 1).otherwise(0)).alias(c) for c in CATEGORIES]
    return found.groupBy(key).agg(*cells, F.count("*").alias("TOTAL"))


def equivalences(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The substitution table of the CSV export, formula prefixes guarded, with key and id for order."""
    return found.select(
        key, "id", guard_formula(F.col("cat")).alias("Tipo"), guard_formula(F.col("original")).alias("Original"), guard_formula(F.col("placeholder")).alias("Sustitución"),
        F.size("positions").cast("string").alias("Ocurrencias"), F.when(F.col("enabled"), F.lit("Sí")).otherwise(F.lit("No")).alias("Activa"),
        guard_formula(F.col("cluster_id")).alias("Cluster"),
    )
