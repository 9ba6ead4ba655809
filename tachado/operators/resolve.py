"""Identity linking inside a document: blocked pairs, fuzzy rules, near identifiers, components, groups.

Linking never leaves a document, whose mentions are bounded by its own text, so a document is linked whole in one row:
`linked` takes a row's array of mentions, prepares names, tokens and surnames as expressions, and compares pairs in Arrow
batches. From the analysis' rows nothing is shuffled; a table of stored mentions is gathered by document once
(`edges`, `groups`). Candidates are blocked: equal names once, persons by surname, others by a band of lengths that the
wanted score allows.

`components` and `clusters` do the last steps on stored or edited links.

Defined cases: a document without mentions has no links; null surfaces count as empty names; rows of one key are one
document (give the analysis' `row` where keys repeat), null keys one of their own; mentions of equal place follow
by id; columns beyond the named ones are not looked at; empty tables give empty ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions.fuzzy import subsequence
from ..functions.lexicon import Lexicon
from ..functions.text import name_tokens, normalize_mention, surnames, trim_white
from .filters import let

# Scores that link, and characters between an identifier and a name.
HIGH, MEDIUM, NEAR = 92.0, 85.0, 200
#: A score of MEDIUM needs a length of at least this share of the longer one (rounded down).
RATIO = 0.739
MENTION = "struct<ord:int,mention_id:string,cat:string,surface:string,start:int>"
EDGE = "struct<src:int,dst:int,weight:double,reason:string>"
GROUP = "struct<cluster_id:string,cat:string,canonical_label:string,placeholder:string,mention_ids:array<string>,surfaces:array<string>,confidence:string,status:string,reasons:array<string>>"


def same_by_initials(a: list[str], b: list[str], sa: list[str], sb: list[str]) -> bool:
    """Same person by initials: a shared surname, and first initials or initial strings that agree."""
    if not a or not b or not set(sa) & set(sb):
        return False
    x, y = ("".join(t[:1] for t in tokens) for tokens in (a, b))
    if any(len(t.replace(".", "")) <= 2 for t in a + b):
        return x[:1] == y[:1] or x in y or y in x
    return a[0] == b[0] and (x.startswith(y) or y.startswith(x))


def ratio(a: str, b: str) -> float:
    """Token-sort ratio of two names (see fuzzy.token_sort_ratio), 0 where the lengths rule out MEDIUM."""
    x, y = (" ".join(sorted(s.split())) for s in (a, b))
    if x == y:
        return 100.0
    total = len(x) + len(y)
    return 0.0 if 200.0 * min(len(x), len(y)) < MEDIUM * total else 200.0 * subsequence(x, y) / total


def _pairs(reps: list[dict]):
    """Candidate pairs of one category's distinct names, each once."""
    if reps[0]["cat"] == "PERSONA":
        blocks: dict[str, list[dict]] = {}
        for m in reps:
            for s in m["surnames"] or m["tokens"][:1] or ["_unknown"]:
                blocks.setdefault(s, []).append(m)
        seen = set()
        for block in blocks.values():
            for i, x in enumerate(block):
                for y in block[i + 1 :]:
                    if (x["ord"], y["ord"]) not in seen:
                        seen.add((x["ord"], y["ord"]))
                        yield x, y
        return
    by_length = sorted(reps, key=lambda m: len(m["norm"]))
    for i, x in enumerate(by_length):
        for y in by_length[i + 1 :]:
            if len(x["norm"]) < RATIO * len(y["norm"]) - 1:
                break
            yield (x, y) if x["ord"] < y["ord"] else (y, x)


def links_of(mentions: list[dict]) -> list[tuple[int, int, float, str]]:
    """(src, dst, weight, reason) of one document's mentions, in order; src before dst."""
    out, first = [], {}
    for m in mentions:
        head = first.setdefault((m["cat"], m["norm"]), m)
        if head is not m:
            out.append((head["ord"], m["ord"], 1.0, "exact"))
    by_cat: dict[str, list[dict]] = {}
    for m in first.values():
        by_cat.setdefault(m["cat"], []).append(m)
    for cat, reps in by_cat.items():
        for x, y in _pairs(reps):
            if cat == "PERSONA":
                if same_by_initials(x["tokens"], y["tokens"], x["surnames"], y["surnames"]):
                    out.append((x["ord"], y["ord"], 0.93, "initials_match"))
                elif set(x["surnames"]) & set(y["surnames"]) and (score := ratio(x["norm"], y["norm"])) >= MEDIUM:
                    out.append((x["ord"], y["ord"], max(score / 100, 0.88), "shared_surname"))
            elif (score := ratio(x["norm"], y["norm"])) >= MEDIUM:
                out.append((x["ord"], y["ord"], score / 100, "fuzzy_high" if score >= HIGH else "fuzzy_medium"))
    people = [m for m in mentions if m["cat"] == "PERSONA"]
    near = set()
    for d in (m for m in mentions if m["cat"] in ("DNI", "CUIT")):
        close = [m for m in people if abs(m["start"] - d["start"]) <= NEAR]
        for i, x in enumerate(close):
            for y in close[i + 1 :]:
                if (x["ord"], y["ord"]) not in near and (same_by_initials(x["tokens"], y["tokens"], x["surnames"], y["surnames"]) or ratio(x["norm"], y["norm"]) >= HIGH):
                    near.add((x["ord"], y["ord"]))
    return out + [(x, y, 0.95, "shared_identifier") for x, y in sorted(near)]


def roots(links) -> dict[int, int]:
    """The smallest member reachable from each end of the links (src, dst, ...)."""
    parent: dict[int, int] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, *_ in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in sorted(parent)}


def groups_of(mentions: list[dict], links: list[tuple]) -> list[dict]:
    """Suggested groups of one document; numbers count all components, single mentions included, by first appearance."""
    root = roots(links)
    parts: dict[int, list[dict]] = {}
    for m in mentions:
        parts.setdefault(root.get(m["ord"], m["ord"]), []).append(m)
    why: dict[int, list[tuple]] = {}
    for e in links:
        why.setdefault(root[e[0]], []).append(e)
    out = []
    for n, first in enumerate(sorted(parts)):
        own = parts[first]
        surfaces = list(dict.fromkeys(m["surface"] for m in own))
        if len(own) < 2 or all(re.fullmatch(r"\d+", x) for x in surfaces) or all(len(x) < 4 for x in surfaces):
            continue
        if own[0]["cat"] == "DOMICILIO" and not any(len(x) > 15 or "calle" in x.lower() or "av" in x.lower() for x in surfaces):
            continue
        reasons, top = sorted({e[3] for e in why[first]}), max(e[2] for e in why[first])
        sure = top >= 0.92 or set(reasons) & {"shared_identifier", "exact", "initials_match", "fuzzy_high"}
        out.append({
            "cluster_id": f"sug_{n}", "cat": own[0]["cat"], "canonical_label": None, "placeholder": None, "mention_ids": [m["mention_id"] for m in own], "surfaces": surfaces,
            "confidence": "alta" if sure else "media" if top >= 0.85 or "shared_surname" in reasons else "baja", "status": "suggested", "reasons": reasons,
        })
    return out


def group_arrays():
    """Arrow's type of array<GROUP>."""
    import pyarrow as pa

    fields = ("cluster_id", "cat", "canonical_label", "placeholder", "mention_ids", "surfaces", "confidence", "status", "reasons")
    return pa.list_(pa.struct([(n, pa.list_(pa.string()) if n in ("mention_ids", "surfaces", "reasons") else pa.string()) for n in fields]))


def prepared(mentions: Column, lex: Lexicon) -> Column:
    """mentions (array<MENTION>, in order) as links_of and groups_of take them: surfaces trimmed, with norm, and tokens and surnames of persons."""

    def one(x: Column) -> Column:
        norm = normalize_mention(F.coalesce(x["surface"], F.lit("")))
        parts = lambda n: F.when(x["cat"] == "PERSONA", name_tokens(n)).otherwise(F.array().cast("array<string>"))
        whole = lambda n: let(parts(n), lambda t: F.struct(
            x["ord"].alias("ord"), x["mention_id"].alias("mention_id"), x["cat"].alias("cat"), trim_white(F.coalesce(x["surface"], F.lit(""))).alias("surface"), x["start"].alias("start"), n.alias("norm"),
            t.alias("tokens"), F.coalesce(surnames(t, lex.surnames), F.array().cast("array<string>")).alias("surnames"),
        ))
        return let(norm, whole)

    return F.transform(mentions, one)


def linked(rows: DataFrame, mentions: Column, lex: Lexicon, *keep: str) -> DataFrame:
    """The columns to keep, edges (array<EDGE>) and groups (array<GROUP>) of each row's mentions (array<MENTION>, in order)."""
    names = [*(f"c{i}" for i in range(len(keep))), "edges", "groups"]
    own = rows.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=False)), prepared(mentions, lex).alias("m"))

    def run(batches):
        import pyarrow as pa

        edge = pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("weight", pa.float64()), ("reason", pa.string())]))
        for b in batches:
            found = [m or [] for m in arrow.values(b.column(b.num_columns - 1))]
            links = [links_of(m) for m in found]
            edges = [[dict(zip(("src", "dst", "weight", "reason"), e, strict=True)) for e in x] for x in links]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], arrow.array(edges, edge), arrow.array([groups_of(m, x) for m, x in zip(found, links, strict=True)], group_arrays())], names=names)

    kinds = dict(own.dtypes) | {"edges": f"array<{EDGE}>", "groups": f"array<{GROUP}>"}
    return own.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names)).toDF(*keep, "edges", "groups")


def gathered(found: DataFrame, lex: Lexicon, key: str = "doc_id") -> DataFrame:
    """key, edges, groups of a table of mentions (key, ord, mention_id, cat, surface, start): one shuffle by document."""
    one = F.struct("ord", "mention_id", "cat", "surface", "start").cast(MENTION)
    rows = found.select(F.col(key).alias("key"), one.alias("m")).groupBy("key").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return linked(rows, F.col("m"), lex, "key").withColumnRenamed("key", key)


def edges(found: DataFrame, lex: Lexicon, key: str = "doc_id") -> DataFrame:
    """key, src, dst (ord of mentions, src before dst), weight, reason."""
    return gathered(found, lex, key).select(key, F.explode("edges").alias("e")).select(key, "e.*")


def groups(found: DataFrame, lex: Lexicon, key: str = "doc_id") -> DataFrame:
    """key and the fields of GROUP: the suggested groups of a table of mentions."""
    return gathered(found, lex, key).select(key, F.explode("groups").alias("g")).select(key, "g.*")


def components(links: DataFrame, key: str = "doc_id") -> DataFrame:
    """links (key, src, dst) -> key, ord, component: the smallest ord reachable in the document.

    A document's links are gathered into one array (its mentions are bounded by its own text) and labelled by a fold
    that runs once a link and pass, so all documents are done in one job.
    """
    per_doc = links.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("e"))

    def label(batches):
        import pyarrow as pa

        for b in batches:
            out = {"k": [], "ord": [], "component": []}
            for k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x, r in roots((s["src"], s["dst"]) for s in e).items():
                    out["k"].append(k)
                    out["ord"].append(x)
                    out["component"].append(r)
            yield pa.RecordBatch.from_arrays([pa.array(out["k"], b.column(0).type), pa.array(out["ord"], pa.int32()), pa.array(out["component"], pa.int32())], names=list(out))

    kind = dict(per_doc.dtypes)[key]
    return per_doc.select(F.col(key).alias("k"), "e").mapInArrow(label, f"k {kind}, ord int, component int").withColumnRenamed("k", key)


def clusters(found: DataFrame, links: DataFrame, key: str = "doc_id") -> DataFrame:
    """Suggested groups: cluster_id, cat, mention_ids, surfaces, confidence, status, reasons.

    sug_n counts all components of a document, single mentions included, by first appearance. Groups of digits only, of
    surfaces shorter than 4, and of short addresses without a street word are not suggested.
    """
    comps = components(links, key)
    alone = found.join(comps, [key, "ord"], "left").withColumn("component", F.coalesce("component", "ord"))
    rank = alone.select(key, "component").distinct().withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("component")) - 1)
    surface = trim_white(F.col("surface"))
    groups = alone.groupBy(key, "component").agg(
        F.min_by("cat", "ord").alias("cat"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "mention_id", surface.alias("s")))), lambda x: F.struct(x["mention_id"].alias("m"), x["s"].alias("s"))).alias("_m")
    ).where(F.size("_m") >= 2)
    groups = groups.withColumn("surfaces", F.array_distinct(F.transform("_m", lambda x: x["s"]))).withColumn("mention_ids", F.transform("_m", lambda x: x["m"]))
    s = F.col("surfaces")
    street = F.exists(s, lambda x: (F.length(x) > 15) | F.contains(F.lower(x), F.lit("calle")) | F.contains(F.lower(x), F.lit("av")))
    groups = groups.where(~F.forall(s, lambda x: x.rlike(r"^(?U)\d+$")) & ~F.forall(s, lambda x: F.length(x) < 4) & ((F.col("cat") != "DOMICILIO") | street))
    why = links.join(comps.withColumnRenamed("ord", "src"), [key, "src"]).groupBy(key, "component").agg(F.sort_array(F.collect_set("reason")).alias("reasons"), F.max("weight").alias("_w"))
    has = lambda *names: F.arrays_overlap("reasons", F.array(*map(F.lit, names)))
    sure = has("shared_identifier", "exact", "initials_match", "fuzzy_high") | (F.col("_w") >= 0.92)
    likely = has("shared_surname", "proximity") | (F.col("_w") >= 0.85)
    out = groups.join(why, [key, "component"]).join(rank, [key, "component"])
    return out.select(
        key, F.concat(F.lit("sug_"), F.col("_n").cast("string")).alias("cluster_id"), "cat", F.lit(None).cast("string").alias("canonical_label"), F.lit(None).cast("string").alias("placeholder"),
        "mention_ids", "surfaces", F.when(sure, "alta").when(likely, "media").otherwise("baja").alias("confidence"), F.lit("suggested").alias("status"), "reasons",
    )
