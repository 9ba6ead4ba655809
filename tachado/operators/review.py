"""Review edits: an ordered log of actions, replayed over a document's detections, mentions and groups.

A document's state is one row of arrays, its actions one sorted array; both meet in a join on the document, and
only documents with actions go through the replay. Where a row holds all of a document already, nothing is joined
(`replayed`; see plans.analysis.reviewed). Generated ids come from the action's seq, so they never
repeat. An action that cannot apply (unknown id, bad range, blank text) changes nothing and is reported.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions.lexicon import GENERIC, NUMBERED, Lexicon, load
from ..functions.text import trim_white
from . import anonymize, detections, filters, resolve
from .detect import LEFT, PARTICLES, RIGHT, plain

DETECTION = "struct<id:int,cat:string,original:string,placeholder:string,enabled:boolean,positions:array<struct<start:int,end:int,raw:string>>,mention_ids:array<string>,cluster_id:string,manual_placeholder:boolean,user_added:boolean>"
CLUSTER = "struct<cluster_id:string,cat:string,canonical_label:string,placeholder:string,mention_ids:array<string>,surfaces:array<string>,confidence:string,status:string,reasons:array<string>>"
MENTION = "struct<mention_id:string,cat:string,surface:string,start:int,end:int>"


def label(cat: str, original: str, number: int, mode: str) -> str:
    if mode == "gen":
        return f"[{GENERIC.get(cat, cat)}]"
    if mode == "ini" and cat in ("PERSONA", "EMPRESA"):
        parts = [p for p in original.split() if p not in PARTICLES | {"i", "S.A.", "S.R.L.", "S.A.S.", "S.A.U."} and len(p) > 1]
        return "".join(p[0].upper() + "." for p in parts) or ("[NOMBRE]" if cat == "PERSONA" else "[EMPRESA]")
    return f"[{NUMBERED.get(cat, cat)}_{number}]"


# Labels of copies in front of a name, and words that don't count as shared.
COPY = re.compile(r"^(?:original|duplicado|triplicado|cuadruplicado|copia|anexo)\s+", re.I)
SHARED_NOT = {"de", "del", "la", "las", "los", "y"}


def matching_text(value: str) -> str:
    """Without a copy's label in front, marks and accents; lower case."""
    return " ".join(re.sub(r"[^\w\s]", " ", plain(COPY.sub("", value))).split())


def alike(cat: str, one: str, other: str) -> bool:
    """Equal, contained, of equal digits, or of shared words (see views.similar)."""
    a, b = matching_text(one), matching_text(other)
    if not a or not b:
        return False
    if a in b or b in a:
        return True
    if cat != "PERSONA":
        x, y = (re.sub(r"\D", "", t) for t in (a, b))
        return x != "" and x == y
    x, y = ([w for w in t.split() if len(w) > 2 and w not in SHARED_NOT] for t in (a, b))
    shared = sum(w in y for w in x)
    return shared >= 2 or shared == 1 and min(len(x), len(y)) <= 2


class Refused(ValueError):
    pass


class Review:
    """One document under review; each public method is an action of the log."""

    def __init__(self, text: str, detections: list[dict], mentions: list[dict], clusters: list[dict], mode: str = "cat"):
        self.text, self.detections, self.mentions, self.clusters, self.mode, self.seq = text or "", detections, mentions, clusters, mode, 0

    def _detection(self, id) -> dict:
        found = next((d for d in self.detections if d["id"] == int(id)), None)
        if found is None:
            raise Refused("no such detection")
        return found

    def _cluster(self, id) -> dict:
        found = next((c for c in self.clusters if c["cluster_id"] == id), None)
        if found is None:
            raise Refused("no such group")
        return found

    def _count(self, cat: str) -> int:
        return sum(d["cat"] == cat for d in self.detections)

    def _surfaces(self, ids) -> list[str]:
        return list(dict.fromkeys(m["surface"].strip() for m in self.mentions if m["mention_id"] in set(ids)))

    def _put(self, cat: str, surface: str, spans: list[tuple[int, int]], placeholder: str | None = None) -> dict:
        mention = {"mention_id": f"m_manual_{self.seq}", "cat": cat, "surface": surface, "start": spans[0][0], "end": spans[0][1]}
        places = [{"start": a, "end": b, "raw": self.text[a:b]} for a, b in dict.fromkeys(spans)]
        if placeholder is not None and not placeholder.strip():
            raise Refused("blank placeholder")
        self.mentions.append(mention)
        d = next((d for d in self.detections if (d["cat"], d["original"].strip().lower()) == (cat, surface.lower())), None)
        if d is None:
            d = {
                "id": max((x["id"] for x in self.detections), default=-1) + 1, "cat": cat, "original": surface, "placeholder": label(cat, surface, self._count(cat) + 1, self.mode),
                "enabled": True, "positions": [], "mention_ids": [], "cluster_id": None, "manual_placeholder": False, "user_added": True,
            }
            self.detections.append(d)
        held = {(p["start"], p["end"]) for p in d["positions"]}
        d["positions"] += [p for p in places if (p["start"], p["end"]) not in held]
        d["mention_ids"].append(mention["mention_id"])
        if placeholder is not None:
            d.update(placeholder=placeholder.strip(), manual_placeholder=True)
        return d

    def add_manual(self, cat, start, end, valid=True, **_):
        """A selection: it and all its other occurrences, whatever the case, become one detection. valid: by the relaxed test."""
        a, b = int(start), int(end)
        surface = self.text[a:b].strip() if 0 <= a < b <= len(self.text) else ""
        if len(surface) < 2 or not valid:
            raise Refused("bad range or surface")
        self._put(cat, surface, [m.span() for m in re.finditer(re.escape(surface), self.text, re.I)] or [(a, b)])

    def add_bulk(self, cat, original, positions, placeholder=None, **_):
        """Given places ("start-end" by commas), as a search finds them."""
        spans = [tuple(map(int, p.split("-"))) for p in positions.split(",") if p]
        if len(original.strip()) < 2 or not spans or any(not 0 <= a < b <= len(self.text) for a, b in spans):
            raise Refused("bad text or range")
        self._put(cat, original.strip(), spans, placeholder)

    def remove(self, id, **_):
        d = self._detection(id)
        ids = set(d["mention_ids"])
        self.mentions = [m for m in self.mentions if m["mention_id"] not in ids]
        self.detections = [x for x in self.detections if x is not d]
        for i, x in enumerate(self.detections):
            x["id"] = i
        for c in self.clusters:
            if d["cluster_id"] and c["cluster_id"] == d["cluster_id"]:
                c["surfaces"] = [s for s in c["surfaces"] if s.strip().lower() != d["original"].strip().lower()]
                c["mention_ids"] = [m for m in c["mention_ids"] if m not in ids]

    def update(self, id, cat=None, placeholder=None, enabled=None, **_):
        d = self._detection(id)
        if placeholder is not None and not placeholder.strip():
            raise Refused("blank placeholder")
        if cat and cat != d["cat"]:
            d.update(cat=cat, cluster_id=None)
            for m in self.mentions:
                if m["mention_id"] in d["mention_ids"]:
                    m["cat"] = cat
            if placeholder is None or not d["manual_placeholder"]:
                d.update(placeholder=label(cat, d["original"], self._count(cat), self.mode), manual_placeholder=False)
        if placeholder is not None:
            d.update(placeholder=placeholder.strip(), manual_placeholder=True)
        if enabled is not None:
            d["enabled"] = str(enabled).lower() == "true"

    def _mentions_of(self, ids: str) -> list[str]:
        out = []
        for d in (self._detection(i) for i in ids.split(",")):
            spans = {(p["start"], p["end"]) for p in d["positions"]}
            own = [m["mention_id"] for m in self.mentions if m["mention_id"] in d["mention_ids"] or m["surface"].strip() == d["original"].strip() or (m["start"], m["end"]) in spans]
            if not own:
                p = d["positions"][0] if d["positions"] else {"start": 0, "end": len(d["original"])}
                own = [f"m_manual_{d['id']}_{self.seq}"]
                self.mentions.append({"mention_id": own[0], "cat": d["cat"], "surface": d["original"].strip(), "start": p["start"], "end": p["end"]})
            d["mention_ids"] = own
            out += own
        return list(dict.fromkeys(out))

    def _sync(self, c: dict):
        name = c["placeholder"] or c["canonical_label"]
        for d in self.detections if name else ():
            if d["original"].strip() in c["surfaces"] or set(d["mention_ids"]) & set(c["mention_ids"]):
                d["cluster_id"] = c["cluster_id"]
                if c["status"] == "confirmed":
                    d.update(placeholder=name, enabled=True)

    def _new(self, kind: str, cat: str, ids: list[str], surfaces: list[str], confidence: str, reasons: list[str]) -> dict:
        c = {"cluster_id": f"{kind}_{self.seq}", "cat": cat, "canonical_label": None, "placeholder": None, "mention_ids": ids, "surfaces": surfaces, "confidence": confidence, "status": "suggested", "reasons": reasons}
        self.clusters.append(c)
        return c

    def create_cluster(self, ids, cat=None, **_):
        own = self._mentions_of(ids)
        self._sync(self._new("manual", cat or self._detection(ids.split(",")[0])["cat"], own, self._surfaces(own), "media", ["manual"]))

    def add_to_cluster(self, cluster, ids, **_):
        c = self._cluster(cluster)
        c["mention_ids"] = list(dict.fromkeys(c["mention_ids"] + self._mentions_of(ids)))
        c["surfaces"] = self._surfaces(c["mention_ids"])
        self._sync(c)

    def confirm(self, cluster, **_):
        c = self._cluster(cluster)
        c.update(mention_ids=list(dict.fromkeys(c["mention_ids"])), status="confirmed")
        c["surfaces"] = self._surfaces(c["mention_ids"])
        taken = [int(m[1]) for d in self.detections if d["cat"] == c["cat"] and d["cluster_id"] and (m := re.search(r"(?:^|_)\[?(\d+)\]*$", d["placeholder"] or ""))]
        c["placeholder"] = c["canonical_label"] = c["placeholder"] or label(c["cat"], (c["surfaces"] or ["?"])[0], max(taken, default=0) + 1, self.mode)
        self._sync(c)

    def split(self, cluster, mention_ids, **_):
        self._split(self._cluster(cluster), mention_ids.split(","))

    def _split(self, c: dict, off: list[str]):
        keep = [m for m in c["mention_ids"] if m not in off]
        if keep:
            c.update(mention_ids=keep, surfaces=self._surfaces(keep), status="suggested", placeholder=None, canonical_label=None)
        self._new(f"{c['cluster_id']}_split", c["cat"], off, self._surfaces(off), c["confidence"], ["split"])

    def remove_surface(self, cluster, surface, **_):
        c, low = self._cluster(cluster), surface.strip().lower()
        off = [m["mention_id"] for m in self.mentions if m["mention_id"] in c["mention_ids"] and m["surface"].strip().lower() == low]
        if not off:
            raise Refused("no such surface")
        for d in self.detections:
            if d["cluster_id"] == c["cluster_id"] and d["original"].strip().lower() == low:
                d["cluster_id"] = None
        self._split(c, off)

    def absorb(self, cluster, source, **_):
        c, s = self._cluster(cluster), self._cluster(source)
        if c is s:
            raise Refused("a group can't absorb itself")
        c["mention_ids"] = list(dict.fromkeys(c["mention_ids"] + s["mention_ids"]))
        for d in self.detections:
            if d["cluster_id"] == source:
                d["cluster_id"] = cluster
        self.clusters = [x for x in self.clusters if x is not s]
        c["surfaces"] = self._surfaces(c["mention_ids"])
        self._sync(c)

    def merge(self, clusters, **_):
        some = [c for c in self.clusters if c["cluster_id"] in clusters.split(",")]
        if len(some) < 2:
            raise Refused("two groups at least")
        self.clusters = [c for c in self.clusters if c not in some]
        flat = lambda n: list(dict.fromkeys(x for c in some for x in c[n]))
        self._sync(self._new("merged", some[0]["cat"], flat("mention_ids"), flat("surfaces"), "media", sorted(flat("reasons"))))

    def patch_cluster(self, cluster, placeholder=None, label=None, **_):
        c = self._cluster(cluster)
        if placeholder is not None:
            c["placeholder"] = placeholder
        if label is not None:
            c["canonical_label"] = label
        if c["status"] == "confirmed":
            self._sync(c)

    def reject(self, cluster, **_):
        c = self._cluster(cluster)
        self.clusters = [x for x in self.clusters if x is not c]

    def ignore(self, ids, **_):
        for d in [self._detection(i) for i in ids.split(",")]:
            d["enabled"] = False

    def _similar(self, d: dict) -> list[dict]:
        return [x for x in self.detections if x is not d and x["cat"] == d["cat"] and alike(d["cat"], d["original"], x["original"])]

    def join_similar(self, id, **_):
        """The detection and all that look like it become one confirmed group: its own, or a new one if it has none."""
        d = self._detection(id)
        others = self._similar(d)
        if not others:
            raise Refused("nothing similar")
        if d["cluster_id"] is None:
            own = self._mentions_of(str(d["id"]))
            c = self._new("manual", d["cat"], own, self._surfaces(own), "media", ["manual"])
        else:
            c = self._cluster(d["cluster_id"])
        self.add_to_cluster(c["cluster_id"], ",".join(str(x["id"]) for x in others))
        self.confirm(c["cluster_id"])

    def ignore_similar(self, id, **_):
        d = self._detection(id)
        for x in [d, *self._similar(d)]:
            x["enabled"] = False


#: The actions a log may hold.
ACTIONS = [n for n in vars(Review) if not n.startswith("_")]


def _selection_valid(act: Column, text: Column, lex: Lexicon) -> Column:
    """The relaxed validity of what an add_manual action selects; true for others."""
    arg = lambda n: F.try_element_at(F.map_from_entries(act["args"]), F.lit(n))
    start, end = arg("start").try_cast("int"), arg("end").try_cast("int")
    begin = F.greatest(start - LEFT, F.lit(0))
    surface = trim_white(F.substring(text, start + 1, end - start))
    good = filters.valid_manual(arg("cat"), surface, F.substring(text, begin + 1, start - begin), F.substring(text, start + 1, F.lit(RIGHT)), lex)
    return F.when(act["action"] == "add_manual", F.coalesce(good, F.lit(False))).otherwise(True)


def _placed(found: Column, text: Column) -> Column:
    """Detections with what stands about their first place."""

    def about(d: Column) -> Column:
        start = F.coalesce(F.try_element_at(d["positions"], F.lit(1))["start"], F.lit(0))
        begin = F.greatest(start - LEFT, F.lit(0))
        return d.withField("left", F.substring(text, begin + 1, start - begin)).withField("right", F.substring(text, start + 1, F.lit(RIGHT)))

    return F.transform(found, about)


def replay(
    docs: DataFrame, detections_: DataFrame, mentions: DataFrame, clusters: DataFrame, log: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "cat", lexicon: Lexicon | None = None
) -> DataFrame:
    """A row a document in the log, after all its actions: key, detections, mentions, clusters, refused (seqs), anonymized_text
    (as a preview shows it), exported (detections pruned as for export, under their present category) and exported_text.

    log: key, seq, action (one of ACTIONS), args (map of strings).
    """
    fields = lambda kind: [f.split(":")[0] for f in re.sub(r"<[^<>]*(?:<[^<>]*>)?[^<>]*>", "", kind[7:-1]).split(",")]
    gather = lambda df, kind, name: df.select(F.col(key).alias("k"), F.struct(*fields(kind)).cast(kind).alias("s")).groupBy("k").agg(F.collect_list("s").alias(name))
    acts = log.groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_list(F.struct("seq", "action", F.map_entries("args").alias("args")))).alias("acts"))
    state = acts.join(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")), "k")
    for df, kind, name in ((detections_, DETECTION, "detections"), (mentions, MENTION, "mentions"), (clusters, CLUSTER, "clusters")):
        state = state.join(gather(df, kind, name), "k", "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    return replayed(state, lexicon or load(), mode).withColumnRenamed("k", key)


def replayed(state: DataFrame, lex: Lexicon, mode: str = "cat") -> DataFrame:
    """replay() of rows that hold all of a document: k, text, detections, mentions, clusters and acts (in order; args as entries).

    Rows with `linkable` (mentions as resolve.prepared gives them) instead of clusters are linked first, in the same pass.
    """
    state = state.withColumn("valid", F.transform("acts", lambda a: _selection_valid(a, F.col("text"), lex)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = {n: arrow.values(b.column(i)) for i, n in enumerate(b.schema.names) if n != "k"}
            if "linkable" in got:
                got["clusters"] = [resolve.groups_of(m, resolve.links_of(m)) for m in got["linkable"]]
            out = {"detections": [], "mentions": [], "clusters": [], "refused": []}
            for i in range(b.num_rows):
                ordered = sorted(got["mentions"][i], key=lambda m: (m["start"], m["end"], m["mention_id"]))
                groups = sorted(got["clusters"][i], key=lambda c: (len(c["cluster_id"]), c["cluster_id"]))
                r = Review(got["text"][i], sorted(got["detections"][i], key=lambda d: d["id"]), ordered, groups, mode)
                refused = []
                for a, valid in zip(got["acts"][i], got["valid"][i], strict=True):
                    r.seq = a["seq"]
                    try:
                        if a["action"] not in ACTIONS:
                            raise Refused("no such action")
                        args = {e["key"]: e["value"] for e in a["args"] or () if e["value"] is not None}
                        getattr(r, a["action"])(**args | ({"valid": valid} if a["action"] == "add_manual" else {}))
                    except (Refused, TypeError, ValueError, AttributeError):
                        refused.append(a["seq"])
                for n, v in zip(out, (r.detections, r.mentions, r.clusters, refused), strict=True):
                    out[n].append(v)
            kinds = {f.name: f.type for f in b.schema} | ({"clusters": resolve.group_arrays()} if "linkable" in got else {}) | {"refused": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(arrow.array(v, kinds[n]) for n, v in out.items())], names=["k", "text", *out])

    ready = state.select("k", "text", "detections", "mentions", "linkable" if "linkable" in state.columns else "clusters", "acts", "valid")
    done = ready.mapInArrow(run, f"k {dict(ready.dtypes)['k']}, text string, detections array<{DETECTION}>, mentions array<{MENTION}>, clusters array<{CLUSTER}>, refused array<bigint>")
    done = done.withColumn("exported", detections.pruned_row(_placed(F.col("detections"), F.col("text")), lex))
    texts = lambda c: anonymize.in_row(F.col("text"), F.col(c))
    return done.select("k", "detections", "mentions", "clusters", "refused", texts("detections").alias("anonymized_text"), "exported", texts("exported").alias("exported_text"))
