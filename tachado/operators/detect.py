"""The rule layer: ordered pattern rules over whole texts, first come first kept.

Python's `re` defines the patterns, and which of two hits stays depends on all before it, so a document is
scanned in one Arrow-batched pass (no shuffle) that yields its spans with the text around them. All that
follows (validity, sweep, grouping, linking, substitution) are Column expressions and DataFrame operations.

Defined cases: a null text has no spans; a null key stays null; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions.lexicon import STOP, Lexicon
from ..functions.text import CHECK
from . import catalog as catalogs
from .literals import fold, needed
from .rules import ADDRESSES, CAPTION_END, CAPTION_LENGTH, ENTITIES, LONG_SPACE, PLATE, RULES, STREET_WORD

#: Characters kept to the left and right of a span's start, for the validity rules.
LEFT, RIGHT = 120, 180
SPAN = "struct<cat:string,surface:string,start:int,end:int,layer:string,left:string,right:string>"
PARTICLES = {"de", "del", "la", "las", "los", "y"}
# Letters before a plate's digits that make it a legal reference.
LEGAL = set("ley art cap doc inc reg tit cam cám cpc cpcc ccc ccyc cpe cpp ord res dec exp fs lib fol rol iva afp ans afa".split())
# What may be stuck to the front of a name.
EDGE = r"[\s,.;:\-/\\\"'()\[\]]+"
STUCK = re.compile(rf"(?:{EDGE})?(?:(?:(?:ORIGINAL|DUPLICADO|TRIPLICADO|CUADRUPLICADO|COPIA|ANEXO)\s+|(?:c\s*\.?\s*/|s\s*\.?\s*/|en\s*/|y\s+|e\s+|o\s+)\s*)(?:{EDGE})?)*", re.I)
VERSUS = re.compile(r"\s+(?:c\s*\.?/|contra)\s+", re.I)


@lru_cache(1 << 16)
def plain(word: str) -> str:
    return " ".join("".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn").split())


def only_digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def tax_number(text: str) -> bool:
    d = only_digits(text)
    if len(d) != 11:
        return False
    rest = 11 - sum(int(a) * w for a, w in zip(d, CHECK, strict=False)) % 11
    return int(d[10]) == {11: 0, 10: 9}.get(rest, rest)


def plate(text: str) -> bool:
    head = re.match(r"([A-Za-zÁÉÍÓÚÑáéíóúñ]{2,4})\b", text)
    return not (head and head[1].lower() in LEGAL) and bool(re.fullmatch(PLATE, re.sub(r"[\s\-]", "", text), re.I))


class Taken:
    """Disjoint ranges, kept sorted, so that a clash is found by bisection."""

    def __init__(self):
        self.starts, self.ends = [], []

    def clashes(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> bool:
        if self.clashes(a, b):
            return False
        i = bisect_right(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def merged(spans: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Spans in order of start, joined where the next begins at most `gap` after the end."""
    out: list[list[int]] = []
    for a, b in sorted(spans, key=lambda s: s[0]):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


class Scanner:
    """All rules, compiled once a worker."""

    def __init__(self, lexicon: Lexicon, catalog: list[tuple[str, float, str]], literals: dict | None = None):
        flags = {"": 0, "i": re.I, "is": re.I | re.S}
        self.lexicon = lexicon
        self.rules = [(r, re.compile(r.pattern, re.I if r.fold else 0) if r.pattern else None) for r in RULES]
        self.guards = {r.guard: re.compile(r.guard, re.I) for r in RULES if r.guard}
        self.caption_end, self.long_space = re.compile(CAPTION_END, re.I), re.compile(LONG_SPACE)
        self.addresses = [(re.compile(p, flags[f]), g, check) for p, g, check, f in ADDRESSES]
        self.catalog = [(ENTITIES[e], e == "RGX_CARATULA", re.compile(p)) for e, _, p in catalog]
        patterns = [p for _, p in self.rules if p] + [p for p, *_ in self.addresses] + [p for *_, p in self.catalog] + list(self.guards.values())
        self.bits = {p: 1 << i for i, p in enumerate(dict.fromkeys(patterns))}
        self.needed = {p: needed(p) if literals is None else literals[p.pattern, p.flags] for p in patterns}
        self.open = 0

    @property
    def needed(self) -> dict[re.Pattern, tuple[str, ...]]:
        return self._needed

    @needed.setter
    def needed(self, words: dict[re.Pattern, tuple[str, ...]]):
        """Patterns (as bits) by the literal that lets them match, so that a literal is looked for once a text."""
        self._needed, self.always, self.opened = words, 0, {}
        for p, some in words.items():
            self.always |= 0 if some else self.bits[p]
            for w in some:
                self.opened[w] = self.opened.get(w, 0) | self.bits[p]

    def literals(self) -> dict:
        """What the patterns' matches must hold, as plain values for tasks, which then need not parse them again."""
        return {(p.pattern, p.flags): w for p, w in self.needed.items()}

    def _look(self, text: str):
        """Which patterns may match the text: those of which it holds a literal, and those without."""
        folded, self.open = fold(text), self.always
        for w, bits in self.opened.items():
            if w in folded:
                self.open |= bits

    def _found(self, pattern: re.Pattern, text: str):
        """All matches; texts without the literals that every match holds are not scanned."""
        return pattern.finditer(text) if self.open & self.bits[pattern] else ()

    # Checks give the span's (surface, start, end) changed or as it is, or None.
    def _known(self, words: list[str]) -> bool:
        flat = [plain(w) for w in words]
        return not any(w in STOP for w in flat) and any(w in self.lexicon.names for w in flat)

    def _check(self, name: str, m: re.Match, s: str, a: int, b: int):
        if name == "cuit":
            return (s, a, b) if tax_number(m[1]) else None
        if name == "dni":
            return (s, a, b) if 7 <= len(only_digits(s)) <= 8 else None
        if name == "phone":
            return (s, a, b) if 10 <= len(only_digits(s)) <= 13 else None
        if name.startswith("longer"):
            return (s, a, b) if len(s.strip()) > int(name[6:]) else None
        if name == "digit":
            return (s, a, b) if re.search(r"\d", s) else None
        if name == "name":
            return (s, a, b) if plain(s) in self.lexicon.names else None
        if name == "capitals":
            return (s, a, b) if s.isupper() and not all(plain(w) in STOP for w in s.split()) else None
        if name == "known":
            words = s.replace(",", " ").split()
            return (s, a, b) if len(words) >= 2 and self._known(words) else None
        if name == "capitalised":
            one = re.split(r"\s+y\s+", s, maxsplit=1, flags=re.I)[0].strip()
            words = [w for w in one.split() if w.lower() not in PARTICLES]
            if len(words) < 2 or not self._known(words):
                return None
            return (one, a, a + len(one)) if len(one) < len(s) else (s, a, b)
        if name == "shop":
            whole = f"{m[0].split()[0]} {m[1].strip()}".strip()
            return whole, a, a + len(whole)
        return s, a, b

    def _hits(self, rule, pattern, text: str):
        if rule.check == "addresses":
            yield from ((text[a:b].strip(), a, b) for a, b in self._address_spans(text))
            return
        if rule.guard and next(iter(self._found(self.guards[rule.guard], text)), None) is None:
            return
        for m in self._found(pattern, text):
            if rule.check == "parties":
                for part in "ab":
                    surface = m[part].strip(" ,.;")
                    if surface.split():
                        yield surface, m.start(part), m.start(part) + len(surface)
                continue
            s, a, b = m[rule.group], m.start(rule.group), m.end(rule.group)
            if rule.exact:
                a = m.start() + m[0].index(s)
                b = a + len(s)
            if rule.strip:
                s = s.strip()
                b = a + len(s)
            if (hit := self._check(rule.check, m, s, a, b)) is not None:
                yield hit

    def _address_spans(self, text: str) -> list[tuple[int, int]]:
        spans = []
        for pattern, group, check in self.addresses:
            for m in self._found(pattern, text):
                a, b, body = m.start(group), m.end(group), m[group]
                if check.startswith("address"):
                    body = body.strip(" ,.;") if check == "address8" else body.strip()
                    b = a + len(body)
                    if len(body) <= int(check[7:] or -1) or not (re.search(r"\d", body) or re.search(STREET_WORD, body, re.I)):
                        continue
                elif check and len(body.strip()) <= 5:
                    continue
                spans.append((a, b))
        return merged(spans, 2)

    def _catalog_hits(self, text: str):
        seen = set()
        for cat, caption, pattern in self.catalog:
            if not caption and not self.open & self.bits[pattern]:
                continue
            for m in self._captions(pattern, text) if caption else pattern.finditer(text):
                g = next((i for i in range(1, (m.lastindex or 0) + 1) if m[i] and m[i].strip()), 0)
                found = [(m[g].strip(), m.start(g), m.end(g))]
                if caption:
                    found = self._parties(*found[0])
                for s, a, b in found:
                    if s and b > a and (a, b, cat) not in seen and self._catalog_check(cat, s):
                        seen.add((a, b, cat))
                        yield cat, s, a, b

    def _captions(self, pattern: re.Pattern, text: str):
        """All matches of the caption pattern, sought only where one of its ends is near enough."""
        if self.long_space.search(text):
            yield from pattern.finditer(text)
            return
        regions: list[list[int]] = []
        for m in self.caption_end.finditer(text):
            a, b = max(0, m.start() - CAPTION_LENGTH), m.end() + 1
            if regions and a <= regions[-1][1]:
                regions[-1][1] = b
            else:
                regions.append([a, b])
        for a, b in regions:
            yield from pattern.finditer(text, a, b)

    @staticmethod
    def _parties(full: str, base: int, _end: int):
        cut = VERSUS.search(full)
        out = []
        for raw, at in ((full, 0),) if cut is None else ((full[: cut.start()], 0), (full[cut.end() :], cut.end())):
            s = raw.strip(" \"'.,;")
            if len(s) >= 3:
                a = base + at + raw.find(s)
                out.append((s, a, a + len(s)))
        return out

    @staticmethod
    def _catalog_check(cat: str, s: str) -> bool:
        if cat in ("CUIT", "DNI"):
            read = s.replace("O", "0").replace("o", "0")  # O as scanned for 0
            return tax_number(read) if cat == "CUIT" else 7 <= len(only_digits(read)) <= 8
        if cat == "TELEFONO":
            return 10 <= len(only_digits(s)) <= 15
        return plate(s) if cat == "PATENTE" else True

    def _name(self, s: str, a: int) -> tuple[str, int]:
        """A name without labels and connectors in front, nor a first word that is no name before words that are."""
        cut = re.match(EDGE, s)
        at = cut.end() if cut else 0
        at = max(at, STUCK.match(s).end())
        rest = s[at:]
        words = rest.split()
        flat = [plain(w) for w in words]
        if len(words) >= 3 and flat[0] not in self.lexicon.names and any(w in self.lexicon.names for w in flat[1:]):
            skip = rest.find(words[0]) + len(words[0])
            skip += len(rest[skip:]) - len(rest[skip:].lstrip())
            at, rest = at + skip, rest[skip:]
        return rest.strip(), a + at

    def spans(self, text: str) -> list[dict]:
        taken, out = Taken(), []
        self._look(text)

        def offer(cat, s, a, b, layer):
            if cat == "PERSONA":
                s, a = self._name(s, a)
                b = a + len(s)
                if len(s) < 3:
                    return
            if taken.add(a, b):
                around = {"left": text[max(0, a - LEFT) : a], "right": text[a : a + RIGHT]}
                out.append({"cat": cat, "surface": s, "start": a, "end": b, "layer": layer} | around)

        for rule, pattern in self.rules:
            if pattern and not self.open & self.bits[pattern]:
                continue
            for s, a, b in self._hits(rule, pattern, text):
                offer(rule.cat, s if rule.cat in ("PERSONA", "EMAIL", "DNI") else s.strip(), a, b, rule.layer)
        for cat, s, a, b in self._catalog_hits(text):
            offer(cat, s, a, b, "regex_v2")
        return sorted(out, key=lambda h: h["start"])


def spread(df: DataFrame) -> DataFrame:
    """df over at least two partitions a core: a small table is often one file that Spark can't split; a large one is left."""
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def scan(
    df: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", catalog: str | None = None, keep_text: bool = True, carry: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """key, the columns to carry, text and `hits`: each document's packed spans of the rule layer, in order of start."""
    entries = catalogs.load(catalog)
    literals = Scanner(lexicon, entries).literals()
    names = ["k", *(f"c{i}" for i in range(len(carry))), *(["text"] if keep_text else []), "hits"]

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(lexicon, entries, literals)
        fields = [("cat", pa.string()), ("surface", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string()), ("left", pa.string()), ("right", pa.string())]
        for b in batches:
            hits = [scanner.spans(t) if t else [] for t in arrow.values(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names) - 1], arrow.array(hits, pa.list_(pa.struct(fields)))], names=names)

    own = df.select(F.col(key).alias("k"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.col(text).cast("string").alias("text"))
    kinds = dict(own.dtypes) | {"hits": f"array<{SPAN}>"}
    out = spread(own).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))
    return out.toDF(key, *carry, *names[len(carry) + 1 :])
