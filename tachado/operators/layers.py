"""Further detection layers: spans of other recognisers, added to the rule layer's before validity and sweep.

A layer is a Column (an Arrow UDF of a model, or an expression) giving array<struct<cat,surface,start,end>> of a text.
Layers come after the rules, in the order added; at equal starts the earlier layer wins the sweep, and layers do not
keep each other out before it. `pattern_layer` makes one from patterns alone; `checked` is what a model's spans go
through before they are added.

Defined cases: null texts and null layers have no spans; spans outside the text are left out; a null score counts as below
the floor; columns of the caller may have any names but text, hits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.text import trim_white
from . import filters
from .detect import LEFT, RIGHT, SPAN
from .rules import LOW, UP

PLUGIN = "array<struct<cat:string,surface:string,start:int,end:int>>"
# What the model layers' own patterns find (numbers, title and name, court words, role and name).
PATTERNS = [
    ("DNI", r"\b\d{1,2}\.\d{3}\.\d{3}\b", 0, 0),
    ("CUIT", r"\b\d{2}[-\s]?\d{8}[-\s]?\d\b", 0, 0),
    ("PERSONA", r"\b(?:Dr\.|Dra\.|Dres\.|Sr\.|Sra\.|Srta\.|Lic\.|Ing\.|Cdor\.|Cra\.|Arq\.)(?:\s+[^\W\d_a-z][^\W\d_A-Z]*\b){1,4}", 0, 0),
    ("ORGANISMO", r"\b(?:juzgado\s+nacional|fiscalia\s+[^\W\d_]+)\b", 0, re.I),
    ("PERSONA", rf"\b(?:imputad[oa]|víctima|victima|denunciante|testig[oa])\s+(?:[:,\.]?\s+)?({UP}{LOW}+(?:\s+{UP}{LOW}+){{0,3}})", 1, re.I),
]


def pattern_layer(text: Column) -> Column:
    """The patterns above as a layer; off by default, as the model layers are where their models are missing."""
    compiled = [(cat, re.compile(p, flags), g) for cat, p, g, flags in PATTERNS]

    import pandas as pd

    def find(texts):
        def one(t):
            return [{"cat": cat, "surface": m[g], "start": m.start(g), "end": m.end(g)} for cat, p, g in compiled for m in p.finditer(t or "")]

        return pd.Series([one(t) for t in texts])

    find.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(find, PLUGIN)(text)


# Least score of a model's span, least characters, and label words that are no data.
FLOOR, LEAST = 0.75, 3
LABELS = ["cuit", "cuil", "dni", "tel", "teléfono", "telefono", "email", "correo", "expediente", "expte", "juzgado", "fiscalía", "fiscalia"]
# Categories of a model's entity names.
ENTITY = {
    "DNI": "DNI", "CUIT": "CUIT", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "TELEFONO", "PERSON": "PERSONA", "LOCATION": "DOMICILIO", "ORGANIZATION": "ORGANISMO", "NRP": "PERSONA", "EXPEDIENTE": "EXPEDIENTE",
    "PER": "PERSONA", "ORG": "ORGANISMO", "LOC": "DOMICILIO",
}


def checked(text: Column, found: Column, lex: Lexicon) -> Column:
    """A model's array<struct<entity,start,end,score>> as a layer's spans: score, length, label words, validity.

    A surface is trimmed, its span is as the model gave it; unknown entities are OTRO.
    """
    cat = lambda s: F.coalesce(F.create_map(*(F.lit(x) for kv in ENTITY.items() for x in kv))[s["entity"]], F.lit("OTRO"))
    surface = lambda s: trim_white(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    spans = F.transform(found, lambda s: F.struct(cat(s).alias("cat"), surface(s).alias("surface"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["score"].cast("double").alias("score")))
    begin = lambda s: F.greatest(s["start"] - LEFT, F.lit(0))
    good = lambda s: (
        (s["score"] >= FLOOR) & (F.length(s["surface"]) >= LEAST) & ~F.lower(s["surface"]).isin(LABELS)
        & filters.valid(s["cat"], s["surface"], F.substring(text, begin(s) + 1, s["start"] - begin(s)), F.substring(text, s["start"] + 1, F.lit(RIGHT)), lex)
    )
    kept = F.filter(spans, lambda s: F.coalesce(good(s), F.lit(False)))
    return F.coalesce(F.transform(kept, lambda s: s.dropFields("score")), F.array()).cast(PLUGIN)


def add_layer(scanned: DataFrame, spans: Column, name: str, text: str = "text") -> DataFrame:
    """scanned (key, text, hits) with the layer's spans among the hits, in order of start."""
    t = F.col(text)
    begin = lambda s: F.greatest(s["start"] - LEFT, F.lit(0))
    whole = lambda s: F.struct(
        s["cat"].alias("cat"), s["surface"].alias("surface"), s["start"].alias("start"), s["end"].alias("end"), F.lit(name).alias("layer"),
        F.substring(t, begin(s) + 1, s["start"] - begin(s)).alias("left"), F.substring(t, s["start"] + 1, F.lit(RIGHT)).alias("right"),
    )
    fine = F.filter(F.coalesce(spans, F.array().cast(PLUGIN)), lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(t)))
    return scanned.withColumn("_layer", F.transform(fine, whole).cast(f"array<{SPAN}>")).withColumn("hits", ordered(F.concat("hits", "_layer"))).drop("_layer")


def ordered(hits: Column) -> Column:
    """Hits by start; at equal starts as they came."""
    placed = F.transform(hits, lambda h, i: F.struct(h["start"].alias("start"), i.alias("i"), h.alias("h")))
    return F.transform(F.array_sort(placed), lambda p: p["h"])


def capabilities() -> dict[str, bool]:
    """Which model libraries are importable here."""
    import importlib.util

    return {name: importlib.util.find_spec(name) is not None for name in ("spacy", "presidio_analyzer", "pdfplumber")}
