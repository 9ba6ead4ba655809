"""PDF export: paragraphs on A4 pages in Times, as bytes, without any library.

Defined cases: blank paragraphs are left out; a document without any says that it is empty; characters outside the
font's encoding (cp1252) become question marks; words longer than a line are cut; null texts count as empty, null keys
stay, repeated rows are files of their own, an empty table gives an empty one.
"""

from __future__ import annotations

import unicodedata
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.documents import paragraphs

# Page size in points, defaults (sizes in points, margins in cm), and the font's character widths.
PAGE = (595.28, 841.89)
FORMAT = {"size": 12, "spacing": 1.5, "space_after": 6, "margin": 3.0, "margin_top_bottom": 2.5, "alignment": "justify"}
LIMITS = {"size": (8, 24), "spacing": (1, 3), "margin": (1, 5), "margin_top_bottom": (1, 5)}
WIDTHS = {
    200: "|`", 250: " .,", 278: ":;/\\ijlt", 333: "!()-`'If[]r", 389: "sJ", 408: '"', 444: "?acez", 469: "^", 480: "{}", 500: "0123456789$#*_bdghknopquvxy«»", 541: "~", 556: "FPS", 564: "+<=>", 611: "ELTZ",
    667: "BCR", 722: "ADGHKNOQUVXYw", 778: "m&", 833: "%", 889: "M", 921: "@", 944: "W", 1000: "—…",
}
WIDTH_OF = {c: w for w, chars in WIDTHS.items() for c in chars}


def width(text: str, size: float) -> float:
    return sum(WIDTH_OF.get(unicodedata.normalize("NFD", c)[0], 500) for c in text) * size / 1000


def lines(text: str, size: float, room: float) -> list[list[str]]:
    """The words of each line."""
    out: list[list[str]] = [[]]
    used, blank = 0.0, width(" ", size)
    for word in text.split():
        while width(word, size) > room:
            n = max(1, next(i for i in range(1, len(word) + 1) if width(word[:i], size) > room) - 1)
            out += [[word[:n]], []]
            word, used = word[n:], 0.0
        w = width(word, size)
        if out[-1] and used + blank + w > room:
            out.append([])
            used = 0.0
        used += w + (blank if out[-1] else 0)
        out[-1].append(word)
    return [x for x in out if x]


def _escape(text: str) -> bytes:
    return text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def pdf_bytes(parts: list[str], **options) -> bytes:
    """A PDF file of the paragraphs. options: see FORMAT; alignment is left, justify, center or right."""
    o = FORMAT | options
    for name, (low, high) in LIMITS.items():
        if not low <= o[name] <= high:
            raise ValueError(f"{name} is from {low} to {high}")
    side, edge, size, lead = o["margin"] * 72 / 2.54, o["margin_top_bottom"] * 72 / 2.54, o["size"], o["size"] * o["spacing"]
    room, pages, y = PAGE[0] - 2 * side, [[]], PAGE[1] - edge
    for part in [p for p in parts if p.strip()] or ["(documento vacío)"]:
        for block in part.strip().split("\n"):
            rows = lines(block, size, room)
            for i, words in enumerate(rows):
                if y - lead < edge:
                    pages.append([])
                    y = PAGE[1] - edge
                y -= lead
                free = room - width(" ".join(words), size)
                x = side + {"center": free / 2, "right": free}.get(o["alignment"], 0)
                gap = free / (len(words) - 1) if o["alignment"] == "justify" and i < len(rows) - 1 and len(words) > 1 else 0
                pages[-1].append(b"BT /F1 %g Tf %.3f Tw 1 0 0 1 %.2f %.2f Tm (%s) Tj ET" % (size, gap, x, y, _escape(" ".join(words))))
        y -= o["space_after"]
    first = 4
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages)))
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(pages), kids), b"<</Type/Font/Subtype/Type1/BaseFont/Times-Roman/Encoding/WinAnsiEncoding>>"]
    for i, page in enumerate(pages):
        body = zlib.compress(b"\n".join(page))
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %.2f %.2f]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % (*PAGE, first + 2 * i + 1))
        objects.append(b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(body), body))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)


def pdf_documents(docs: DataFrame, key: str = "doc_id", text: str = "anonymized_text", edited: str | None = None, **options) -> DataFrame:
    """key, content (PDF bytes); a user's edited text wins over the computed one."""
    own = F.coalesce(F.col(edited), F.col(text), F.lit("")) if edited else F.coalesce(F.col(text), F.lit(""))

    def build(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pdf_bytes(p, **options) for p in b.column(1).to_pylist()], pa.binary())], names=["k", "content"])

    ready = docs.select(F.col(key).alias("k"), paragraphs(own).alias("p"))
    return ready.mapInArrow(build, f"k {dict(ready.dtypes)['k']}, content binary").withColumnRenamed("k", key)
