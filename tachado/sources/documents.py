"""Ingest: uploads as binary files, DOCX text, page text clean-up and re-flow.

Defined cases: null texts stay null (as pages they count as blank); documents without text get a status, never an error;
damaged and foreign files too; null keys are a key like others; pages of equal number follow by text; empty tables give
empty ones.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_white
from ..operators.scan import CLOSE, OPEN

# Upload limit in bytes, least characters of a page document.
UPLOAD_BYTES, LEAST_CHARS = 40 * 1024 * 1024, 15
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LETTER = "[A-Za-zÁÉÍÓÚÑáéíóúñ]"


def clean_page_text(text: Column) -> Column:
    """Without pagination noise: line ends unified, spaced letters joined, footers and lone numbers dropped."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), f"[{OPEN}{CLOSE}]", "")
    marked = F.regexp_replace(t, rf"(?uU)\b((?:{LETTER}\s){{2,}}{LETTER})\b", f"{OPEN}$1{CLOSE}")
    parts = F.transform(
        F.split(marked, OPEN, -1),
        lambda p: F.when(F.contains(p, F.lit(CLOSE)), F.concat(F.regexp_replace(F.substring_index(p, CLOSE, 1), r"(?U)\s+", ""), F.substring_index(p, CLOSE, -1))).otherwise(p),
    )
    t = F.array_join(parts, "")
    t = F.regexp_replace(t, r"(?iuUdm)^\s*\d+\s*\|\s*(?:P\s*)?[áaÁA]?\s*(?:g\s*)?(?:i\s*)?(?:n\s*)?(?:a\s*)?\s*$", "")
    t = F.regexp_replace(t, r"(?uUdm)^\s*\d{1,4}\s*$", "")
    return trim_white(F.regexp_replace(t, "\n{3,}", "\n\n"))


def continues(before: Column, line: Column) -> Column:
    """Whether a line goes on with the paragraph before it."""
    item, last, first = line.rlike(r"(?U)^[\d\-•·–—]\s"), F.right(before, F.lit(1)), F.substring(line, 1, 1)
    runs_on = ~last.isin(".", "!", "?") & (first.rlike(r"^[\p{Ll}ªº]") | first.isin("(", "[", '"', "'"))
    return ~item & (last.isin("-", ",", ";", ":") | runs_on)


def reflow(text: Column) -> Column:
    """Paragraphs, joined by a blank line, of lines that were broken for the page; a fold over the lines."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), trim_white), lambda x: x != "")
    add = lambda acc, x: F.when(
        (F.size(acc) > 0) & continues(F.try_element_at(acc, F.lit(-1)), x),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(" "), x))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(lines, F.array().cast("array<string>"), add), "\n\n")


def paragraphs(text: Column) -> Column:
    """A text's paragraphs for export; a text without any gives one saying that it is empty."""
    parts = F.filter(F.transform(F.split(reflow(F.regexp_replace(text, "\r\n", "\n")), "\n\n", -1), trim_white), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("(documento vacío)")))


def pages_to_documents(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Page rows -> key, text, status: pages cleaned, re-flowed and joined; blank pages are left out."""
    clean = pages.select(key, page, reflow(clean_page_text(trim_white(F.coalesce(F.col(text), F.lit(""))))).alias("_t"))
    whole = clean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page, "_t"))).alias("_p"))
    joined = F.array_join(F.filter(F.transform("_p", lambda p: p["_t"]), lambda t: t != ""), "\n\n")
    out = whole.select(key, joined.alias("text"))
    return out.withColumn("status", F.when(F.length("text") == 0, "no_text").when(F.length("text") < LEAST_CHARS, "too_short").otherwise("ok"))


def docx_text(data: bytes) -> str:
    """Non-blank body paragraphs, one a line; only if there are none, the non-blank table cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_NS}body")

    def said(node) -> str:
        marks = {f"{WORD_NS}tab": "\t", f"{WORD_NS}br": "\n", f"{WORD_NS}cr": "\n"}
        return "".join((x.text or "") if x.tag == f"{WORD_NS}t" else marks.get(x.tag, "") for x in node.iter())

    lines = [t for p in body.findall(f"{WORD_NS}p") if (t := said(p)).strip()]
    if not lines:
        cells = body.iterfind(f"{WORD_NS}tbl/{WORD_NS}tr/{WORD_NS}tc")
        lines = [t.strip() for c in cells if (t := "\n".join(said(p) for p in c.findall(f"{WORD_NS}p"))).strip()]
    return "\n".join(lines).strip()


def read_uploads(spark: SparkSession, path: str, pdf_pages=None) -> DataFrame:
    """Files under path -> doc_name, text, status. The size limit is pushed to the scan's file listing, which leaves out empty files.

    pdf_pages: a function bytes -> list of page texts; without one, PDFs get the status "no_reader".
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    fine = files.where(f"length <= {UPLOAD_BYTES}").select(name.alias("file"), "content")
    refused = files.where(f"length > {UPLOAD_BYTES}").select(name.alias("file"), F.lit("too_large").alias("status"))

    def extract(batches):
        import pyarrow as pa

        for b in batches:
            out = {"file": [], "pages": [], "text": [], "status": []}
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low, text, pages, status = file.lower(), None, None, "ok"
                try:
                    if low.endswith(".docx"):
                        text = docx_text(data)
                        status = "ok" if text else "no_text"
                    elif low.endswith(".pdf"):
                        pages, status = (pdf_pages(data), "ok") if pdf_pages else (None, "no_reader")
                    else:
                        status = "unsupported"
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
                    status = "damaged"
                for n, v in zip(out, (file, pages, text, status), strict=True):
                    out[n].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["file"], pa.string()), pa.array(out["pages"], pa.list_(pa.string())), pa.array(out["text"], pa.string()), pa.array(out["status"], pa.string())], names=list(out))

    read = fine.mapInArrow(extract, "file string, pages array<string>, text string, status string")
    flow = F.transform(F.filter(F.coalesce("pages", F.array().cast("array<string>")), lambda p: trim_white(p) != ""), lambda p: reflow(clean_page_text(trim_white(p))))
    text = F.when(F.col("pages").isNotNull(), F.array_join(F.filter(flow, lambda p: p != ""), "\n\n")).otherwise(F.col("text"))
    read = read.withColumn("text", text)
    short = F.when(F.col("pages").isNotNull() & (F.length("text") == 0), "no_text").when(F.col("pages").isNotNull() & (F.length("text") < LEAST_CHARS), "too_short").otherwise(F.col("status"))
    out = read.select("file", "text", short.alias("status")).unionByName(refused.withColumn("text", F.lit(None).cast("string")))
    return out.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("doc_name"), "text", "status")
