"""Exports: equivalence table as CSV, anonymised texts as DOCX bytes, Markdown, previews, and files of any of them.

Defined cases: documents without detections have no table; null texts count as empty; null keys stay (files of theirs are
named by a hash of their content); repeated keys' files are told apart by that hash too; empty tables give empty ones.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detections import equivalences
from ..sources.documents import paragraphs

HEADER = ["Tipo", "Original", "Sustitución", "Ocurrencias", "Activa", "Cluster"]
# Page format's defaults and limits (size in points, spacing in lines, margins in cm).
FORMAT = {"font": "Times New Roman", "size": 12, "spacing": 1.5, "margin": 2.5, "alignment": "both"}
LIMITS = {"size": (8, 24), "spacing": (1, 3), "margin": (1, 5)}


def csv_documents(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, content: each document's table as one CSV text (BOM, semicolons, CRLF), as an export file holds it."""
    quote = lambda c: F.when(F.col(c).rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    rows = equivalences(found, key).select(key, "id", F.concat_ws(";", *map(quote, HEADER)).alias("_line"))
    lines = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "_line"))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["_line"]), "\r\n")
    return lines.select(key, F.concat(F.lit("﻿" + ";".join(HEADER) + "\r\n"), body, F.lit("\r\n")).alias("content"))


def write_csv(found: DataFrame, path: str, key: str = "doc_id") -> None:
    """All documents' equivalences by Spark's CSV writer: the key first, then the table's columns; the header begins with a BOM.

    Files follow the data's partitions, however many documents there are; write_files makes a file a document.
    """
    rows = equivalences(found, key)
    rows.select(F.col(key).alias("\ufeff" + key), *HEADER).write.option("sep", ";").option("lineSep", "\r\n").option("header", True).csv(path)


def write_files(contents: DataFrame, folder: str, suffix: str, key: str = "doc_id", content: str = "content") -> DataFrame:
    """A file a row of (key, text or bytes), in 256 subfolders: folder/ab/<key>-<hash>.<suffix>. Gives key, file, size.

    Lazy: the files are there once the returned rows are. A task that runs twice writes the same files.
    """

    def write(batches):
        import hashlib
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder)
        for b in batches:
            out = {"file": [], "size": []}
            for k, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = data or b""
                mark = hashlib.sha256(data).hexdigest()
                name = f"{mark[:2]}/{quote(k or '', safe='')[:100]}-{mark[:16]}.{suffix}"
                system.create_dir(f"{top}/{mark[:2]}", recursive=True)
                with system.open_output_stream(f"{top}/{name}", compression=None) as f:
                    f.write(data)
                out["file"].append(name)
                out["size"].append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out["file"], pa.string()), pa.array(out["size"], pa.int64())], names=["k", "file", "size"])

    ready = contents.select(F.col(key).alias("k"), F.col(key).cast("string").alias("name"), F.col(content).cast("binary").alias("data"))
    return ready.mapInArrow(write, f"k {dict(ready.dtypes)['k']}, file string, size bigint").withColumnRenamed("k", key)


def markdown(docs: DataFrame, title: str, text: str = "anonymized_text"):
    """docs with a markdown column: title and text."""
    return docs.withColumn("markdown", F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), F.col(text)))


def docx_bytes(parts: list[str], **options) -> bytes:
    """A minimal WordprocessingML file: paragraphs in one format, Roman page numbers in the footer."""
    o = FORMAT | options
    for name, (low, high) in LIMITS.items():
        if not low <= o[name] <= high:
            raise ValueError(f"{name} is from {low} to {high}")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    run = f'<w:rPr><w:rFonts w:ascii="{escape(o["font"])}" w:hAnsi="{escape(o["font"])}"/><w:sz w:val="{round(2 * o["size"])}"/></w:rPr>'
    style = f'<w:pPr><w:spacing w:line="{round(240 * o["spacing"])}" w:lineRule="auto"/><w:jc w:val="{o["alignment"]}"/></w:pPr>'
    body = "".join(f'<w:p>{style}<w:r>{run}<w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in parts)
    side = round(567 * o["margin"])
    page = f'<w:sectPr><w:footerReference w:type="default" r:id="rId1"/><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="{side}" w:right="{side}" w:bottom="{side}" w:left="{side}"/><w:pgNumType w:fmt="upperRoman"/></w:sectPr>'
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    files = {
        "[Content_Types].xml": f'{xml}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kinds}.document.main+xml"/><Override PartName="/word/footer1.xml" ContentType="{kinds}.footer+xml"/></Types>',
        "_rels/.rels": f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/footer" Target="footer1.xml"/></Relationships>',
        "word/footer1.xml": f'{xml}<w:ftr {w}><w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:fldSimple w:instr="PAGE \\* ROMAN"><w:r><w:t>I</w:t></w:r></w:fldSimple></w:p></w:ftr>',
        "word/document.xml": f"{xml}<w:document {w}><w:body>{body}{page}</w:body></w:document>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def docx_documents(docs: DataFrame, key: str = "doc_id", text: str = "anonymized_text", edited: str | None = None, **options) -> DataFrame:
    """key, content (DOCX bytes); a user's edited text wins over the computed one."""
    own = F.coalesce(F.col(edited), F.col(text), F.lit("")) if edited else F.coalesce(F.col(text), F.lit(""))

    def build(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([docx_bytes(p, **options) for p in b.column(1).to_pylist()], pa.binary())], names=["k", "content"])

    ready = docs.select(F.col(key).alias("k"), paragraphs(own).alias("p"))
    return ready.mapInArrow(build, f"k {dict(ready.dtypes)['k']}, content binary").withColumnRenamed("k", key)


def preview(docs: DataFrame, anonymized: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, original, anonymized."""
    return docs.select(key, F.col(text).alias("original")).join(anonymized.select(key, F.col("anonymized_text").alias("anonymized")), key)
