"""WARC archives: monolithic writer, per-record gzip normaliser with sidecar index, and reader.

1. write: each task appends its rows as WARC response records to one gzip stream per archive (a monolithic
   archive; a new one after `roll` raw bytes). Only narrow index rows (key, digest, place) leave the task.
   Archives are dealt to as many tasks as there are archives (their rows are narrow, their work is not).
2. normalise: each archive is inflated once, front to back; every record becomes a gzip member of its own,
   and records whose payload another record has (smallest key first) become revisits. The offsets go to a
   sidecar index: JSON lines beside the archive, and rows. Then the monolithic archives are removed.
3. read: members are sought by the index, inflated and verified.

Archives are written in the folder all executors share, each attempt under a name of its own; the index
names the ones that count, so a task that runs twice leaves an orphan file but no wrong result.

Defined cases: a null html is an empty payload; a null url has no WARC-Target-URI; a null key never serves
as a revisit's target unless all keys of that payload are null, then all are responses; rows that repeat
key and payload of the response are responses too; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_folder, remove

STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
#: Bytes of members that one task reads, and most tasks that a stage is dealt to.
READ, TASKS = 1 << 23, 20_000
#: Subfolders of the archives before and after.
WHOLE, MEMBERS = "monolithic", "members"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(key: str | None) -> str:
    return f"<urn:record:{'' if key is None else key}>"


def _plain(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, key: str | None, url: str | None, digest: str, block: bytes, refers: str | None = None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(key)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode().split("\r\n")[1:])}


def records(stream):
    """Yields (headers, block) of an inflated WARC stream, given as an iterator of byte strings."""
    held = bytearray()
    more = iter(stream)

    def fill(n=None, mark=b"\r\n\r\n"):
        at = 0
        while len(held) < n if n is not None else (found := held.find(mark, max(0, at - 3))) < 0:
            at = len(held)
            part = next(more, None)
            if part is None:
                return None
            held.extend(part)
        return n if n is not None else found

    while (end := fill()) is not None:
        head = headers(bytes(held[:end]))
        size = int(head["content-length"])
        if fill(end + 4 + size + 4) is None:
            raise ValueError("archive ends inside a record")
        yield head, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def inflate(file):
    """Byte strings of a gzip file, member after member."""
    z = zlib.decompressobj(31)
    while raw := file.read(CHUNK):
        while raw:
            out = z.decompress(raw, CHUNK)
            if out:
                yield out
            raw = z.unconsumed_tail
            if z.eof:
                raw, z = z.unused_data, zlib.decompressobj(31)
    tail = z.flush()
    if tail:
        yield tail


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def write_monolithic(df: DataFrame, folder: str, key: str, url: str, html: str, roll: int = 1 << 28) -> DataFrame:
    """Rows (k, payload_bytes, digest, archive, ordinal), materialised: the archives are there on return."""

    def write(batches):
        import pyarrow as pa

        system, path = _open(f"{folder}/{WHOLE}")
        out = z = None
        raw = ordinal = 0
        for b in batches:
            rows = {n: [] for n in ("k", "payload_bytes", "digest", "archive", "ordinal")}
            for k, u, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if out is None:
                    name, ordinal, raw = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = system.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                payload = (h or "").encode()
                block = STATUS + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                digest = digest_of(payload)
                data = record("response", k, u, digest, block)
                out.write(z.compress(data))
                for n, v in zip(rows, (k, len(payload), digest, name, ordinal), strict=True):
                    rows[n].append(v)
                ordinal, raw = ordinal + 1, raw + len(data)
                if raw >= roll:
                    out.write(z.flush())
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["k"], pa.string()), pa.array(rows["payload_bytes"], pa.int64()), pa.array(rows["digest"], pa.string()), pa.array(rows["archive"], pa.string()), pa.array(rows["ordinal"], pa.int64())], names=list(rows)
            )
        if out is not None:
            out.write(z.flush())
            out.close()

    own = df.select(F.col(key).cast("string").alias("k"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))
    return materialise(own.mapInArrow(write, "k string, payload_bytes bigint, digest string, archive string, ordinal bigint"), "warc-index")


def normalise(index: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """index (archive, ordinal, refers) -> materialised rows (k, archive, start, size) of the new archives.

    The index rows of one archive meet in one task in order; the archive is inflated once. All archives are removed
    once the new ones are written.
    """

    def rewrite(batches):
        import pyarrow as pa

        (system, path), (_, to) = _open(f"{folder}/{WHOLE}"), _open(f"{folder}/{MEMBERS}")
        now = source = out = side = None
        name, old, place = "", None, 0
        for b in batches:
            rows = {n: [] for n in ("k", "archive", "start", "size")}
            for archive, ordinal, k, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if archive != now:
                    if out is not None:
                        out.close()
                        side.close()
                        old.close()
                    now, name, place = archive, f"{uuid.uuid4().hex}.members.warc.gz", 0
                    old = system.open_input_stream(f"{path}/{archive}", compression=None)
                    source = enumerate(records(inflate(old)))
                    out = system.open_output_stream(f"{to}/{name}", compression=None)
                    side = system.open_output_stream(f"{to}/{name}.idx", compression=None)
                at, (head, block) = next(source)
                if at != ordinal:
                    raise ValueError(f"{archive}: record {at} where {ordinal} was due")
                if refers is not None:
                    block = block[: block.index(b"\r\n\r\n") + 4]
                member = _gzip(record("response" if refers is None else "revisit", k, head.get("warc-target-uri"), head["warc-payload-digest"].removeprefix("sha1:"), block, refers), level)
                out.write(member)
                side.write(json.dumps({"id": k, "offset": place, "length": len(member)}).encode() + b"\n")
                for n, v in zip(rows, (k, name, place, len(member)), strict=True):
                    rows[n].append(v)
                place += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(rows["k"], pa.string()), pa.array(rows["archive"], pa.string()), pa.array(rows["start"], pa.int64()), pa.array(rows["size"], pa.int64())], names=list(rows))
        if out is not None:
            out.close()
            side.close()
            old.close()

    archives = index.select("archive").distinct().count()
    dealt = index.select("archive", "ordinal", "k", "refers").repartition(min(max(archives, 1), TASKS), "archive").sortWithinPartitions("archive", "ordinal")
    members = materialise(dealt.mapInArrow(rewrite, "k string, archive string, start bigint, size bigint"), "warc-members")
    remove(index.sparkSession, f"{folder}/{WHOLE}")
    return members


def read(members: DataFrame, folder: str) -> DataFrame:
    """Seeks each member of the index, verifies it, and gives what its record says."""

    def fetch(batches):
        import pyarrow as pa

        system, path = _open(f"{folder}/{MEMBERS}")
        name = file = None
        for b in batches:
            rows = {n: [] for n in ("k", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for archive, start, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, system.open_input_file(f"{path}/{archive}")
                file.seek(start)
                (head, block), *rest = records([zlib.decompress(file.read(size), 31)])
                http, _, payload = block.partition(b"\r\n\r\n")
                digest, length = head["warc-payload-digest"].removeprefix("sha1:"), int(headers(http)["content-length"])
                if rest or head["warc-type"] == "response" and (len(payload) != length or digest_of(payload) != digest):
                    raise ValueError(f"{archive} at {start}: the member is not the record it says")
                id_of = lambda x: x and (x[len("<urn:record:") : -1] or None)
                for n, v in zip(rows, (id_of(head["warc-record-id"]), length, digest, head["warc-type"], id_of(head.get("warc-refers-to"))), strict=True):
                    rows[n].append(v)
            kinds = {"payload_bytes": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.string())) for n, v in rows.items()], names=list(rows))
        if file is not None:
            file.close()

    size = members.agg(F.sum("size")).first()[0] or 0
    dealt = members.select("archive", "start", "size").repartition(min(max(2 * size // READ, 1), TASKS), "archive", F.expr(f"start div {READ}")).sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(fetch, "k string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes df's rows as archives and reads them back: key, payload_bytes, payload_digest, record_type, refers_to.

    Payloads of at least `least` bytes are stored once; further records of the same payload revisit the
    smallest key's record.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    folder = folder or new_folder(spark, "warc")
    index = write_monolithic(df, folder, key, url, html)
    firsts = (
        index.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min(F.col("k").cast(kind)).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    )
    marked = index.join(firsts, "digest", "left").withColumn("refers", F.expr("case when k is null or first <> cast(k as %s) then cast(first as string) end" % kind))
    members = normalise(marked, folder)
    return read(members, folder).select(
        F.col("k").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
