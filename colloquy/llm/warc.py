"""WARC records in ZIP archives: writing, and reading by ranges without extraction.

An archive is a ZIP file with two stored (not compressed) members: ``archive/data.warc.gz``,
one gzip member per record, and ``indexes/index.cdxj``, one line per record with its place.
A reader fetches the end of the file, the central directory (ZIP64 where sizes or counts ask for
it), the index, and then only the byte ranges of the records it wants.

Archives live in the shared folder. A task writes under a name of its own and reports it in the
manifest only when complete, so a repeated task leaves a file nobody reads, never a torn one.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import cut, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: An archive is closed once its data passes this size.
ARCHIVE_BYTES = 128 << 20
#: Compressed bytes of neighbouring records that one range read fetches at most, but for a larger single record.
CHUNK_BYTES = 4 << 20
#: Bytes of payload that a task gives on at once, about.
SEND_BYTES = 16 << 20
#: Compressed bytes read by one task, about.
TASK_BYTES = 64 << 20
#: Smaller payloads are never revisits.
REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"


# -- storage -----------------------------------------------------------------------------------


def _open(uri: str, write: bool = False):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if write:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path)
    return system.open_input_file(path)


# -- ZIP ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


class ZipDirectory:
    """The members of a ZIP file, read from its end; ``f`` needs seek and read only."""

    def __init__(self, f, size: int):
        self.f = f
        tail_at = max(0, size - 65_557)
        tail = self._read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a whole ZIP file")
        _, _, _, count, length, offset = struct.unpack_from("<HHHHII", tail, at + 4)
        here = tail_at + at
        if here >= 20:
            locator = self._read(here - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                (where,) = struct.unpack_from("<Q", locator, 8)
                end = self._read(where, 56)
                if end[:4] != b"PK\x06\x06":
                    raise ValueError("broken ZIP64 end of central directory")
                count, length, offset = struct.unpack_from("<QQQ", end, 32)
        self.members = self._parse(self._read(offset, length), count)

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        got = self.f.read(n)
        if len(got) != n:
            raise ValueError("the file ends early")
        return bytes(got)

    @staticmethod
    def _parse(data: bytes, count: int) -> dict[str, Member]:
        out, at = {}, 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size, n, extra, note = struct.unpack_from("<IIHHH", data, at + 20)
            (header,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            x, stop = at + 46 + n, at + 46 + n + extra
            while x + 4 <= stop:
                kind, length = struct.unpack_from("<HH", data, x)
                if kind == 1:  # ZIP64: 64-bit values of those fields that are full, in this order
                    y = x + 4
                    if size == 0xFFFFFFFF:
                        (size,) = struct.unpack_from("<Q", data, y)
                        y += 8
                    if packed == 0xFFFFFFFF:
                        (packed,) = struct.unpack_from("<Q", data, y)
                        y += 8
                    if header == 0xFFFFFFFF:
                        (header,) = struct.unpack_from("<Q", data, y)
                x += 4 + length
            out[name] = Member(name, method, size, packed, header)
            at = stop + note
        return out

    def start(self, name: str) -> tuple[int, int]:
        """(first byte, size) of a stored member's content in the file."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is compressed and can't be read by ranges")
        head = self._read(m.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + n + extra, m.size

    def content(self, name: str) -> bytes:
        return self._read(*self.start(name))


# -- records -----------------------------------------------------------------------------------


def digest(column: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8, from 40-bit groups of its hex digits."""
    sha = F.sha1(column.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(sha, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    clean = "".join((url or "").splitlines())
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; the payload of a revisit is None."""
    import base64
    import hashlib

    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x[16:] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")))
    said = field["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda urn: int(n) if (n := urn.removeprefix("<urn:page:").removesuffix(">")) else None
    if field["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != said):
        raise ValueError("the payload is not what the record says")
    return {
        "page_id": number(field["WARC-Record-ID"]), "url": field["WARC-Target-URI"], "record_type": field["WARC-Type"], "payload_bytes": length, "payload_digest": said,
        "refers_to": number(field["WARC-Refers-To"]) if "WARC-Refers-To" in field else None, "payload": payload if field["WARC-Type"] == "response" else None,
    }


class _Archive:
    """One archive in the making: records go straight to storage, the index follows at the end."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.zip"
        self.out = _open(self.uri, write=True)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.index = 0, io.BytesIO()
        self.count = 0

    def add(self, page_id, kind: str, data: bytes) -> None:
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = gz.compress(data) + gz.flush()
        self.data.write(packed)
        self.index.write(json.dumps({"page": page_id, "type": kind, "offset": self.at, "length": len(packed)}).encode() + b"\n")
        self.at += len(packed)
        self.count += 1

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, self.index.getvalue())
        self.zip.close()
        self.out.close()
        return self.uri, self.count, self.at


def typed(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to): null html is an empty payload.

    Of equal payloads the row with the smallest page_id is the response (all rows that repeat
    this id); a row with a null id is one only if no row of its payload has an id.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("payload_digest", digest(F.col("payload")))
    first = base.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= revisit_bytes)
    return base.join(first, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records of :func:`typed` to ZIP archives under ``folder``; (archive, records, bytes)."""

    def write(batches: Iterator) -> Iterator[pd.DataFrame]:
        archive = None
        for batch in batches:
            for page_id, url, payload, sha, kind, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                archive = archive or _Archive(folder)
                archive.add(page_id, kind, record(page_id, url, kind, payload.encode(), sha, refers_to))
                if archive.at > ARCHIVE_BYTES:
                    yield _row(archive.close())
                    archive = None
        if archive:
            yield _row(archive.close())

    def _row(x):
        import pyarrow as pa

        return pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), x))], schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return cut(records.mapInArrow(write, "archive string, records long, bytes long"), "manifest")


def runs(index: list[dict], most: int) -> Iterator[tuple[int, list[int]]]:
    """(offset, lengths) of runs of neighbouring records of at most so many bytes, or of one larger record."""
    at, lengths, size = 0, [], 0
    for x in index:
        if lengths and size + x["length"] > most:
            yield at, lengths
            lengths, size = [], 0
        at = at if lengths else x["offset"]
        lengths.append(x["length"])
        size += x["length"]
    if lengths:
        yield at, lengths


def plan_reads(archives: DataFrame) -> DataFrame:
    """(archive, offset, lengths): runs of neighbouring records, from the archives' directories and indexes."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf.archive:
                with _open(uri) as f:
                    directory = ZipDirectory(f, f.size())
                    start, _ = directory.start(DATA)
                    index = [json.loads(x) for x in directory.content(INDEX).splitlines()]
                found = list(runs(index, CHUNK_BYTES))
                yield pd.DataFrame({"archive": uri, "offset": [start + at for at, _ in found], "lengths": [n for _, n in found]})

    return archives.select("archive").mapInPandas(plan, "archive string, offset long, lengths array<long>")


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of all records.

    Responses are checked against their digest; a revisit's size and digest are those of the full
    payload. Reads are dealt to as many tasks as their bytes ask for, and a task holds the
    bytes of one run of records and of one batch of payloads at a time.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payload else "")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload)
        send = lambda rows: pa.RecordBatch.from_pylist([{k: r[k] for k in names + ["payload"] * payload} for r in rows], schema=kinds)
        for batch in batches:
            for uri, offset, lengths in zip(*[c.to_pylist() for c in batch.columns]):
                with _open(uri) as f:
                    f.seek(offset)
                    data = memoryview(f.read(sum(lengths)))
                rows, at, size = [], 0, 0
                for n in lengths:
                    row = parse(zlib.decompress(data[at : at + n], 31))
                    size += len(row["payload"] or b"") if payload else 0
                    row = row if payload else row | {"payload": None}
                    rows.append(row)
                    at += n
                    if size > SEND_BYTES:
                        yield send(rows)
                        rows, size = [], 0
                yield send(rows)

    total = archives.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    return plan_reads(archives).repartition(tasks, "archive", "offset").mapInArrow(read, schema)


def round_trip(pages: DataFrame, folder: str | None = None, payload: bool = False) -> DataFrame:
    """The records of all ``pages``, written to archives and read back; an empty table gives none."""
    folder = folder or new_path(pages.sparkSession, "archives")
    return read_archives(write_archives(typed(pages), folder), payload)
