"""WARC records in ZIP-packaged archives, written and read by range.

An archive is a ZIP file with stored members: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdx`` (one line per record with offset and length). The reader parses the end record, the ZIP64
records and the central directory, reads the index, and then reads single records by their byte range; nothing is
unpacked to disk and no member is read as a whole but the index.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanvane.llm.shared import new_folder, size_checked, stage

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdx"
ARCHIVE_BYTES = 32 << 20
MIN_REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BROADCAST_ROWS = 1_000_000

RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


# ---------------------------------------------------------------- records


def make_record(page_id: int, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head of the full response, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []),
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one WARC record; raises on a record whose lengths or digest do not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload does not match its digest")
    number = lambda name: int(fields[name][len("<urn:page:") : -1]) if len(fields.get(name, "")) > len("<urn:page:>") else None
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None,
    }


# ---------------------------------------------------------------- archives


class ArchiveWriter:
    """Collects records up to a byte limit and writes them as one archive under a name seen only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.name, self.count = name, 0
        self.clear()

    def clear(self) -> None:
        self.data, self.index = io.BytesIO(), []

    def add(self, page_id: int, url: str | None, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.index.append(json.dumps({"page_id": page_id, "url": url, "offset": self.data.tell(), "length": len(packed)}))
        self.data.write(packed)

    def close(self) -> dict | None:
        if not self.index:
            return None
        path = f"{self.base}/{self.name}-{self.count}.zip"
        part = f"{path}.{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(part) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as archive:
            for member, body in ((DATA_MEMBER, self.data.getbuffer()), (INDEX_MEMBER, "\n".join(self.index).encode())):
                with archive.open(member, "w", force_zip64=True) as out:
                    out.write(body)
        self.fs.move(part, path)
        row = {"path": path, "n_records": len(self.index), "n_bytes": self.fs.get_file_info(path).size}
        self.count += 1
        self.clear()
        return row


def read_at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    raw = file.read(length)
    if len(raw) != length:
        raise ValueError("archive ends early")
    return raw


def zip_members(file, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of every stored member's bytes, from the central directory (ZIP64 where it is used)."""
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = read_at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP end record")
    entries, length, offset = struct.unpack("<H2L", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        big = read_at(file, struct.unpack("<Q", tail[end - 12 : end - 4])[0], 56)
        entries, length, offset = struct.unpack("<3Q", big[32:56])
    directory, at, members = read_at(file, offset, length), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is broken")
        method, packed, plain = struct.unpack("<H8x2L", directory[at + 10 : at + 28])
        n_name, n_extra, n_note, local = struct.unpack("<3H8xL", directory[at + 28 : at + 46])
        after = at + 46 + n_name + n_extra + n_note
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<2H", extra[:4])
            if tag == 1:  # 64-bit sizes and offset, each only if its short field is full
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain, packed, local = (next(values) if x == 0xFFFFFFFF else x for x in (plain, packed, local))
            extra = extra[4 + n :]
        if method:
            raise ValueError(f"{name} is not stored plainly")
        n_name, n_extra = struct.unpack("<26x2H", read_at(file, local, 30))
        members[name] = (local + 30 + n_name + n_extra, packed)
        at = after
    return members


def read_archive(fs, path: str, wanted=None) -> Iterator[dict]:
    """Records of one archive, or those whose page ids ``wanted`` holds, each by its own byte range."""
    with fs.open_input_file(path) as file:
        members = zip_members(file, file.size())
        data_at, data_length = members[DATA_MEMBER]
        index = read_at(file, *members[INDEX_MEMBER])
        for line in index.splitlines():
            entry = json.loads(line)
            if wanted is not None and entry["page_id"] not in wanted:
                continue
            if entry["offset"] + entry["length"] > data_length:
                raise ValueError("index points past its member")
            yield parse_record(gzip.decompress(read_at(file, data_at + entry["offset"], entry["length"])))


# ---------------------------------------------------------------- on Spark


def with_revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, payload_bytes, payload_digest, refers_to)``; of equal long payloads the largest page_id responds."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = pages.select("page_id", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    sized = stage(sized, "warc-digests")
    long_ones = sized.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    answers = long_ones.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    revisits = long_ones.join(answers, "payload_digest").filter("page_id < refers_to").select(
        F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), "refers_to"
    ).distinct()
    revisits = stage(revisits, "warc-revisits")
    rows = pages.select("page_id", "url", "html", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    same = (F.col("page_id") == F.col("id")) & (F.col("payload_digest") == F.col("digest"))
    return rows.join(size_checked(revisits, BROADCAST_ROWS), same, "left").drop("id", "digest")


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages as archives of about ``archive_bytes`` and returns ``(path, n_records, n_bytes)`` of each.

    The folder (a URI that driver and executors share) is new under the shared root unless given. A task that runs
    twice puts whole archives under the same names again.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc-archives")
    uri = folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"
    fs, base = pafs.FileSystem.from_uri(uri)
    fs.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(uri, f"part-{TaskContext.get().partitionId():06d}")
        done = []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                page_id, url, html, size, digest, refers_to = (x.as_py() for x in row)
                payload = b"" if refers_to is not None else (html or "").encode("utf-8")
                writer.add(page_id, url, make_record(page_id, url, payload, digest, size, refers_to))
                if writer.data.tell() >= archive_bytes:
                    done.append(writer.close())
        done.append(writer.close())
        done = [x for x in done if x]
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    columns = with_revisits(pages).select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")
    return stage(columns.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest").withColumn("fs", F.lit(uri))


def read_archives(manifest: DataFrame, batch_bytes: int = 16 << 20) -> DataFrame:
    """Records of all archives of a manifest, by range reads; archives are dealt out one to a task."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, _ = pafs.FileSystem.from_uri(uri)
                rows, held = [], 0
                for record in read_archive(fs, path):
                    rows.append(record)
                    held += len(record["payload"] or b"")
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    parts = max(1, manifest.count())
    dealt = manifest.select("path", "fs").repartitionByRange(parts, "path")
    return dealt.mapInArrow(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives and returns the records read back.

    A null html is an empty payload, a null url has no target line, a null id stays null. Rows of equal id and payload are
    written each. Empty input: no archives, no rows.
    """
    return read_archives(write_archives(pages))
