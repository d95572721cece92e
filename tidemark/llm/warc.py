"""WARC archives as seekable Zstandard bundles.

Writing: pages with a payload that a smaller page id already has become *revisit* records, the others
*response* records. Each task groups its records into frames of about ``frame_bytes``, each an independent
Zstandard frame, and its frames into bundles of about ``bundle_bytes``. A bundle ends in a seek table (a
skippable frame of the public seekable format: compressed and decompressed size of each frame, number of frames,
magic number), so any Zstandard tool can read it whole and any record can be read alone. The returned index maps
each record to (bundle, frame, offset and length inside the decompressed frame).

Reading: index rows are range-partitioned by bundle and frame; a task opens a bundle once, finds frames by the
seek table, decompresses each once and slices its records.

Only digests are grouped. Payloads are shuffled once, by page, to meet their record type; a payload that a third
of all pages share is counted per task before its digest is shuffled, and what it says is dealt to several tasks. Bundles are written below the shared
folder through ``pyarrow.fs``, under names of their own for each attempt: a lost or repeated task leaves files
that no index row names.

Defined cases: a null payload is empty; an empty payload is a payload like any other; a null URL has no target
header, control characters in URLs are percent-encoded; a null page id ranks above all others; rows that agree in
id and payload have the same type; rows with equal ids and other payloads are records of their own; other
columns are not read."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, new_path, partitions, with_groups, written

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "bundle string, frame int, offset long, length long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id, url: str | None, payload: bytes, date: str, refers_to) -> bytes:
    """One WARC/1.1 record. refers_to: the page that holds the payload, for a revisit."""
    digest, revisit = digest32(payload), refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    fields += [("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (of a response; empty for a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class Bundle:
    """A bundle being written."""

    def __init__(self, path: str, frame_bytes: int):
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(path)
        files.create_dir(name.rpartition("/")[0], recursive=True)
        self.path, self.out, self.frame_bytes = path, files.open_output_stream(name, compression=None), frame_bytes
        self.sizes, self.held, self.offset, self.total = [], [], 0, 0

    def add(self, raw: bytes) -> tuple[str, int, int, int]:
        where = (self.path, len(self.sizes), self.offset, len(raw))
        self.held.append(raw)
        self.offset += len(raw)
        self.total += len(raw)
        if self.offset >= self.frame_bytes:
            self.end_frame()
        return where

    def end_frame(self) -> None:
        if self.held:
            frame = zstandard.ZstdCompressor(level=3).compress(b"".join(self.held))
            self.out.write(frame)
            self.sizes.append((len(frame), self.offset))
            self.held, self.offset = [], 0

    def close(self) -> None:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class Reader:
    """Frames of a bundle by number."""

    def __init__(self, path: str):
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(name)
        end = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * frames, end - 9 - 8 * frames)))
        self.at = [0]
        for compressed, _ in sizes:
            self.at.append(self.at[-1] + compressed)
        self.sizes, self.number, self.data = sizes, -1, b""

    def frame(self, number: int) -> bytes:
        if number != self.number:
            raw = self.file.read_at(self.sizes[number][0], self.at[number])
            self.number, self.data = number, zstandard.ZstdDecompressor().decompress(raw, max_output_size=self.sizes[number][1])
        return self.data


def _payload(col: str):
    return F.coalesce(F.col(f"`{col}`"), F.lit("")).cast("binary")


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(_id, _sha, _first) of the pages whose payload a smaller page id has."""
    payload = _payload(payload_col)
    digests = pages.select(F.col(id_col).alias("_id"), F.sha1(payload).alias("_sha"), F.octet_length(payload).alias("_bytes"))
    digests = written(digests, "digests").filter(F.col("_bytes") >= min_bytes)
    shared = digests.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 AND _first IS NOT NULL")
    joined = with_groups(digests, shared, ["_sha"], "_n", digests.count(), ["_id"])
    return joined.filter(~F.col("_id").eqNullSafe(F.col("_first"))).select("_id", "_sha", "_first").distinct()


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, folder: str | None = None) -> DataFrame:
    """Writes the archives and returns the index: id, bundle, frame, offset, length."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or new_path(spark, "warc")
    id_type = pages.schema[id_col].dataType.simpleString()
    payload = _payload(payload_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    known = revisits(pages, id_col, payload_col, min_bytes)
    typed = rows.join(known, F.col("id").eqNullSafe(F.col("_id")) & (F.sha1("payload") == F.col("_sha")), "left").select("id", "url", "payload", "_first")

    def write(batches):
        task, bundle, serial = TaskContext.get(), None, 0
        for batch in batches:
            ids, out = batch.column(0), []
            for at in range(batch.num_rows):
                page_id, url, body, first = (c[at].as_py() for c in batch.columns)
                if bundle is None:
                    bundle = Bundle(f"{folder}/{task.partitionId():06d}-{serial:04d}-{task.taskAttemptId()}.warc.zst", frame_bytes)
                out.append(bundle.add(record(page_id, url, body, date, first)))
                if bundle.total >= bundle_bytes:
                    bundle.close()
                    bundle, serial = None, serial + 1
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True))], names=["id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return written(typed.mapInArrow(write, f"id {id_type}, {INDEX}"), "warc-index").withColumnRenamed("id", id_col)


def read_records(index: DataFrame, parts: int | None = None) -> DataFrame:
    """Per index row: record_type, page (text), refers_to (text), payload_bytes, payload_digest, payload (null for
    a revisit), as the archives hold them. A response's digest and length are taken from the payload read, and
    must agree with its header."""
    parts = parts or partitions(index.sparkSession)
    ordered = index.select("bundle", "frame", "offset", "length").repartitionByRange(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def read(batches):
        opened: list = [None, None]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_arrays(*_columns(found(batch.slice(at, 64).to_pylist(), opened)))

    def found(rows: list[dict], opened: list) -> Iterator[tuple]:
        for r in rows:
            path = r["bundle"]
            if path != opened[0]:
                opened[:] = path, Reader(path)
            reader = opened[1]
            fields, payload = parse(reader.frame(r["frame"])[r["offset"] : r["offset"] + r["length"]])
            kind, size, digest = fields["WARC-Type"], int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response":
                if (len(payload), digest32(payload)) != (size, digest):
                    raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} does not agree with its header")
            else:
                payload = None
            yield kind, fields.get("X-Page"), fields.get("X-Refers-To-Page"), size, digest, payload

    return ordered.mapInArrow(read, "record_type string, page string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def _columns(rows: Iterator[tuple]):
    names = ["record_type", "page", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
