"""WARC archives: writing, normalising monolithic gzip files, reading by index (operator 4).

Files lie in the folder that driver and executors share. Each task writes files under names of its
own and returns them as rows; only the rows of successful tasks are read on, so a task that runs
again leaves at most a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, fresh_dir, lean, removed, session_of, stored

#: The date in every record: archives of equal pages are equal.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 20
SALTS = 16
#: Compression levels of the file as first written, and of the members of the normalised one.
FIRST_LEVEL, MEMBER_LEVEL = 1, 4


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def create(uri: str) -> BinaryIO:
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def opened(uri: str) -> BinaryIO:
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or, if refers_to is given, a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"" if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def inflated(file: BinaryIO) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, inflated once and in order, at most
    READ bytes at a time. ValueError if the last member is not whole, its checksum included."""
    engine, begun = zlib.decompressobj(31), False
    while raw := file.read(READ):
        while True:
            part = engine.decompress(raw, READ)
            begun = True
            if part:
                yield part
            if engine.eof:
                raw, engine, begun = engine.unused_data, zlib.decompressobj(31), False
                if not raw:
                    break
            else:
                raw = engine.unconsumed_tail
                if not raw and len(part) < READ:
                    break
    if begun:
        raise ValueError("the gzip stream breaks off")


def records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream; holds one record at a time."""
    held = bytearray()
    for part in parts:
        held += part
        while (end := held.find(b"\r\n\r\n")) >= 0:
            size = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held:
        raise ValueError("the last record breaks off")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, payload, size, digest, refers_to), one monolithic gzip file for
    each partition that has rows. Gives path, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, engine, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, zlib.compressobj(FIRST_LEVEL, zlib.DEFLATED, 31), 0
        for batch in batches:
            file = file or create(path)
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url")), byte_column(batch, "payload"), *(batch.column(c).to_pylist() for c in ("size", "digest", "refers_to")), strict=True):
                file.write(engine.compress(record(*row)))
                count += 1
        if file:
            file.write(engine.flush())
            file.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

    return pages.mapInArrow(lean(run), "path string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites gzip WARC files so that each record is a member of its own, and writes a sidecar
    index: one JSON line for each record with its offset, length, id, type and digest. Gives path,
    index, records. The input may hold any number of members; memory holds one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                count = offset = 0
                with opened(source) as file, create(path) as out, create(f"{path}.idx") as index:
                    for raw in records(inflated(file)):
                        engine = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
                        member = engine.compress(raw) + engine.flush()
                        out.write(member)
                        h = headers(raw[: raw.index(b"\r\n\r\n")])
                        line = {"offset": offset, "length": len(member), "id": h["warc-record-id"], "type": h["warc-type"], "digest": h["warc-payload-digest"]}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset += len(member)
                        count += 1
                yield pa.RecordBatch.from_pydict({"path": [path], "index": [f"{path}.idx"], "records": pa.array([count], pa.int64())})

    return archives.select("path").mapInArrow(lean(run), "path string, index string, records long")


def lines(file: BinaryIO) -> Iterator[bytes]:
    held = b""
    while raw := file.read(READ):
        *whole, held = (held + raw).split(b"\n")
        yield from whole


def read_archives(archives: DataFrame) -> DataFrame:
    """Reads normalised files member by member at the offsets of their index: page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit). A response
    whose payload does not have its digest raises ValueError."""

    def page(name: str | None) -> int | None:
        return int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", name or "")) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                with opened(path) as file, opened(index) as entries:
                    for entry in map(json.loads, lines(entries)):
                        file.seek(entry["offset"])
                        raw = zlib.decompress(file.read(entry["length"]), 31)
                        cut = raw.index(b"\r\n\r\n")
                        h, block = headers(raw[:cut]), raw[cut + 4 : -4]
                        if h["warc-record-id"] != entry["id"]:
                            raise ValueError(f"{index}: the index does not fit")
                        body = block.index(b"\r\n\r\n")
                        kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                        payload = block[body + 4 :] if kind == "response" else None
                        if payload is not None and digest32(payload) != digest:
                            raise ValueError(f"{path}: {entry['id']} does not have its digest")
                        size = len(payload) if payload is not None else int(headers(block[:body])["content-length"])
                        rows.append((page(h["warc-record-id"]), h["warc-target-uri"], size, digest, kind, page(h.get("warc-refers-to")), payload))
                        held += len(payload or b"")
                        if held > 8 * READ or len(rows) >= 4096:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    files = archives.select("path", "index")
    return files.mapInArrow(lean(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages as records: of those with equal payloads of at least `least_bytes` bytes, the one with
    the largest page_id is the response and the others refer to it. A null html is an empty payload.
    Rows that share page_id and payload have one type. Rows without a page_id never revisit."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("size", F.length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    shared = pages.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha", "size").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).where("low < top")
    # a payload that a third of the pages share meets its row in all salts
    shared = shared.select("sha", "size", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(shared, ["sha", "size", "salt"], "left")
    refers = F.when(F.col("page_id") < F.col("top"), F.col("top"))
    return out.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "sha", refers.alias("refers_to"))


def with_digest(pages: DataFrame) -> DataFrame:
    """The hex digest as bare base32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column("sha").to_pylist()]
            at = batch.schema.get_field_index("sha")
            yield batch.set_column(at, "digest", pa.array(out, pa.string()))

    return pages.mapInArrow(lean(run), "page_id long, url string, payload binary, size long, digest string, refers_to long")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes every page as a WARC record into monolithic gzip files, normalises them, and reads
    the records back; see read_archives() for the rows. An empty table gives no file and no row."""
    spark = session_of(pages)
    folder = fresh_dir(spark, "warc")
    written = stored(write_archives(with_digest(decided(pages, least_bytes)), f"{folder}/first"), "warc-written")
    # about a file a task, as the tasks that wrote them were
    count = max(1, written.count())
    normal = stored(normalise(written.repartitionByRange(count, "path"), f"{folder}/normal"), "warc-normal")
    removed(spark, f"{folder}/first")
    return read_archives(normal.repartitionByRange(count, "path"))
