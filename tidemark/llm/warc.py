"""WARC archives: range-sorted shards rolled by compressed size, deterministic headers, committed by rename and manifest."""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import Workspace, only, over, qualified

#: Compressed bytes after which a file is closed; one record may exceed it.
ROLL_BYTES = 16 << 20
#: Records carry it, so that the same input gives the same bytes.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that holds the page id; another prefix stands for a null id."""
    high = b"tide\x00\x00\x80\x00" if page_id is not None else b"tide\x00\x00\x80\x01"
    low = struct.pack(">q", page_id or 0)
    # Variant bits take the place of the top two bits of the id, which move into the first half.
    top = low[0] >> 6
    return f"<urn:uuid:{uuid.UUID(bytes=high[:4] + bytes([top]) + high[5:] + bytes([0x80 | (low[0] & 0x3F)]) + low[1:])}>"


def page_of(record: str) -> int | None:
    raw = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).bytes
    if raw[7] == 1:
        return None
    return struct.unpack(">q", bytes([(raw[4] << 6) | (raw[8] & 0x3F)]) + raw[9:])[0]


def _clean(value: str) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A gzip member with one WARC/1.1 record; a revisit has the HTTP header, whose Content-Length is that of the full payload, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive, with digests checked."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("archive ends within a record")
            parts.append(member.decompress(view[at : at + (1 << 16)]))
            at += len(view[at : at + (1 << 16)]) - len(member.unused_data)
        raw = b"".join(parts)
        head, _, block = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        block = block[: int(fields["Content-Length"])]
        if f"sha1:{digest_of(block)}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(next(line for line in http.decode().split("\r\n") if line.lower().startswith("content-length:")).split(":")[1])
        if fields["WARC-Type"] == "response" and (len(payload) != length or f"sha1:{digest_of(payload)}" != fields["WARC-Payload-Digest"]):
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
        yield {
            "page_id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": length,
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"], "refers_to": page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        }


def _write(path: str, roll: int) -> object:
    """Rows sorted by page; a row without payload says whom the digest's other pages refer to, and comes before its page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        out, name, temporary, held, count, number = None, "", "", 0, 0, 0
        first: int | None = None
        made: list[tuple] = []
        marks: dict[bytes, int | None] = {}
        marked: object = ()
        responded: object = ()

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                store.move(temporary, posixpath.join(root, name))
                made.append((name, count, held, first))
                out = None

        for batch in batches:
            for row in range(len(batch)):
                page, url, html, sha, refers = (batch.column(k)[row].as_py() for k in range(5))
                if batch.column(5)[row].as_py() == 0:
                    if marked != page:
                        marks, marked = {}, page
                    marks[bytes(sha)] = refers
                    continue
                payload, sha = (html or "").encode(), bytes(sha)
                known = marked == page and sha in marks
                # The first row of the smallest page is the response; a repeated row of that page refers to it.
                revisit = known and (marks[sha] != page or responded == (page, sha))
                responded = (page, sha) if known else responded
                data = record(page, url, payload, base64.b32encode(sha).decode(), marks[sha] if revisit else None, revisit)
                if out is not None and held + len(data) > roll:
                    close()
                if out is None:
                    name, held, count, first = f"part-{shard:05d}-{number:05d}.warc.gz", 0, 0, page
                    temporary = posixpath.join(root, f"_temporary-{name}-{attempt}")
                    out, number = store.open_output_stream(temporary), number + 1
                out.write(data)
                held, count = held + len(data), count + 1
        close()
        if made:
            names, counts, sizes, starts = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(starts, pa.int64())], names=["name", "records", "bytes", "first_page"])

    return run


def write_archives(pages: DataFrame, path: str, roll: int = ROLL_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row to gzip WARC files below `path` (where Spark has it; the executors' Arrow file systems must know its scheme); returns the manifest.

    Of equal payloads the smallest page id's record is the response and the others revisit it.
    Pages and the ids they refer to go through one range shuffle by page id, which sorts the
    records; a file is closed before `roll` compressed bytes. Each file is written under a
    temporary name with the attempt's number and renamed when whole: headers, dates and ids
    are derived, so an attempt that runs again writes the same bytes. The manifest is written
    last; readers take only files that it names.

    Null html: an empty payload. Null ids count as the largest, and their rows are kept. Of rows
    with the same id and payload one is the response, the others refer to that id. Null urls are
    empty. An empty table has an empty manifest. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = qualified(spark, path)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha"))
    thin = rows.select("page_id", "sha")
    groups = thin.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").select("sha", "refers_to")
    marks = thin.join(groups, "sha").distinct().select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "refers_to", F.lit(0).alias("kind"))
    both = marks.unionByName(rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("kind", F.lit(1)))
    order = F.col("page_id").asc_nulls_last()
    sorted_rows = both.repartitionByRange(order).sortWithinPartitions(order, "kind", "sha", "url")
    manifest = over(sorted_rows.select("page_id", "url", "html", "sha", "refers_to", "kind"), _write(path, roll), "name string, records long, bytes long, first_page long")
    manifest.write.parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            some: list[dict] = []
            size = 0
            for row in parse(content.as_py()):
                some.append(row)
                size += len(row["payload"] or b"") + 256
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(some, _ROW)
                    some, size = [], 0
            if some:
                yield pa.RecordBatch.from_pylist(some, _ROW)


_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files in the manifest, digests checked: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    manifest = spark.read.parquet(f"{path}/_manifest").select("name")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(path).select("content", F.element_at(F.split("path", "/"), -1).alias("name"))
    return over(only(files, manifest, "name").select("content"), _read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the cluster's shared folder and read them back."""
    path = Workspace(pages.sparkSession, "warc").folder("archives")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
