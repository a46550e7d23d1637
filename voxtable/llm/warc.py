"""WARC archives: one gzip member a record, written and read by range.

``WarcDataSource`` is a Spark data source named ``warc``. Writing, every task fills one
archive; the driver commits them by a manifest, so files of lost or repeated attempts are
never read. Reading, archives are cut into byte ranges. A task looks for the gzip magic in
its range, takes a place for a record only if the bytes there decode to a WARC header,
and owns the records that start inside its range, reading beyond its end if need be.

``archive_pages`` decides which pages are responses and which revisit an equal payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from voxtable.plans.skew import skew_join
from voxtable.plans.storage import fresh_path, small_side, staged

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
MANIFEST = "_manifest.json"
#: Bytes of a range; bytes read at once; payload bytes in a batch; bytes decoded to try a candidate.
RANGE_BYTES, BLOCK, BATCH_BYTES, PROBE = 8 << 20, 1 << 20, 8 << 20, 1024
#: Payloads under this length are never stored as revisits.
REVISIT_BYTES = 1000
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:(?!//)", "file://", path))


def record(row: dict, date: str) -> bytes:
    """A whole record, not compressed. A revisit has the HTTP header of the full payload and no payload."""
    payload = row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http if row["record_type"] == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}",
        f"Content-Length: {len(block)}",
    ]
    if row["target_uri"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), row["target_uri"]))
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row['refers_to']}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The row of a record; the digest of a stored payload is computed anew and must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    length = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
    stored = fields["warc-type"] != "revisit"
    if stored and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its header")
    name = lambda k: fields[k].strip("<>") if k in fields else None
    return {
        "record_id": name("warc-record-id"),
        "record_type": fields["warc-type"],
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": name("warc-refers-to"),
        "payload_digest": digest,
        "payload_bytes": length,
        "payload": payload if stored else None,
    }


def records_in(file: pa.NativeFile, start: int, end: int, size: int) -> Iterator[bytes]:
    """Decoded records whose gzip member starts in [start, end)."""
    at, window, base = start, b"", start
    while at < end:
        if not base <= at < base + len(window) - len(MAGIC):
            window, base = file.read_at(min(BLOCK, size - at), at), at
        found = window.find(MAGIC, at - base)
        if found < 0:
            if base + len(window) >= size:
                return
            at = base + len(window) - len(MAGIC) + 1
            continue
        at = base + found
        if at >= end:
            return
        member = _member(file, at, size)
        if member is None:
            at += 1
        else:
            data, at = member
            yield data


def _member(file: pa.NativeFile, at: int, size: int) -> tuple[bytes, int] | None:
    """The record in the member at ``at`` and the end of the member; None if no record starts there.

    Once the first bytes have decoded to a WARC header, a damaged or cut member is an error:
    no record is lost without notice.
    """
    unzip, start, probe = zlib.decompressobj(31), at, file.read_at(min(PROBE, size - at), at)
    out = b""
    try:
        for k in range(0, len(probe), 16):  # bit by bit, so that damage behind the header doesn't hide it
            out += unzip.decompress(probe[k : k + 16])
            if not VERSION.startswith(out[: len(VERSION)]):
                return None
            if len(out) >= len(VERSION):
                break
    except zlib.error:
        return None
    if not out.startswith(VERSION):
        return None
    parts, data, at = [out], probe[k + 16 :], at + len(probe)
    try:
        while True:
            parts.append(unzip.decompress(data))
            if unzip.eof:
                return b"".join(parts), at - len(unzip.unused_data)
            data = file.read_at(min(BLOCK // 16, size - at), at)
            if not data:
                raise ValueError(f"the WARC record at byte {start} is cut short")
            at += len(data)
    except zlib.error as error:
        raise ValueError(f"the WARC record at byte {start} is damaged") from error


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for row in batch.to_pylist():
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                zipper = zlib.compressobj(5, zlib.DEFLATED, 31)
                out.write(zipper.compress(record(row, self.date)) + zipper.flush())
        if out:
            out.close()
        return _Written(name if out else None)

    def commit(self, messages: list) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())

    def abort(self, messages: list) -> None:
        """Without a manifest nothing that was written counts."""


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"

    def partitions(self) -> list[_Range]:
        fs, root = _fs(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = [f"{root}/{n}" for n in json.loads(f.read())]
            infos = fs.get_file_info(names) if names else []
        else:
            infos = [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.endswith(".warc.gz")]
        out = [_Range(i.path, at, min(i.size, at + self.step), i.size) for i in infos for at in range(0, i.size, self.step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        fs, _ = _fs(self.path)
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in (x.split()[0] for x in SCHEMA.split(", "))])
        rows, held = [], 0
        with fs.open_input_file(partition.path) as file:
            for data in records_in(file, partition.start, partition.end, partition.size):
                row = parse(data)
                if not self.payload:
                    row["payload"] = None
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``; options path, rangeBytes, payload (false: leave payloads out), date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def page_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) as rows for the archive, in the columns of ``SCHEMA``.

    Of equal payloads of at least ``least`` bytes that of the largest page_id is the
    response; rows with that same id and payload are all responses. Null html is an empty
    payload. Null ids count as smallest. Only ids and digests are shuffled unless revisits
    outnumber the broadcast bound.
    """
    body: Column = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("_p")).withColumn("_d", F.sha1("_p")).withColumn("_n", F.octet_length("_p").cast("long"))
    large = staged(rows.filter(F.col("_n") >= least).select("page_id", "_d"), "warc-digests")
    groups = staged(large.groupBy("_d").agg(F.max("page_id").alias("_keep"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"), "warc-groups")
    again = skew_join(large, groups, ["_d"], "_rows").filter(~F.col("page_id").eqNullSafe(F.col("_keep")))
    again = small_side(staged(again.select(F.col("page_id").alias("_id2"), F.col("_d").alias("_d2"), "_keep").distinct(), "warc-revisits"))
    marked = rows.join(again, rows["page_id"].eqNullSafe(again["_id2"]) & (rows["_d"] == again["_d2"]), "left")
    revisit = F.col("_d2").isNotNull()
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return marked.select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, urn("_keep")).alias("refers_to"),
        F.col("_d").alias("payload_digest"),
        F.col("_n").alias("payload_bytes"),
        F.when(~revisit, F.col("_p")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> str:
    """Write ``pages`` to archives under ``path`` (default: a new folder of the shared one); return it."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    spark.dataSource.register(WarcDataSource)
    page_records(pages).write.format("warc").mode("append").save(path)
    return path


def read_pages(spark, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per archived page: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``."""
    spark.dataSource.register(WarcDataSource)
    records = spark.read.format("warc").option("rangeBytes", range_bytes).option("payload", "false").load(path)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
