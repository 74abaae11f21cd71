"""WARC archives as a PySpark Python data source, for reading and writing.

Reading plans one partition a file. Predicates on record type and other header
columns are pushed down: a record's headers, of any length, are parsed first, and
the payload of an unwanted record is neither inflated nor copied. A header that a
record lacks is null, and columns of other names do not matter to writing. Written files hold one
gzip member a record, whose extra field ``SL`` gives the member's length, so
that the reader can step over it; files without that field, and plain files,
are read too.

Paths are opened with ``pyarrow.fs``. A task writes to a file of its own name
and the commit renames those that count, so a repeated task leaves no double.
"""

from __future__ import annotations

import base64
import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import shared_path, slices

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_length long, content_type string, payload binary"
)
# Header names of the columns that a header gives.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "content_type": "Content-Type",
}
# Columns that the WARC headers alone give: predicates on them are pushed down.
# (The length of a payload is a header in archives written here only, the content type is one of the payload's.)
PUSHED = [c for c in HEADERS if c not in ("payload_length", "content_type")]
EPOCH = "1970-01-01T00:00:00Z"
_ENDS = b"\r\n\r\n"
_LEAST_SHARED = 1000
_SALTS = 8  # tasks that the pages of one payload are dealt to


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def _digest_out(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _digest_in(value: str | None) -> str | None:
    if not value or not value.startswith("sha1:"):
        return value
    value = value[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


def record_bytes(row: dict) -> bytes:
    """A record: headers, a blank line, the block and its end. A revisit's block has HTTP headers alone."""
    payload = row["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {row['content_type'] or 'application/octet-stream'}\r\nContent-Length: {row['payload_length'] or 0}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date'] or EPOCH}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {' '.join(row['target_uri'].split())}")
    if row["refers_to"] is not None:
        lines.append(f"WARC-Refers-To: <{row['refers_to']}>")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    if row["payload_digest"] is not None:
        lines.append(f"WARC-Payload-Digest: {_digest_out(row['payload_digest'])}")
    lines += [f"X-Payload-Length: {row['payload_length'] or 0}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _ENDS + block + _ENDS


def member(data: bytes, level: int = 5) -> bytes:
    """A gzip member whose extra field SL holds its own whole length."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHI", 8, b"SL", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _row(head: dict[str, str]) -> dict:
    row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c].strip("<>") if row[c] is not None else None
    row["payload_digest"] = _digest_in(row["payload_digest"])
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] is not None else None
    return row


def _payload(row: dict, block: bytes) -> tuple[bytes | None, str | None]:
    """(payload, its content type): what follows the HTTP headers, or the whole block where there are none."""
    if row["record_type"] == "revisit":
        return None, None
    if (row["content_type"] or "").startswith("application/http"):
        http, _, body = block.partition(_ENDS)
        return body, _parse(http).get("content-type")
    return block, row["content_type"]


class _Members:
    """Records of a gzip file, each stepped over by its SL length where it has one."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def __iter__(self) -> Iterator[tuple[dict, object]]:
        at = 0
        while at < self.size:
            self.file.seek(at)
            fixed = self.file.read(20)
            if fixed[:4] == b"\x1f\x8b\x08\x04" and fixed[12:14] == b"SL":
                (length,) = struct.unpack("<I", fixed[16:20])
                first = self.file.read(min(2048, length - 28))
                inflate = zlib.decompressobj(-15)
                data = inflate.decompress(first, 4096)
                fed = len(first)
                while _ENDS not in data:
                    more = b"" if inflate.unconsumed_tail else self.file.read(min(65536, length - 28 - fed))
                    if not more and not inflate.unconsumed_tail:
                        raise ValueError(f"the headers of the record at byte {at} have no end")
                    fed += len(more)
                    data += inflate.decompress(inflate.unconsumed_tail + more, 65536)
                head, _, begun = data.partition(_ENDS)
                parsed = _parse(head)
                size = int(parsed.get("content-length", 0))

                def block(inflate=inflate, begun=begun, fed=fed, length=length, size=size, at=at) -> bytes:
                    self.file.seek(at + 20 + fed)
                    rest = inflate.decompress(inflate.unconsumed_tail + self.file.read(length - 28 - fed)) + inflate.flush()
                    return (begun + rest)[:size]

                yield parsed, block
                at += length
            else:
                inflate, data, used = zlib.decompressobj(31), [], 0
                self.file.seek(at)
                while not inflate.eof:
                    more = self.file.read(1 << 20)
                    if not more:
                        break
                    used += len(more)
                    data.append(inflate.decompress(more))
                at += used - len(inflate.unused_data)
                yield from _Plain(io.BytesIO(b"".join(data)))


class _Lines(io.RawIOBase):
    """A pyarrow file for Python's buffered reading by lines."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)

    def seek(self, at: int, whence: int = 0) -> int:
        self.file.seek(at, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()


class _Plain:
    """Records of a file that is not compressed; unwanted blocks are skipped by their length."""

    def __init__(self, file):
        self.file = file

    def __iter__(self) -> Iterator[tuple[dict, object]]:
        while True:
            lines = []
            while line := self.file.readline():
                if line.strip():
                    lines.append(line.rstrip(b"\r\n"))
                elif lines:
                    break
            if not lines:
                return
            head = _parse(b"\r\n".join(lines))
            length, at = int(head.get("content-length", 0)), self.file.tell()
            yield head, lambda at=at, length=length: (self.file.seek(at), self.file.read(length))[1]
            self.file.seek(at + length)


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if len(column) == 1 and column[0] in PUSHED and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, GreaterThanOrEqual, LessThanOrEqual)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        fs, top = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(top, recursive=True)) if fs.get_file_info(top).type == pafs.FileType.Directory else [fs.get_file_info(top)]
        names = sorted(f.path for f in found if f.type == pafs.FileType.File and not posixpath.basename(f.path).startswith((".", "_")))
        return [_File(n) for n in names]

    def wanted(self, row: dict) -> bool:
        for f in self.filters:
            x = row[f.attribute[0]]
            if x is None:
                return False
            if isinstance(f, EqualTo) and x != f.value or isinstance(f, In) and x not in f.value:
                return False
            if isinstance(f, StringStartsWith) and not x.startswith(f.value):
                return False
            if isinstance(f, GreaterThanOrEqual) and not x >= f.value or isinstance(f, LessThanOrEqual) and not x <= f.value:
                return False
        return True

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        schema = to_arrow_schema(self.schema)
        with_payload = "payload" in schema.names
        fs, _ = filesystem(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as file:
            start = file.read(2)
            file.seek(0)
            for head, block in _Members(file) if start == b"\x1f\x8b" else _Plain(io.BufferedReader(_Lines(file))):
                row = _row(head)
                if not self.wanted(row):
                    continue
                if with_payload or row["payload_length"] is None:
                    row["payload"], row["content_type"] = _payload(row, block())
                    if row["payload_length"] is None and row["payload"] is not None:
                        row["payload_length"] = len(row["payload"])
                    held += len(row["payload"] or b"")
                rows.append(row)
                if held > 8 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class _Wrote(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, top = filesystem(self.path)
        fs.create_dir(f"{top}/_tmp", recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{top}/_tmp/{name}", compression=None) as out:
            for batch in slices(iterator, "payload", 4 << 20):
                for row in batch.to_pylist():
                    out.write(member(record_bytes(row)))
                    n += 1
        return _Wrote(name if n else "")

    def commit(self, messages):
        fs, top = filesystem(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(top)):
                if f.type == pafs.FileType.File:
                    fs.delete_file(f.path)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{top}/_tmp/{m.name}", f"{top}/{m.name}")
        fs.delete_dir(f"{top}/_tmp")

    def abort(self, messages):
        fs, top = filesystem(self.path)
        if fs.get_file_info(f"{top}/_tmp").type == pafs.FileType.Directory:
            fs.delete_dir(f"{top}/_tmp")


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it push predicates down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of ``pages`` (page_id, url, html) in the format's columns.

    Null html is empty. Of equal payloads of 1000 bytes or more, the rows with the
    largest page_id are responses (so are repeated rows of that page) and the others
    revisits of it; rows whose page_id is null never count as the largest, and are
    responses only where all are null.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    largest = rows.where(F.col("n") >= _LEAST_SHARED).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("copies"))
    # Only payloads that occur twice meet their rows again, in several tasks each; the rest need no partner, and small ones a key of their own.
    shared = largest.where("copies > 1").select(F.col("digest").alias("shared_digest"), "largest", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("shared_salt"))
    own = F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit(""))
    key = F.when(F.col("n") >= _LEAST_SHARED, F.col("digest")).otherwise(F.concat(F.lit("page "), own))
    known = rows.join(shared, (key == F.col("shared_digest")) & (F.pmod(F.xxhash64(own), F.lit(_SALTS)) == F.col("shared_salt")), "left")
    revisit = F.coalesce(F.col("largest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("largest"))), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return known.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(EPOCH).alias("date"),
        F.when(revisit, urn(F.col("largest"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.col("n").alias("payload_length"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` below ``path``, a new folder."""
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archived pages.

    Responses are measured by the payload that was read back; a revisit holds no
    payload, its headers say what it stands for.
    """
    register(spark)
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    read = spark.read.format("warc").load(path)
    return read.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def archived_pages(pages: DataFrame) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back; one row a page."""
    path = shared_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path)
