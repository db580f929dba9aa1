"""WARC archives as a PySpark data source named ``warc``.

Writing: one file per task, one gzip member per record. A member's extra field holds its compressed size (the
``sl`` field of the WARC specification's gzip annex), so a reader can pass over a record after its headers.
Files of failed attempts are never listed: the commit writes a manifest of the files that count.

Reading: whole files are dealt to partitions by size. Filters on record type and other header fields are pushed
down; headers are parsed first, and a payload is only decoded for records that pass, and only if wanted
(option ``payload``, true by default). Archives of other writers read too: plain, or gzip with any number of
records in a member and any header fields of gzip. A record that the file ends in is read as far as it goes;
one whose headers are cut off is left out.
"""

from __future__ import annotations

import io
import json
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
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from tracemill.functions.workspace import Workspace, checked_lookup

SCHEMA = """record_type string, record_id string, target_uri string, date string, refers_to string,
payload_digest string, payload_bytes long, payload binary"""
COLUMNS = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload")

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
#: Payloads shorter than this are always stored again.
MIN_REVISIT_BYTES = 100
#: Small files are read together up to so many bytes.
PARTITION_BYTES = 64 << 20
READ_BYTES = 1 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, or of a path on a file system all machines mount."""
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://") if path.startswith("file:") else f"file://{path}")


def _clean(value: str) -> str:
    """A header value without characters that would end its line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record_bytes(row: dict) -> bytes:
    """One record. A revisit keeps the HTTP header, with the payload's full length, but no payload."""
    payload = row["payload"] or b""
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if row["record_type"] == "revisit" else http + payload
    head = [VERSION.decode(), f"WARC-Type: {row['record_type']}"]
    head.append(f"WARC-Date: {row['date'] or NO_DATE}")
    for name, column, form in (
        ("WARC-Record-ID", "record_id", "<{}>"),
        ("WARC-Target-URI", "target_uri", "{}"),
        ("WARC-Refers-To", "refers_to", "<{}>"),
        ("WARC-Payload-Digest", "payload_digest", "sha256:{}"),
    ):
        if row[column] is not None:
            head.append(f"{name}: {form.format(_clean(row[column]))}")
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {REVISIT}")
    head.append("Content-Type: application/http;msgtype=response")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field tells its compressed and full size."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = deflate.compress(data) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(packed), len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.level, self.names = options["path"], int(options.get("level", 6)), names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        name, count, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    out = out or files.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(gzip_member(record_bytes({c: row.get(c) for c in COLUMNS}), self.level))
                    count += 1
        finally:
            if out is not None:
                out.close()
        return Written(name if count else None, count)

    def commit(self, messages) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        listed = sorted(m.file for m in messages if m is not None and m.file)
        with files.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        files, root = filesystem(self.path)
        for m in messages:
            if m is not None and m.file:
                files.delete_file(f"{root}/{m.file}")


class Bytes:
    """Buffered reading with cheap passing over."""

    def __init__(self, file):
        self.file, self.buffer, self.at = file, b"", 0

    def peek(self, n: int) -> bytes:
        if len(self.buffer) - self.at < n:
            more = self.file.read(max(n, READ_BYTES))
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        return self.buffer[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        data = self.peek(n)
        self.at += len(data)
        return data

    def give_back(self, n: int) -> None:
        self.at -= n

    def place(self) -> int:
        """Where in the file the next byte is."""
        return self.file.tell() - len(self.buffer) + self.at

    def go(self, place: int) -> None:
        self.file.seek(place)
        self.buffer, self.at = b"", 0

    def skip(self, n: int) -> None:
        held = len(self.buffer) - self.at
        if n <= held:
            self.at += n
        else:
            self.file.seek(self.file.tell() + n - held)
            self.buffer, self.at = b"", 0


class Member:
    """The decoded bytes of one gzip member, read as far as they are asked for."""

    def __init__(self, source: Bytes):
        self.source, self.inflate, self.buffer = source, zlib.decompressobj(31), b""

    def peek(self, n: int) -> bytes:
        parts, held = [self.buffer], len(self.buffer)
        while held < n and not self.inflate.eof:
            # what the last call left undecoded goes first
            packed = self.inflate.unconsumed_tail or self.source.take(64 << 10)
            if not packed:
                break
            parts.append(self.inflate.decompress(packed, max(n - held, 4096)))
            held += len(parts[-1])
        self.buffer = b"".join(parts)
        return self.buffer[:n]

    def take(self, n: int) -> bytes:
        data = self.peek(n)
        self.buffer = self.buffer[len(data) :]
        return data

    def skip(self, n: int) -> None:
        while n > 0 and (passed := len(self.take(min(n, READ_BYTES)))):
            n -= passed

    def finish(self) -> None:
        """Leave the source where the next member starts."""
        self.buffer = b""
        while not self.inflate.eof and self.peek(READ_BYTES):
            self.buffer = b""
        self.source.give_back(len(self.inflate.unused_data))


def parse_headers(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields


def header_row(fields: dict[str, str]) -> dict:
    digest = fields.get("warc-payload-digest")
    bare = lambda v: v[1:-1] if v and v[0] == "<" and v[-1] == ">" else v
    return {
        "record_type": fields.get("warc-type"),
        "record_id": bare(fields.get("warc-record-id")),
        "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "refers_to": bare(fields.get("warc-refers-to")),
        "payload_digest": digest.partition(":")[2] if digest and ":" in digest else digest,
        "payload_bytes": None,
        "payload": None,
    }


def head_end(source: Bytes | Member, most: int | None = None) -> int | None:
    """Bytes up to and with the empty line that ends a header, within ``most``; none if there is no such line."""
    size = 4096
    while True:
        data = source.peek(size if most is None else min(size, most))
        if (at := data.find(b"\r\n\r\n")) >= 0:
            return at + 4
        if len(data) < size:
            return None
        size *= 2


def block_bytes(fields: dict[str, str]) -> int:
    digits = fields.get("content-length", "")
    return int(digits) if digits.isdigit() else 0


def measure(source: Bytes | Member, row: dict, fields: dict[str, str]) -> tuple[int, bool]:
    """Set the payload's length; (bytes of the block that are left, whether the HTTP header ended).

    No more than the HTTP header is decoded: without a Content-Length in it, the length is that of the block
    less the header.
    """
    left, size, ended = block_bytes(fields), None, True
    if fields.get("content-type", "").startswith("application/http"):
        end = head_end(source, left)
        ended = end is not None
        http = source.take(left if end is None else end)
        left -= len(http)
        told = parse_headers(http).get("content-length")
        size = int(told) if told and told.isdigit() else None
    row["payload_bytes"] = left if size is None else size
    return left, ended


def block_records(source: Bytes | Member, wanted, payload: bool) -> Iterator[dict]:
    """The wanted records that follow one another in ``source``, up to its end or to what is no record."""
    while True:
        while (mark := source.peek(5)) and mark[:1] in b"\r\n":
            source.skip(1)
        if mark != b"WARC/" or (end := head_end(source)) is None:
            return
        fields = parse_headers(source.take(end)[:-4])
        row = header_row(fields)
        if not wanted(row):
            source.skip(block_bytes(fields))
            continue
        left, _ = measure(source, row, fields)
        if payload and row["record_type"] != "revisit":
            row["payload"] = source.take(left)
        else:
            source.skip(left)
        yield row


def records(file, wanted, payload: bool) -> Iterator[dict]:
    """The rows of one archive that ``wanted`` accepts by their headers."""
    source = Bytes(file)
    while start := source.peek(12):
        if start[:2] == b"\x1f\x8b":
            yield from member_records(source, start, wanted, payload)
        elif start.startswith(b"WARC/"):
            place = source.place()
            yield from block_records(source, wanted, payload)
            if source.place() == place:
                return  # the file ends in these headers
        else:
            source.skip(1)  # stray bytes between records


def own_sizes(source: Bytes, start: bytes) -> tuple[int, int, int] | None:
    """(header, packed and full size) of a member whose extra field tells them and that has no other header field."""
    if len(start) < 12 or start[3] != 4:
        return None
    (n,) = struct.unpack("<H", start[10:12])
    extra, at = source.peek(12 + n)[12:], 0
    while at + 4 <= len(extra):
        (m,) = struct.unpack("<H", extra[at + 2 : at + 4])
        if extra[at : at + 2] == b"sl" and m == 8 and at + 12 <= len(extra):
            return (12 + n, *struct.unpack("<II", extra[at + 4 : at + 12]))
        at += 4 + m
    return None


def member_records(source: Bytes, start: bytes, wanted, payload: bool) -> Iterator[dict]:
    """The records of one gzip member; one record that is not wanted, or whose payload is not, is passed over packed."""
    sizes = own_sizes(source, start)
    if sizes is not None:
        header, packed, full = sizes
        for size in (header + min(packed, 2048), header + packed):
            member = Member(Bytes(io.BytesIO(source.peek(size))))
            try:
                end = head_end(member)
            except zlib.error:
                break
            if end is None:
                continue
            fields = parse_headers(member.take(end)[:-4])
            row = header_row(fields)
            fills = (end + block_bytes(fields) + 4) & 0xFFFFFFFF == full
            if not fills or (payload and wanted(row)):
                break  # several records, or one to decode
            if wanted(row):
                _, ended = measure(member, row, fields)
                if not ended and size < header + packed:
                    continue
                yield row
            source.skip(header + packed + 8)
            return
    place = source.place()
    member = Member(source)
    try:
        yield from block_records(member, wanted, payload)
        member.finish()
    except zlib.error:  # a damaged member; its records before the damage are told
        source.go(place + 3)
        next_member(source)


def next_member(source: Bytes) -> None:
    """Pass on to what looks like the next gzip member, or to the end."""
    while data := source.peek(READ_BYTES):
        if (at := data.find(b"\x1f\x8b\x08")) >= 0:
            source.skip(at)
            return
        source.skip(max(1, len(data) - 2))


def holds(f: Filter, row: dict) -> bool:
    """Whether a pushed filter holds on header values; null makes comparisons false."""
    if isinstance(f, Not):
        inner = f.child
        if isinstance(inner, (IsNull, IsNotNull, EqualNullSafe)):
            return not holds(inner, row)
        return row[inner.attribute[0]] is not None and not holds(inner, row)
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, In):
        return value in f.value
    tests = {
        EqualTo: lambda a, b: a == b,
        GreaterThan: lambda a, b: a.encode() > b.encode(),
        GreaterThanOrEqual: lambda a, b: a.encode() >= b.encode(),
        LessThan: lambda a, b: a.encode() < b.encode(),
        LessThanOrEqual: lambda a, b: a.encode() <= b.encode(),
        StringStartsWith: lambda a, b: a.startswith(b),
        StringEndsWith: lambda a, b: a.endswith(b),
        StringContains: lambda a, b: b in a,
    }
    return tests[type(f)](value, f.value)


HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")
SUPPORTED = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)


def can_push(f: Filter) -> bool:
    if isinstance(f, Not):
        return isinstance(f.child, SUPPORTED) and not isinstance(f.child, In) and f.child.attribute[0] in HEADER_COLUMNS
    return isinstance(f, SUPPORTED) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if can_push(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        files, root = filesystem(self.path)
        found = files.get_file_info(pafs.FileSelector(root, recursive=True))
        manifests = [f for f in found if f.base_name.startswith("_manifest-")]
        listed: set[str] | None = set() if manifests else None
        for m in manifests:
            folder = m.path.rpartition("/")[0]
            with files.open_input_stream(m.path, compression=None) as source:
                listed |= {f"{folder}/{name}" for name in json.loads(source.read())}
        archives = [f for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and (listed is None or f.path in listed)]
        parts, size = [[]], 0
        for f in sorted(archives, key=lambda f: f.path):
            if parts[-1] and size + f.size > self.partition_bytes:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.path)
        wanted = lambda row: all(holds(f, row) for f in self.filters)
        schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in COLUMNS])
        rows, size = [], 0
        for path in partition.paths:
            with files.open_input_file(path) as file:
                for row in records(file, wanted, self.payload):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(frame: DataFrame, path: str, level: int = 6) -> None:
    """Append records (columns of the schema; missing ones are null) as archives under ``path``."""
    register(frame.sparkSession)
    given = [F.col(c) if c in frame.columns else F.lit(None).alias(c) for c in COLUMNS]
    typed = frame.select(*given).select(*[F.col(c).cast("binary" if c == "payload" else "long" if c == "payload_bytes" else "string") for c in COLUMNS])
    typed.write.format("warc").option("path", path).option("level", str(level)).mode("append").save()


def page_records(pages: DataFrame, work: Workspace, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Records of pages (page_id, url, html): equal payloads are stored once, by the smallest page_id.

    Null html is an empty payload. Rows that repeat the smallest page_id are all responses; a page without id
    is never the one referred to, and pages without ids alone are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("target_uri"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    repeated = (
        sized.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("payload_digest", "first")
    )
    firsts = work.table("repeated", repeated)
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return checked_lookup(sized, firsts, "payload_digest", F.coalesce("page_id", F.lit(0))).select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")).alias("record_id"),
        "target_uri",
        F.when(again, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    work = Workspace(spark, "warc")
    write_warc(page_records(pages, work), work.path("archives"))
    read = read_warc(spark, work.path("archives"))
    page_id = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).cast("long")
    response = F.col("record_type") == "response"
    return read.select(
        page_id("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page_id("refers_to").alias("refers_to"),
    )


OP2_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM r
"""
