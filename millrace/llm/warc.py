"""Web archives (WARC 1.1) as a Spark data source, for reading and writing.

Reading plans whole files into partitions of about PARTITION_BYTES, and writing begins a new file there. A record's header is parsed
first; predicates on the record type and the other header columns are pushed down and decided
there. The payload of a record is only decompressed if the record is wanted and the schema asks for
a payload column: otherwise the reader seeks to the next record, by Content-Length in plain files
and by the length field (`sl`) of each record's own gzip member in compressed ones.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").schema("record_id string, payload binary").load(path)

The schema given may name any of the columns of SCHEMA; only what it names is computed.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .scratch import new_path

PARTITION_BYTES = 64 << 20
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, refers_to string, "
    "headers map<string, string>, payload binary, payload_bytes long, payload_digest string"
)
_HEADER_COLUMNS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "refers_to": "warc-refers-to",
}
_PAYLOAD_COLUMNS = {"payload", "payload_bytes", "payload_digest"}


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _test(f: Filter):
    """A test of one header value, or None if the filter is not one on a header column."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in _HEADER_COLUMNS:
        return None
    tests = {
        EqualTo: lambda v, x: v == x,
        EqualNullSafe: lambda v, x: v == x,
        In: lambda v, x: v in x,
        StringStartsWith: lambda v, x: v is not None and v.startswith(x),
        StringEndsWith: lambda v, x: v is not None and v.endswith(x),
        StringContains: lambda v, x: v is not None and x in v,
        IsNull: lambda v, x: v is None,
        IsNotNull: lambda v, x: v is not None,
    }
    test = tests.get(type(f))
    return test and (_HEADER_COLUMNS[column], test, getattr(f, "value", None))


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _length(headers: dict[str, str]) -> int:
    text = headers.get("content-length", "")
    if not text.isdecimal():
        raise ValueError(f"a WARC record has no valid Content-Length: {text!r}")
    return int(text)


class _Record:
    """One record: its header, and its block when asked for."""

    def __init__(self, headers: dict[str, str], block):
        self.headers, self._block = headers, block

    def block(self) -> bytes:
        return self._block()


def _plain_records(file: BinaryIO) -> Iterator[_Record]:
    size, at = file.size(), 0
    while at < size:
        file.seek(at)
        head = b""
        while (end := head.find(b"\r\n\r\n")) < 0:
            more = file.read(4096)
            if not more:
                if head.strip():
                    raise ValueError("a WARC header has no end")
                return
            head += more
        lead = len(head[:end]) - len(head[:end].lstrip(b"\r\n"))
        headers = _headers(head[lead:end])
        start, length = at + end + 4, _length(headers)
        if start + length > size:
            raise ValueError("a WARC record ends early")

        def block(start: int = start, length: int = length) -> bytes:
            file.seek(start)
            data = file.read(length)
            if len(data) < length:
                raise ValueError("a WARC record ends early")
            return data

        yield _Record(headers, block)
        at = start + length + 4


def _member_size(start: bytes) -> tuple[int, int] | None:
    """The length of a gzip member and of what it holds, from its `sl` field if it has one."""
    if len(start) < 12 or start[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    if not start[3] & 4:
        return None
    extra, at = start[12 : 12 + struct.unpack_from("<H", start, 10)[0]], 0
    while at + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"sl" and n == 8 and at + 12 <= len(extra):
            size, plain = struct.unpack_from("<II", extra, at + 4)
            return (size, plain) if 0 < size < 0xFFFFFFFF and 0 < plain < 0xFFFFFFFF else None
        at += 4 + n
    return None


class _Inflating:
    """A gzip member from its start: what it holds, piece by piece, and where it ends."""

    def __init__(self, file: BinaryIO, at: int):
        file.seek(at)
        self.file, self.at, self.fed, self.rest, self.inflate = file, at, 0, b"", zlib.decompressobj(31)

    def read(self) -> bytes:
        """The next piece, of 64 KiB at most; empty at the end."""
        while not self.inflate.eof:
            data = self.rest or self.file.read(1 << 14)
            if not data:
                raise ValueError("a gzip member ends early")
            self.fed += 0 if self.rest else len(data)
            out = self.inflate.decompress(data, 1 << 16)
            self.rest = self.inflate.unconsumed_tail
            if out:
                return out
        return b""

    def end(self) -> int:
        while self.read():
            pass
        return self.at + self.fed - len(self.inflate.unused_data)


class _Block:
    """A record's block in a member: read when asked for, and passed over otherwise."""

    def __init__(self, source: _Inflating, got: bytes, length: int):
        self.source, self.got, self.length = source, got, length

    def _next(self) -> bytes:
        piece = self.source.read()
        if not piece:
            raise ValueError("a WARC record ends early")
        return piece

    def read(self) -> bytes:
        parts, n = [self.got], len(self.got)
        while n < self.length:
            parts.append(self._next())
            n += len(parts[-1])
        self.got = b"".join(parts)
        return self.got[: self.length]

    def rest(self) -> bytes:
        """What has been inflated of what comes after the block."""
        got, n = self.got, len(self.got)
        while n < self.length:
            got = self._next()
            n += len(got)
        return got[len(got) - (n - self.length) :]


def _gzip_records(file: BinaryIO) -> Iterator[_Record]:
    """The records of a file of gzip members, one or more in a member. A member is inflated once: as far as
    the header of its last record, further if that block is asked for, and to its end, with nothing kept, if
    it does not tell its lengths."""
    size, at = file.size(), 0
    while at < size:
        file.seek(at)
        told = _member_size(file.read(4096))
        source, plain, before, some = _Inflating(file, at), b"", 0, False
        while True:
            while b"\r\n\r\n" not in plain.lstrip(b"\r\n") and (more := source.read()):
                plain += more
            lead = len(plain) - len(plain.lstrip(b"\r\n"))
            end = plain.find(b"\r\n\r\n", lead)
            if end < 0:
                if plain.strip() or not some:
                    raise ValueError("a WARC header has no end")
                at = source.end()
                break
            headers = _headers(plain[lead:end])
            block = _Block(source, plain[end + 4 :], _length(headers))
            yield _Record(headers, block.read)
            some = True
            before += end + 4 + block.length
            if told and before + 4 >= told[1]:
                at += told[0]
                break
            plain = block.rest()


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, dict[str, str]]:
    """The payload in a record's block, and the HTTP headers before it if it has any."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block, {}
    head, _, body = block.partition(b"\r\n\r\n")
    return body, _headers(head)


def _hex(digest: str | None) -> str | None:
    if not digest or not digest.lower().startswith("sha1:"):
        return None
    value = digest[5:]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: Sequence[str]):
        super().__init__(None)
        self.paths = tuple(paths)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema, self.tests = options["path"], schema, []
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            test = _test(f)
            if test:
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        files, root = _file_system(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")))
        groups: list[list[str]] = [[]]
        size = 0
        for path, n in found:
            if groups[-1] and size + n > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [_Files(x) for x in groups]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = self.schema.names
        types = to_arrow_schema(self.schema)
        files, _ = _file_system(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with files.open_input_file(path) as file:
                for record in (_gzip_records if path.endswith(".gz") else _plain_records)(file):
                    if not all(test(record.headers.get(h), v) for h, test, v in self.tests):
                        continue
                    row = self._row(record, names)
                    rows.append(row)
                    size += 200 + len(row.get("payload") or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)

    @staticmethod
    def _row(record: _Record, names: list[str]) -> dict[str, Any]:
        h = record.headers
        row: dict[str, Any] = {c: h.get(_HEADER_COLUMNS[c]) for c in names if c in _HEADER_COLUMNS}
        if "headers" in names:
            row["headers"] = list(h.items())
        if _PAYLOAD_COLUMNS & set(names):
            payload, http = payload_of(h, record.block())
            if h.get("warc-type") == "revisit":  # the payload is elsewhere; its size and digest are told
                length = http.get("content-length")
                row |= {"payload": None, "payload_bytes": int(length) if length else None, "payload_digest": _hex(h.get("warc-payload-digest"))}
            else:
                row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest() if "payload_digest" in names else None}
        return {c: row.get(c) for c in names}


def _line(name: str, value: Any) -> str:
    """A header line; line ends and the ends' spaces of a value are percent-encoded, as they would be lost."""
    text = str(value).replace("\r", "%0D").replace("\n", "%0A")
    body = text.strip(" \t")
    lead, tail = text[: len(text) - len(text.lstrip(" \t"))], text[len(text.rstrip(" \t")) :] if body else ""
    text = "".join(f"%{ord(c):02X}" for c in lead) + body + "".join(f"%{ord(c):02X}" for c in tail)
    return f"{name}: {text}\r\n"


def encode_record(row: dict[str, Any]) -> bytes:
    """A record of record_type, record_id, target_uri, date, refers_to and payload as written to a file."""
    kind, payload = row["record_type"], row.get("payload") or b""
    length = len(payload) if row.get("payload_bytes") is None else row["payload_bytes"]
    digest = row.get("payload_digest")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if kind != "revisit":
        block += payload
    lines = [_line("WARC-Type", kind), _line("WARC-Record-ID", row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>"), _line("WARC-Date", row.get("date") or "1970-01-01T00:00:00Z")]
    if row.get("target_uri") is not None:
        lines.append(_line("WARC-Target-URI", row["target_uri"]))
    if digest:
        lines.append(_line("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if kind == "revisit":
        lines.append(_line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if row.get("refers_to") is not None:
            lines.append(_line("WARC-Refers-To", row["refers_to"]))
    lines += [_line("Content-Type", "application/http;msgtype=response"), _line("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member that tells its compressed and plain length in the `sl` field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    fit = lambda n: min(n, 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, fit(size), fit(len(data)))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    paths: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own; the commit renames those of the tasks that count."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.compressed = options.get("compression", "gzip") != "none"
        self.file_bytes = int(options.get("filebytes", PARTITION_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _file_system(self.path)
        files.create_dir(f"{root}/_temporary", recursive=True)
        end = ".warc.gz" if self.compressed else ".warc"
        paths: list[tuple[str, str]] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = encode_record(row)
                    data = member(data) if self.compressed else data
                    if out is None or size + len(data) > self.file_bytes:
                        if out:
                            out.close()
                        name, size = f"{uuid.uuid4().hex}{end}", 0
                        paths.append((f"{root}/_temporary/{name}", f"{root}/{name}"))
                        out = files.open_output_stream(paths[-1][0], compression=None)
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return _Written(paths)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _file_system(self.path)
        if self.overwrite:
            for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.type == fs.FileType.File:
                    files.delete_file(x.path)
        for m in messages:
            for a, b in m.paths if m else ():
                files.move(a, b)
        self._clear(files, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_file_system(self.path))

    @staticmethod
    def _clear(files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_temporary")


class WarcDataSource(DataSource):
    """Options: path, partitionBytes (reading), compression gzip or none and fileBytes (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records_of_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The records that archive pages (page_id, url, html): of equal payloads of at least `least` bytes
    that of the largest page_id is a response and the others are revisits of it; others are responses.

    A null html is an empty payload. A null page_id comes before all others and is written as an
    empty id. Rows equal in page_id and payload are all responses. The copies of a payload are counted by
    digest, combined before the shuffle; only digests with several page_ids are joined back, in a
    join that splits a digest shared by very many pages.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("last"), F.count("*").alias("n"), F.count("page_id").alias("known"))
    large = large.where("first != last or known < n").select("payload_digest", "first", F.lit(True).alias("shared"))
    marked = rows.join(large, "payload_digest", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return marked.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        "target_uri",
        F.when(revisit, urn("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
    )


def archive_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of the pages, read
    back from the archives they are written to, in the shared folder."""
    spark = pages.sparkSession
    register(spark)
    path = new_path(spark, "warc")
    records_of_pages(pages, least).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").schema("record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string").load(path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri")
