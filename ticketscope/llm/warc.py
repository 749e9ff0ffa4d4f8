"""WARC archives as a PySpark Python data source, "warc".

Writing: each task writes files of up to `max_file_bytes`; each commit writes a manifest of its own of
the files of the attempts that succeeded, so files of a lost attempt are never read. Appending adds a
manifest, overwriting deletes the earlier ones (then the files that they name). Every record is a
gzip member of its own whose extra field "sl" holds the member's compressed and uncompressed length.

Reading: the manifests (or a listing, where there is none) are planned into partitions of about
`partition_bytes`. Filters on record and header columns are pushed down. For each record the reader
inflates its head only, parses the headers, tests the filters, and skips to the next member by the
"sl" lengths when the record or its payload isn't wanted. A member without that field may hold
several records, or one record several members: it is read as one stream, record after record by
their Content-Length. The payload is decoded only if the schema asks for the column `payload`; with
`verify` its digest is computed again. What can't be read (a record cut off, bytes that are no
record, a damaged member, a wrong digest) raises an error that names the file and the offset.

Files are opened by pyarrow's file systems, so folders may be in any store it knows.

A null payload is written as empty, a null URI is left out, control characters in header values
are percent-encoded. Rows that repeat are records of their own. An empty table gives an archive
without records and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter,
                                    In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

MAX_FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
HEAD_BYTES = 4096
MANIFEST = re.compile(r"_manifest.*\.json$")
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Column -> header.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_length long, payload binary")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def _value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(row: dict) -> bytes:
    """A WARC/1.1 record: an HTTP response, or a revisit with its HTTP head alone."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    length = row["payload_length"] if revisit else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_value(row['record_id'])}>",
            f"WARC-Date: {DATE}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_value(row['target_uri'])}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
    if row["refers_to"] is not None:
        head.append(f"WARC-Refers-To: <{_value(row['refers_to'])}>")
    head += [f"WARC-Payload-Digest: sha1:{row['payload_digest'] or base32_sha1(payload)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with the lengths of the whole member and of the data in its extra field."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 4 + 8 + len(body) + 8
    extra = struct.pack("<2sHII", b"sl", 8, total, len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]] = field(default_factory=list)


def _manifests(system: fs.FileSystem, folder: str) -> dict[str, list]:
    """The manifests of a folder and the (name, size) of their files."""
    out = {}
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if MANIFEST.match(info.base_name):
            with system.open_input_stream(info.path) as f:
                out[info.base_name] = [tuple(x) for x in json.loads(f.read())]
    return out


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.max_file_bytes = int(options.get("max_file_bytes", MAX_FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _open(self.path)
        done, out, name, size = Written(), None, "", 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(folder, recursive=True)
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                data = member(record(row))
                out.write(data)
                size += len(data)
                if size >= self.max_file_bytes:
                    out.close()
                    done.files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.files.append((name, size))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        files = sorted(f for m in messages if m for f in m.files)
        earlier = _manifests(system, folder) if self.overwrite else {}
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())
        for name in earlier:
            system.delete_file(f"{folder}/{name}")
        for name, _ in (f for old in earlier.values() for f in old):
            if system.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
                system.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                system.delete_file(f"{folder}/{name}")


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.path, self.columns = options["path"], schema.names
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.verify = options.get("verify", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith)):
                kind = {EqualTo: "in", EqualNullSafe: "is", In: "in", IsNotNull: "set", StringStartsWith: "starts"}[type(f)]
                value = getattr(f, "value", None)
                self.tests.append((column, kind, value if isinstance(f, In) else (value,) if kind == "in" else value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, folder = _open(self.path)
        known = _manifests(system, folder)
        files = sorted(f for listed in known.values() for f in listed)
        if not known:
            found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            files = [(x.base_name, x.size) for x in found if re.search(r"\.warc(\.gz)?$", x.base_name)]
        out, names, total = [], [], 0
        for name, size in files:
            if names and total + size > self.partition_bytes:
                out.append(Files(names))
                names, total = [], 0
            names.append(name)
            total += size
        return out + [Files(names)]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            x = row[column]
            if not (x is not None and x in value if kind == "in" else x == value if kind == "is"
                    else x is not None if kind == "set" else x is not None and x.startswith(value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, folder = _open(self.path)
        types = {"payload_length": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, types.get(c, pa.string())) for c in self.columns])
        rows, held = [], 0
        for name in partition.names:
            with system.open_input_file(f"{folder}/{name}") as f:
                for row in self._records(f, name):
                    rows.append({c: row.get(c) for c in self.columns})
                    held += len(row.get("payload") or b"") + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, f, name: str) -> Iterator[dict]:
        size, at, stream = f.size(), 0, None
        while stream is not None or at < size:
            try:
                take = stream or (_Member if name.endswith(".gz") else _Plain)(f, at, size)
                begin = take.upto(HEAD_BYTES)
                if len(begin) < HEAD_BYTES and not begin.strip(b"\r\n"):
                    return  # nothing but line ends
                head = take.until(b"\r\n\r\n")
                if head is None or not head.startswith(b"WARC/"):
                    raise ValueError("no record")
                fields = _fields(head)
                length = int(fields["content-length"])
                row = {c: fields.get(h) for c, h in HEADERS.items()}
                for c in ("record_id", "refers_to"):
                    row[c] = row[c].strip("<>") if row[c] is not None else None
                row["payload_digest"] = row["payload_digest"].removeprefix("sha1:") if row["payload_digest"] else None
                wanted = self._wanted(row)
                if wanted and {"payload", "payload_length"} & set(self.columns):
                    self._block(row, fields, take, len(head), length)
                at, stream = take.after(len(head) + length)
            except (KeyError, ValueError, zlib.error, struct.error) as e:
                raise ValueError(f"{name}, from offset {at}: {e}") from e
            if wanted:
                yield row

    def _block(self, row: dict, fields: dict, take, start: int, length: int) -> None:
        http = fields.get("content-type", "").startswith("application/http")
        body = take.until(b"\r\n\r\n", start) if http and length else b""
        inner = _fields(body) if body else {}
        own = length - len(body or b"")
        revisit = row["record_type"] == "revisit"
        row["payload_length"] = int(inner.get("content-length", 0)) if revisit else own
        if "payload" in self.columns and not revisit:
            skip = start + len(body or b"")
            row["payload"] = take.upto(skip + own)[skip:]
            if len(row["payload"]) < own:
                raise ValueError("a record is cut off")
            if self.verify and row["payload_digest"] and base32_sha1(row["payload"]) != row["payload_digest"]:
                raise ValueError(f"payload digest of {row['record_id']} doesn't match")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


class _Plain:
    """An uncompressed record that begins at `at`."""

    def __init__(self, f, at: int, size: int) -> None:
        self.f, self.at, self.size, self.data = f, at, size, b""

    def upto(self, n: int) -> bytes:
        if len(self.data) < n:
            self.f.seek(self.at + len(self.data))
            self.data += self.f.read(min(n - len(self.data), self.size - self.at - len(self.data)))
        return self.data[:n]

    def until(self, mark: bytes, start: int = 0) -> bytes | None:
        n = start + HEAD_BYTES
        while True:
            data = self.upto(n)
            if (i := data.find(mark, start)) >= 0:
                return data[start:i + len(mark)]
            if len(data) < n:
                return None
            n *= 2

    def after(self, length: int) -> tuple[int, _Plain | None]:
        """Where the next record begins, and the stream that holds it, if it goes on in this one."""
        end = self.at + length + 4
        if end > self.size:
            raise ValueError("a record is cut off")
        return end, None


class _Member(_Plain):
    """Gzip members from `at` on, inflated no further than asked for. A member with its length in
    the head is read by itself; one without goes on into the next."""

    def __init__(self, f, at: int, size: int) -> None:
        super().__init__(f, at, size)
        f.seek(at)
        head = f.read(64)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError("no gzip member")
        self.whole = None
        if head[3:4] and head[3] & 4:
            n = struct.unpack_from("<H", head, 10)[0]
            extra, i = head[12:12 + n], 0
            while i + 4 <= len(extra):
                key, size_ = struct.unpack_from("<2sH", extra, i)
                if key == b"sl" and size_ == 8:
                    self.whole = struct.unpack_from("<I", extra, i + 4)[0]
                i += 4 + size_
        if self.whole and at + self.whole > size:
            raise ValueError("a record is cut off")
        self.read_at, self.unzip, self.rest = at, zlib.decompressobj(31), b""

    def _more(self) -> bytes:
        """Compressed bytes to go on with."""
        if not self.rest:
            self.f.seek(self.read_at)
            self.rest = self.f.read(HEAD_BYTES if not self.data else 1 << 18)
            self.read_at += len(self.rest)
        return self.rest

    def upto(self, n: int) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < n and (tail := self._more()):
            if self.unzip.eof:  # the next member of the stream
                if self.whole or not tail.startswith(b"\x1f"):
                    break
                self.unzip = zlib.decompressobj(31)
            part = self.unzip.decompress(tail, n - have)
            self.rest = self.unzip.unconsumed_tail if not self.unzip.eof else self.unzip.unused_data
            parts.append(part)
            have += len(part)
        self.data = b"".join(parts)
        return self.data[:n]

    def after(self, length: int) -> tuple[int, _Plain | None]:
        if self.whole:
            return self.at + self.whole, None
        if len(self.upto(length + 4)) < length:
            raise ValueError("a record is cut off")
        self.data = self.data[length + 4:]
        if self.upto(1):
            return self.read_at - len(self.rest), self
        if not self.unzip.eof:
            raise ValueError("a gzip member is cut off")
        end = self.read_at - len(self.rest)
        if end < self.size:
            raise ValueError("bytes after the last member")
        return end, None


class WarcDataSource(DataSource):
    """format("warc"). Options: path, partition_bytes, verify; max_file_bytes for writing. Read
    with a schema of fewer columns of SCHEMA to leave the rest undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("warc") known, and let Spark push filters to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records for pages: of equal payloads of at least `min_bytes`, the rows with the smallest
    page_id are responses and the others revisit it; smaller payloads are all responses. A null
    page_id comes last: it is a response only if no other row has the payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn(
        "hex", F.sha1("payload"))
    first = rows.groupBy("hex").agg(F.min("page_id").alias("first_id"))
    revisit = (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "hex").select(
        "page_id", F.col("url").alias("target_uri"), "payload", F.octet_length("payload").cast("long").alias("payload_length"),
        F.unhex("hex").alias("sha1"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"))


def _urn(page_id):
    return F.concat(F.lit("urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("null")))


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    digest = F.udf(lambda b: base64.b32encode(bytes(b)).decode(), "string", useArrow=True)
    rows = roles(pages, min_bytes)
    revisit = F.col("record_type") == "revisit"
    (rows.select(_urn("page_id").alias("record_id"), "record_type", "target_uri",
                 F.when(F.col("refers_to").isNotNull(), _urn("refers_to")).alias("refers_to"),
                 digest("sha1").alias("payload_digest"), "payload_length",
                 F.when(~revisit, F.col("payload")).alias("payload"))
     .write.format("warc").mode("append").save(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Responses are
    decoded and checked against their digest; of revisits only headers are read."""
    register(spark)
    columns = ["record_id", "record_type", "refers_to", "payload_digest", "payload_length"]

    def read(schema):
        return spark.read.format("warc").schema(schema).load(path)
    heads = "record_id string, record_type string, refers_to string, payload_digest string, payload_length long"
    whole = read(heads + ", payload binary").filter("record_type = 'response'").select(*columns)
    light = read(heads).filter("record_type = 'revisit'").select(*columns)

    def page(c):
        return F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return whole.union(light).select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        "record_type", page("refers_to").alias("refers_to"))
