"""WARC archives as a PySpark Python data source.

Writing: each task writes gzip-per-record archives (rolled by size) under names of its own; ``commit`` publishes a
manifest of the files of the tasks that won, so that lost or repeated attempts leave nothing a reader sees. Every
gzip member carries its own length in an extra field, which other readers ignore.

Reading: the manifest (or a folder listing, for archives from elsewhere) is planned into partitions of about
``partition_bytes``; files without a wanted record type are left out. Predicates on record type and headers
(record_type, target_uri, record_id, payload_digest, refers_to) are pushed down. A record's headers are parsed first:
only as many bytes are inflated as hold them, and where the record isn't wanted, or no payload column is asked for,
the reader goes on to the next member without decoding the payload. Members from elsewhere can hold many records. An
archive that is cut off, or has a record that can't be read, is an error.

Defined results: a null payload is the empty payload; a null target_uri, digest or date leaves its header out; line
ends in header values are percent-encoded; records come in file order; an empty table makes an archive without files. A
payload is held in memory whole, once for a record. Pages: of rows without a page_id the first payload's holder is still
that of the least page_id, so such a row with a payload seen elsewhere revisits it, and one of its own is a response.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import apart, new_folder, pick

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
MANIFEST = "_manifest.json"
CHUNK = 4096


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# -- records ----------------------------------------------------------------------------------------------------


def _safe(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """A whole record, not compressed. Responses hold an HTTP answer; revisits only its headers."""
    payload = row.get("payload") or b""
    kind = row["record_type"]
    length = row.get("payload_bytes")
    length = len(payload) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        if row.get(column) is not None:
            value = _safe(row[column])
            value = f"sha256:{value}" if column == "payload_digest" else f"<{value}>" if column in ("record_id", "refers_to") else value
            lines.append(f"{header}: {value}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field (NW) holds the member's length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, b"NW", 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Wrote(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.roll = options["path"], int(options.get("roll_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        from pyspark import TaskContext

        where, folder = filesystem(self.path)
        where.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{uuid.uuid4().hex[:12]}"
        done, out, at, counts = [], None, 0, {}
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    file = f"{name}-{len(done):03d}.warc.gz"
                    out, at, counts = where.open_output_stream(posixpath.join(folder, file), compression=None), 0, {}
                data = member(record(row))
                out.write(data)
                at += len(data)
                counts[row["record_type"]] = counts.get(row["record_type"], 0) + 1
                if at >= self.roll:
                    out.close()
                    done.append({"file": file, "bytes": at, "types": counts})
                    out = None
        if out is not None:
            out.close()
            done.append({"file": file, "bytes": at, "types": counts})
        return Wrote(done)

    def commit(self, messages: list) -> None:
        where, folder = filesystem(self.path)
        where.create_dir(folder, recursive=True)
        target = posixpath.join(folder, MANIFEST)
        old = json.loads(where.open_input_stream(target).read()) if where.get_file_info(target).type == pafs.FileType.File else []
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["file"])
        with where.open_output_stream(target + ".new", compression=None) as out:
            out.write(json.dumps(old + files).encode())
        where.move(target + ".new", target)

    def abort(self, messages: list) -> None:
        where, folder = filesystem(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                if where.get_file_info(p := posixpath.join(folder, f["file"])).type == pafs.FileType.File:
                    where.delete_file(p)


# -- reading ----------------------------------------------------------------------------------------------------


class Inflating:
    """Bytes of one gzip member, inflated no further than asked for."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.z, self.out = file, zlib.decompressobj(31), bytearray()
        file.seek(at)
        self.read = 0

    def more(self, wanted: int = CHUNK) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.file.read(CHUNK)
        if not data:
            return False
        if data is not self.z.unconsumed_tail:
            self.read += len(data)
        self.out += self.z.decompress(data, max(wanted, CHUNK))
        return True

    def upto(self, size: int) -> bytes:
        while len(self.out) < size and self.more(size - len(self.out)):
            pass
        return bytes(self.out[:size])

    def skip(self, size: int) -> bool:
        """Drop so many bytes; false where there aren't as many."""
        while True:
            n = min(size, len(self.out))
            del self.out[:n]
            size -= n
            if not size or not self.more():
                return not size

    def end(self) -> int:
        """Compressed length of the member; inflates the rest (for archives without the length field)."""
        while not self.z.eof and self.more():
            self.out.clear()
        if not self.z.eof:
            raise ValueError("WARC archive: a gzip member is cut off")
        return self.read - len(self.z.unused_data)


class Plain:
    """The same view of an archive that isn't compressed."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.out = file, bytearray()
        file.seek(at)

    def more(self, wanted: int = CHUNK) -> bool:
        data = self.file.read(max(wanted, CHUNK))
        self.out += data
        return bool(data)

    upto = Inflating.upto


def line_ends(view: Inflating | Plain) -> int:
    """Drop the line ends before a record; how many bytes they were."""
    n = 0
    while view.out or view.more():
        if view.out[:1] not in (b"\r", b"\n"):
            break
        del view.out[:1]
        n += 1
    return n


def parse_headers(view: Inflating | Plain) -> tuple[dict[str, str], int]:
    """Header fields (names in lower case) and where the block starts."""
    while (end := view.out.find(b"\r\n\r\n")) < 0:
        if not view.more():
            raise ValueError("WARC archive: a record's headers have no end")
    if not view.out.startswith(b"WARC/"):
        raise ValueError("WARC archive: no record where one should begin")
    lines = bytes(view.out[:end]).decode("utf-8", "surrogatepass").split("\r\n")
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in " \t" and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            last = k.strip().lower()
            fields[last] = v.strip()
    return fields, end + 4


def columns(fields: dict[str, str]) -> dict:
    out = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c].strip("<>") if out[c] else None
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].rpartition(":")[2]
    return out


def records(file: pa.NativeFile, size: int, wanted, payloads: bool) -> Iterator[dict]:
    """Records of one archive that pass ``wanted``; payloads are decoded only where asked for."""
    at = 0
    while at < size:
        file.seek(at)
        head = file.read(20)
        zipped = head[:2] == b"\x1f\x8b"
        length = struct.unpack_from("<I", head, 16)[0] if zipped and len(head) == 20 and head[3] & 4 and head[12:14] == b"NW" else None
        if length and at + length > size:
            raise ValueError("WARC archive: a gzip member is cut off")
        view = Inflating(file, at) if zipped else Plain(file, at)
        while True:
            before = line_ends(view)
            at += 0 if zipped else before
            if not view.out:
                break
            fields, start = parse_headers(view)
            row = columns(fields)
            if "content-length" not in fields:
                raise ValueError("WARC archive: a record without Content-Length")
            block = int(fields["content-length"])
            if wanted(row):
                row["payload"], row["payload_bytes"] = None, None
                http = view.upto(start + min(block, 2048))[start:]
                stop = http.find(b"\r\n\r\n")
                if http.startswith(b"HTTP/") and stop >= 0:
                    for line in http[:stop].split(b"\r\n"):
                        if line.lower().startswith(b"content-length:"):
                            row["payload_bytes"] = int(line.split(b":")[1])
                    body = start + stop + 4
                else:
                    body = start
                    row["payload_bytes"] = block
                if payloads and row["record_type"] != "revisit":
                    whole = view.upto(start + block)
                    if len(whole) < start + block:
                        raise ValueError("WARC archive: a record is cut off")
                    row["payload"] = whole[body:]
                    row["payload_bytes"] = len(row["payload"])
                yield row
            if length or not zipped:  # our own members hold one record each
                break
            if not view.skip(start + block):
                raise ValueError("WARC archive: a record is cut off")
        if zipped:
            at += length or view.end()
        elif view.out:
            at += start + block
            if at > size:
                raise ValueError("WARC archive: a record is cut off")
        else:
            break


@dataclass
class Archives(InputPartition):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.names = options["path"], [f.name for f in schema.fields]
        self.bytes = int(options.get("partition_bytes", 32 << 20))
        self.equal: dict[str, set] = {}
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[column] = self.equal.get(column, values) & values
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.prefix.append((column, f.value))
            else:
                yield f

    def partitions(self) -> list[Archives]:
        where, folder = filesystem(self.path)
        listed = posixpath.join(folder, MANIFEST)
        if where.get_file_info(listed).type == pafs.FileType.File:
            files = json.loads(where.open_input_stream(listed).read())
        else:
            found = where.get_file_info(pafs.FileSelector(folder, recursive=True))
            files = [{"file": f.path[len(folder) :].lstrip("/"), "bytes": f.size} for f in found if f.path.endswith((".warc", ".warc.gz"))]
        types = self.equal.get("record_type")
        if types is not None:
            files = [f for f in files if "types" not in f or types & set(f["types"])]
        out, load = [], self.bytes
        for f in sorted(files, key=lambda f: f["file"]):
            if load + f["bytes"] > self.bytes:
                out.append(Archives([]))
                load = 0
            out[-1].files.append((f["file"], f["bytes"]))
            load += f["bytes"]
        return out or [Archives([])]

    def wanted(self, row: dict) -> bool:
        return all(row[c] in v for c, v in self.equal.items()) and all((row[c] or "").startswith(p) for c, p in self.prefix)

    def read(self, partition: Archives) -> Iterator[tuple]:
        where, folder = filesystem(self.path)
        for file, size in partition.files:
            with where.open_input_file(posixpath.join(folder, file)) as f:
                for row in records(f, size, self.wanted, "payload" in self.names):
                    yield tuple(row[n] for n in self.names)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; leave ``payload`` out of the schema to skip payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -- pages ------------------------------------------------------------------------------------------------------

URN = "urn:page:"
LEAST = 100  # bytes of a payload that can be revisited


def archived(pages: DataFrame) -> DataFrame:
    """Records of ``pages`` (page_id, url, html) in the source's schema. Of equal payloads of at least 100 bytes that
    with the least page_id is the response and the others revisit it; rows that share the least page_id are responses."""
    rows = pick(pages, page_id="long", url="string", html="string").withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).drop("html")
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    first = rows.filter(F.col("payload_bytes") >= LEAST).groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("first"))
    rows = rows.join(first.select(apart("d"), "first"), F.col("payload_digest") == F.col("d"), "left")  # pages of one payload can be dealt out
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit(URN), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        "payload_digest",
        F.when(again, F.concat(F.lit(URN), F.col("first").cast("string"))).alias("refers_to"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind, payload, digest in zip(*(batch.column(c).to_pylist() for c in ("record_type", "payload", "payload_digest")), strict=True):
            if kind == "response" and hashlib.sha256(payload or b"").hexdigest() != digest:
                raise ValueError("a payload doesn't match its digest")
        yield batch.drop_columns(["payload"])


def write_and_read(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive ``pages``, read the archives back and hold every payload against its digest."""
    spark = pages.sparkSession
    register(spark)
    path = path or new_folder(spark, "warc")
    archived(pages).write.format("warc").mode("append").save(path)
    rows = spark.read.format("warc").load(path)
    kept = [f for f in rows.schema.fields if f.name != "payload"]
    # revisits are read by their headers alone: the type is pushed down, and without a payload column none is decoded
    bare = spark.read.format("warc").schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)).load(path).filter("record_type = 'revisit'")
    checked = rows.filter("record_type = 'response'").mapInArrow(_digests, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept))
    number = lambda c: F.when(F.col(c) == f"{URN}none", None).otherwise(F.substring(F.col(c), len(URN) + 1, 30)).cast("long")
    return checked.unionByName(bare).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
