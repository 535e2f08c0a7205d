"""WARC archives: a writer with revisit records and a sequential reader.

Every record is a gzip member of its own. The reader takes an archive in chunks,
inflates them incrementally, frames each record by its Content-Length and checks the
block and payload digests. Tasks write whole archives into a shared folder through
Arrow's file systems; a lost task writes its archives again under other names, and
only those in the manifest, which Spark commits, are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.tables import staged, state_path

CHUNK = 1 << 16
URN = "urn:page:"
#: Digests (of 20 bytes, with an id) in a broadcast: some 30 MB in an executor.
MOST_REPEATED = 1 << 18


class DigestError(ValueError):
    """A record whose framing or digest doesn't hold."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record, not yet compressed. A revisit (``refers_to`` given) holds the HTTP
    header only; its digest and HTTP length are those of the full payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.insert(2, f"WARC-Refers-To: <{URN}{refers_to}>")
        head.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    def page_id(self, name: str = "warc-record-id") -> int | None:
        text = self.headers.get(name, f"<{URN}>")[len(URN) + 1 : -1]
        return int(text) if text else None

    @property
    def payload_bytes(self) -> int:
        return int(self.http.get("content-length", len(self.payload)))

    @property
    def digest(self) -> str:
        return self.headers["warc-payload-digest"].removeprefix("sha1:")


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode().partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    packed, unpacker, out = b"", zlib.decompressobj(31), []
    while True:
        if not packed:
            packed = stream.read(chunk)
            if not packed:
                break
        out.append(unpacker.decompress(packed))
        packed = b""
        if unpacker.eof:
            packed = unpacker.unused_data
            yield b"".join(out)
            unpacker, out = zlib.decompressobj(31), []
    if any(out):
        raise DigestError("the archive ends within a record")


def read_records(stream, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive in order, each framed by its Content-Length and checked
    against its digests."""
    for data in members(stream, chunk):
        head, gap, rest = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        headers = _fields(lines[1:])
        size = int(headers.get("content-length", -1))
        if not gap or not lines[0].startswith(b"WARC/") or rest[size:] != b"\r\n\r\n":
            raise DigestError("a record is not framed by its Content-Length")
        block = rest[:size]
        http_head, _, payload = block.partition(b"\r\n\r\n")
        record = Record(headers, _fields(http_head.split(b"\r\n")[1:]), payload)
        if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise DigestError(f"block digest of {headers.get('warc-record-id')}")
        if headers.get("warc-type") == "response" and record.digest != base32_sha1(payload):
            raise DigestError(f"payload digest of {headers.get('warc-record-id')}")
        yield record


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _as_uri(path: str) -> str:
    """``file:/a`` and ``/a`` as ``file:///a``."""
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else f"file://{path}"


def with_first_page(pages: DataFrame, id_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, ``first``) with the smallest id of the pages of equal payload,
    null for payloads that only one id has, and for those of under ``min_bytes``.

    Only digests and ids are shuffled: a row per digest that several ids share is written
    to the shared folder. If these are at most ``MOST_REPEATED`` they are broadcast and
    meet the payloads in the scan; beyond that both sides are shuffled by digest, and the
    adaptive planner splits one that many pages share. Texts of any length are hashed
    whole."""
    payload = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.unhex(F.sha1(payload.cast("binary")))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("url"), payload.alias("payload"), digest.alias("digest"))
    firsts = staged(
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .filter("last > first")
        .select("digest", "first"),
        "warc-firsts",
    )
    few = firsts.count() <= MOST_REPEATED
    return rows.join(F.broadcast(firsts) if few else firsts.hint("merge"), "digest", "left").select("id", "url", "payload", "first")


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    text_col: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = 32 << 20,
) -> DataFrame:
    """Writes a record per page and returns the manifest (``path``, ``n_records``,
    ``n_bytes``), itself written to the shared folder.

    Of pages with equal payloads of at least ``min_bytes`` those with the smallest id are
    responses and the others revisit it; rows that repeat an id and payload are written
    each. A null payload is empty, a null URL an empty target. Null ids are always
    responses. An archive is closed once it has ``archive_bytes``.
    """
    spark = pages.sparkSession
    folder = _as_uri(folder or state_path(spark, "warc"))
    schema = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("n_records", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
        ]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, count, size = None, "", 0, 0

        def row(name: str, count: int, size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"path": name, "n_records": count, "n_bytes": size}])

        try:
            for rows in batches:
                for page, url, payload, first in zip(*rows.columns, strict=True):
                    if out is None:
                        name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    page, first = page.as_py(), first.as_py()
                    refers = first if first is not None and page is not None and page != first else None
                    data = gzip_member(record_bytes(page, url.as_py(), payload.as_py().encode(), refers))
                    out.write(data)
                    count, size = count + 1, size + len(data)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield row(name, count, size)
            if out is not None:
                out.close()
                out = None
                yield row(name, count, size)
        finally:
            if out is not None:
                out.close()

    manifest = state_path(spark, "warc-manifest")
    with_first_page(pages, id_col, text_col, min_bytes).mapInArrow(write, schema).withColumn(
        "path", F.concat(F.lit(f"{folder}/"), F.col("path"))
    ).write.parquet(manifest)
    return spark.read.schema(schema).parquet(manifest)


def read_archives(manifest: DataFrame, id_col: str = "page_id", with_payload: bool = False) -> DataFrame:
    """A row per record of the archives named by ``path``: id, ``payload_bytes`` and
    ``payload_digest`` of the full payload, ``record_type``, ``refers_to`` and, if asked
    for, the ``payload`` (null for revisits). A record that fails its framing or digest
    ends the job with an error."""
    fields = [
        T.StructField(id_col, T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
    if with_payload:
        fields.append(T.StructField("payload", T.BinaryType()))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    target = pa.schema([pa.field(f.name, t) for f, t in zip(fields, types, strict=False)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path in rows.column(0).to_pylist():
                system, name = _file_system(path)
                held: list[tuple] = []
                size = 0
                with system.open_input_stream(name, compression=None) as stream:
                    for record in read_records(stream):
                        kind = record.headers["warc-type"]
                        refers = record.page_id("warc-refers-to") if kind == "revisit" else None
                        row = (record.page_id(), record.payload_bytes, record.digest, kind, refers)
                        if with_payload:
                            row += (record.payload if kind == "response" else None,)
                            size += len(record.payload)
                        held.append(row)
                        if len(held) >= 5000 or size >= 16 << 20:
                            yield _batch(held, target)
                            held, size = [], 0
                if held:
                    yield _batch(held, target)

    n = max(1, manifest.count())
    paths = manifest.select("path").repartition(n) if n > 1 else manifest.select("path")
    return paths.mapInArrow(read, T.StructType(fields))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )
