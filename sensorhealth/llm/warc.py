"""WARC archives as a PySpark data source (format ``warc``).

*Write*: Arrow batches become records, one gzip member each, in files that roll at a size. The
member's extra field ``sl`` holds its compressed and plain length, as the format's annex allows, so
a reader can step over it. Files count only when the driver has listed them in a manifest, so a
task that is repeated or lost leaves nothing behind that is read. Every write adds a manifest of its own,
and a reader takes the files of all of them; an overwriting one names the manifests that it replaces.

*Read*: the plan lists the files (``.warc.gz`` and uncompressed ``.warc`` where there is no manifest) and deals them out to partitions by size. Record-type and header
predicates are pushed down; a record's header is decoded first, and the payload of a record that
the predicates or ``payload=false`` don't want is stepped over without being decoded.

Payloads that are equal (same SHA-1) and at least ``least_bytes`` long are stored once:
``plan_records`` makes the row with the largest id the response and the others revisits of it.

Defined results: null html is an empty payload; null ids are stored without number and come back
null; rows that repeat the largest id of a group are all responses; a null or odd url is stored
percent-encoded and comes back as it was (null as null); an empty table gives an archive without
files, which reads as no rows, as do empty files; a SHA-1 digest may be written in base 32 or hexadecimal,
any other reads as null; other columns are ignored. One record must fit a task's memory, and one file is
read by one task, so large archives should come in several files, as the writer rolls them.
"""

from __future__ import annotations

import base64
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

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
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

#: Columns of a record; those but payload and payload_bytes come from the header.
SCHEMA = (
    "warc_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)
HEADERS = ("warc_type", "record_id", "target_uri", "refers_to", "payload_digest")
MANIFEST = "_manifest"
_SAFE = ":/?&=+,;@!$'()*~[]{}|^<>\"\\`"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _member(record: bytes, level: int) -> bytes:
    """One gzip member with its lengths in the extra field ``sl``, where they fit its 32 bits."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    if max(total, len(record)) > 0xFFFFFFFF:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, total, len(record))
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + tail


def _record(row: dict) -> bytes:
    payload = row["payload"] or b""
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    body = block.encode() + (payload if row["warc_type"] == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['warc_type']}"]
    if row["record_id"] is not None:
        lines.append(f"WARC-Record-ID: <{row['record_id']}>")
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['target_uri'], safe=_SAFE)}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines += [
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http;msgtype={'response' if row['warc_type'] == 'response' else 'revisit'}",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def _manifests(fs: pafs.FileSystem, root: str) -> dict[str, dict]:
    """Manifests of a folder that no other replaces, by name."""
    told = {}
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith(MANIFEST) and f.base_name.endswith(".json"):
            with fs.open_input_stream(f.path) as stream:
                told[f.base_name] = json.loads(stream.read())
    gone = {name for m in told.values() for name in m["replaces"]}
    return {name: m for name, m in sorted(told.items()) if name not in gone}


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.overwrite = overwrite
        self.path = options["path"].rstrip("/")
        self.level = int(options.get("level", 1))
        self.roll = int(options.get("rollbytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        partition, files, out = TaskContext.get().partitionId(), [], None
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, 64):
                    for row in batch.slice(at, 64).to_pylist():
                        if out is not None and files[-1][1] >= self.roll:
                            out.close()
                            out = None
                        if out is None:
                            files.append([f"part-{partition:05d}-{uuid.uuid4().hex}.warc.gz", 0])
                            out = fs.open_output_stream(posixpath.join(root, files[-1][0]), compression=None)
                        data = _member(_record(row), self.level)
                        out.write(data)
                        files[-1][1] += len(data)
        finally:
            if out is not None:
                out.close()
        return Written([tuple(f) for f in files])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        earlier = _manifests(fs, root) if self.overwrite else {}
        told = {"files": sorted(f for m in messages if m is not None for f in m.files), "replaces": sorted(earlier)}
        name = f"{MANIFEST}-{uuid.uuid4().hex}"
        with fs.open_output_stream(posixpath.join(root, name)) as out:
            out.write(json.dumps(told).encode())
        fs.move(posixpath.join(root, name), posixpath.join(root, f"{name}.json"))  # whole or not at all
        for old in (f for m in earlier.values() for f, _ in m["files"]):
            if fs.get_file_info(path := posixpath.join(root, old)).type == pafs.FileType.File:
                fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.path)
        for name, _ in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(posixpath.join(root, name))


class Share(InputPartition):
    """The files of one partition."""

    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


def _hex_digest(value: str) -> str | None:
    """Bare hexadecimal SHA-1 of a digest field in either of its usual spellings, else null."""
    kind, _, text = value.partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        raw = bytes.fromhex(text) if len(text) == 40 else base64.b32decode(text.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def _header(lines: list[str]) -> dict:
    """Columns that come from a record's header, and its block length under ``length``."""
    fields = {}
    for line in lines:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    bare = lambda name: fields[name][1:-1] if name in fields else None
    uri = fields.get("warc-target-uri")
    return {
        "warc_type": fields.get("warc-type"),
        "record_id": bare("warc-record-id"),
        "target_uri": None if uri is None else unquote(uri),
        "refers_to": bare("warc-refers-to"),
        "payload_digest": _hex_digest(fields.get("warc-payload-digest", "")),
        "length": int(fields.get("content-length", 0)),
    }


def _told(row: dict, block: bytes, payload: bool) -> dict:
    """A kept record's columns from its header and block."""
    told, _, body = block[: row.pop("length")].partition(b"\r\n\r\n")
    sizes = [x for x in told.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    row["payload_bytes"] = int(sizes[0].split(b":")[1]) if sizes else len(body)
    row["payload"] = body if payload and row["warc_type"] == "response" else None
    return row


def _plain_records(source, wanted, payload: bool) -> Iterator[dict]:
    """Records of an uncompressed archive."""
    at, size = 0, source.size()
    while at < size:
        source.seek(at)
        head = b""
        while b"\r\n\r\n" not in head:
            got = source.read(4096)
            if not got:
                if head.strip():
                    raise ValueError("the archive ends inside a record")
                return
            head += got
        head = head.partition(b"\r\n\r\n")[0]
        start = at + len(head) + 4
        row = _header(head.decode("utf-8", "replace").split("\r\n")[1:])
        at = start + row["length"] + 4
        if wanted(row):
            source.seek(start)
            http = payload or row["warc_type"] != "response"
            yield _told(row, source.read(row["length"] if http else min(row["length"], 65536)), payload)


def records(source, wanted, payload: bool) -> Iterator[dict]:
    """Records of an open archive whose header ``wanted`` accepts; others are stepped over."""
    at, size = 0, source.size()
    if source.read(5) == b"WARC/":
        yield from _plain_records(source, wanted, payload)
        return
    while at < size:
        source.seek(at)
        raw = source.read(16384)
        if raw[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        end = None
        if raw[3] & 4 and raw[12:14] == b"sl":
            end = at + struct.unpack_from("<I", raw, 16)[0]
        unpack = zlib.decompressobj(31)
        plain = unpack.decompress(raw, 4096)

        def more(most: int, unpack=unpack) -> bytes:
            rest = unpack.unconsumed_tail or source.read(262144)
            if not rest:
                raise ValueError("the archive ends inside a record")
            return unpack.decompress(rest, most)

        while b"\r\n\r\n" not in plain and not unpack.eof:
            plain += more(4096)
        head, _, block = plain.partition(b"\r\n\r\n")
        row = _header(head.decode("utf-8", "replace").split("\r\n")[1:])
        keep = wanted(row)
        http = keep and (payload or row["warc_type"] != "response")
        if http or end is None:
            pieces = [block]
            while not unpack.eof:
                got = more(1 << 20)
                if http:
                    pieces.append(got)
            block = b"".join(pieces)
            end = end or source.tell() - len(unpack.unused_data)
        elif keep:
            while b"\r\n\r\n" not in block and not unpack.eof:
                block += more(4096)
        if keep:
            yield _told(row, block, payload)
        at = end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.share = int(options.get("partitionbytes", 32 << 20))
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((column, "in", frozenset([f.value])))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", frozenset(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            own = row[column]
            if own is None or not (own in value if kind == "in" else own.startswith(value)):
                return False
        return True

    def partitions(self) -> list[Share]:
        fs, root = _filesystem(self.path)
        if told := _manifests(fs, root):
            listed = [(n, s) for m in told.values() for n, s in m["files"]]
        else:
            found = fs.get_file_info(pafs.FileSelector(root))
            listed = [(f.base_name, f.size) for f in found if f.base_name.endswith((".warc.gz", ".warc"))]
        shares, size = [], self.share
        for name, own in sorted(listed, key=lambda x: (-x[1], x[0])):
            if not shares or size + own > self.share:
                shares.append(Share([]))
                size = 0
            shares[-1].names.append(name)
            size += own
        return shares or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(self.path)
        kind = pa.schema(
            [(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string())
             for n in (*HEADERS, "payload_bytes", "payload")]
        )
        rows, size = [], 0
        for name in partition.names:
            with fs.open_input_file(posixpath.join(root, name)) as source:
                for row in records(source, self.wanted, self.payload):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Rows to archive, from (page_id, url, html): payload, digest, type and reference.

    Only digests that occur twice or more are joined back, so what is joined is small next to the
    pages, and the join's hot digest can be split, as its other side has one row per digest.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").alias("target_uri"),
        F.sha1(payload).alias("payload_digest"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        payload.alias("payload"),
    )
    groups = (
        rows.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1 and _first is not null")
    )
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return rows.join(groups, rows["payload_digest"] == groups["_digest"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        urn(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.when(revisit, urn(F.col("_first"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, least_bytes: int = 1000, mode: str = "append") -> None:
    """Write the pages as records, beside those that the path has (``append``) or in their place."""
    register(pages.sparkSession)
    plan_records(pages, least_bytes).write.format("warc").mode(mode).save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id(column: str):
    return F.regexp_extract(column, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Per record, from the archive: responses by their payload, revisits by their header alone."""
    responses = read(spark, path).filter("warc_type = 'response'")
    revisits = read(spark, path, payload=False).filter("warc_type = 'revisit'")
    columns = lambda size, digest: [
        page_id("record_id").alias("page_id"),
        size.cast("bigint").alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page_id("refers_to").alias("refers_to"),
    ]
    return responses.select(
        *columns(F.octet_length("payload"), F.sha1("payload"))
    ).unionAll(revisits.select(*columns(F.col("payload_bytes"), F.col("payload_digest"))))
