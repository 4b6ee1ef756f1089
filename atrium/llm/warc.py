"""WARC archives as a Spark data source.

``spark.read.format("warc")`` plans one partition for each archive file, takes
record type and header predicates from Spark, parses a record's headers first
and keeps a payload only if the record passed and payloads are wanted.  Archives
may be plain (.warc), compressed as a whole, or by record (.warc.gz), by any
writer and with records of any type.  The writer makes each record a gzip member
of its own whose extra field holds skip-lengths, so that an unwanted record costs
its first bytes and a seek; members without them are inflated and let go.
``write.format("warc")`` writes one archive a task under a name of its own and
lists the committed files in a manifest, so that files of lost or repeated tasks
are never read.  A cut archive raises.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string"
MANIFEST = "_manifest.json"
#: Decoded payload bytes that one batch of the reader holds.
BATCH_BYTES = 4 << 20
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("record_id", pa.string())])
_HEADERS = [f.name for f in _ARROW if f.name != "payload"]


class Folder:
    """The few file operations that archives need; a file: path is opened directly, others through Arrow's file systems."""

    def __init__(self, path: str):
        self.fs = None
        if path.startswith("file:") or "://" not in path:
            self.base = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        else:
            from pyarrow.fs import FileSystem

            self.fs, self.base = FileSystem.from_uri(path)

    def open(self, name: str, mode: str):
        if self.fs is None:
            if mode == "wb":
                os.makedirs(self.base, exist_ok=True)
            return open(f"{self.base}/{name}", mode)
        if mode == "rb":
            return self.fs.open_input_file(f"{self.base}/{name}")
        self.fs.create_dir(self.base, recursive=True)
        return self.fs.open_output_stream(f"{self.base}/{name}", compression=None)

    def names(self) -> list[str]:
        if self.fs is None:
            return sorted(os.listdir(self.base))
        from pyarrow.fs import FileSelector

        return sorted(x.base_name for x in self.fs.get_file_info(FileSelector(self.base)))

    def delete(self, name: str) -> None:
        if self.fs is None:
            os.remove(f"{self.base}/{name}")
        else:
            self.fs.delete_file(f"{self.base}/{name}")


def _page_urn(page_id) -> str:
    return f"<urn:page:{page_id}>"


def _clean(value: str) -> str:
    """Header values can't hold control characters; those and % are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 or c == "%" else c for c in value)


def _unclean(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value)


def record(page_id, url, record_type: str, refers_to, payload: bytes, size: int, digest: str, date: str) -> bytes:
    """The bytes of a record; a revisit has no payload of its own but states its size and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if record_type == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_page_urn(page_id)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        *([f"WARC-Refers-To: {_page_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if record_type == "revisit" else []),
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field holds the lengths of the member and of its data, if both fit 32 bits."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total, extra = 24 + len(body) + 8, b""
    if max(total, len(data)) < 1 << 32:
        extra = b"sl" + struct.pack("<HII", 8, total, len(data))
    head = b"\x1f\x8b\x08" + (b"\x04" if extra else b"\0") + b"\0" * 4 + b"\0\xff" + (struct.pack("<H", len(extra)) if extra else b"")
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _page_of(urn: str | None):
    """The page of one of this writer's own record ids; other archives' ids are of no page."""
    value = urn[len("<urn:page:") : -1] if urn and urn.startswith("<urn:page:") else ""
    return int(value) if value.lstrip("-").isdigit() else None


def parse_fields(head: bytes) -> dict[str, str]:
    """Header fields by lowered name; of repeated fields the first counts."""
    fields: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


class _Plain:
    """Bytes of an archive that isn't compressed."""

    def __init__(self, file, size: int):
        self.file, self.left = file, size

    def read(self, n: int) -> bytes:
        data = self.file.read(n)
        self.left -= len(data)
        return data

    def skip(self, n: int) -> None:
        if n > self.left:
            raise ValueError("an archive is cut inside a record")
        self.file.seek(n, 1)
        self.left -= n


class _Inflated:
    """Bytes of an archive's gzip members from the file's position on, one after the other."""

    def __init__(self, file):
        self.file, self.packed, self.inflate, self.step = file, b"", None, 1024

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if not self.packed:
                self.packed = self.file.read(self.step)
                self.step = min(2 * self.step, 1 << 16)
                if not self.packed:
                    if self.inflate is not None and not self.inflate.eof:
                        raise ValueError("an archive is cut inside a record")
                    return out
            if self.inflate is None or self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            out += self.inflate.decompress(self.packed, n - len(out))
            self.packed = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            got = len(self.read(min(n, 1 << 16)))
            if not got:
                raise ValueError("an archive is cut inside a record")
            n -= got


class _Source:
    """Reads ahead of a plain or inflated stream to find where a head ends."""

    def __init__(self, stream):
        self.stream, self.ahead = stream, b""

    def head(self, most: int) -> bytes | None:
        """The bytes before an empty line, which is passed over; None at the end of the archive."""
        self.ahead = self.ahead.lstrip(b"\r\n")
        while (at := self.ahead.find(b"\r\n\r\n")) < 0:
            if len(self.ahead) > most:
                raise ValueError("a head doesn't end")
            more = self.stream.read(1024)
            if not more:
                if self.ahead.strip():
                    raise ValueError("an archive is cut inside a head")
                return None
            self.ahead = (self.ahead + more).lstrip(b"\r\n") if not self.ahead else self.ahead + more
        out, self.ahead = self.ahead[:at], self.ahead[at + 4 :]
        return out

    def read(self, n: int) -> bytes:
        out, self.ahead = self.ahead[:n], self.ahead[n:]
        parts = [out]
        n -= len(out)
        while n > 0:
            parts.append(self.stream.read(min(n, 1 << 16)))
            if not parts[-1]:
                raise ValueError("an archive is cut inside a record")
            n -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        own = min(n, len(self.ahead))
        self.ahead = self.ahead[own:]
        if n > own:
            self.stream.skip(n - own)


def _passes(head: dict, filters: list) -> bool:
    for f in filters:
        value = head[f.attribute[0]]
        if isinstance(f, IsNull):
            ok = value is None
        elif isinstance(f, IsNotNull):
            ok = value is not None
        elif isinstance(f, EqualNullSafe):
            ok = value == f.value
        elif value is None:
            ok = False
        elif isinstance(f, EqualTo):
            ok = value == f.value
        elif isinstance(f, In):
            ok = value in f.value
        elif isinstance(f, GreaterThan):
            ok = value > f.value
        elif isinstance(f, GreaterThanOrEqual):
            ok = value >= f.value
        elif isinstance(f, LessThan):
            ok = value < f.value
        else:
            ok = value <= f.value
        if not ok:
            return False
    return True


#: Bytes of a record's or a message's head, at most.
HEAD = 1 << 20


def _read_one(source: _Source, filters: list, payloads: bool) -> tuple[bool, dict | None]:
    """(whether there was a record, the record if it passes)."""
    raw = source.head(HEAD)
    if raw is None:
        return False, None
    if not raw.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = parse_fields(raw)
    kind, left = fields.get("warc-type", ""), int(fields["content-length"])
    url = fields.get("warc-target-uri")
    out = {
        "page_id": _page_of(fields.get("warc-record-id")), "url": None if url is None else _unclean(url.removeprefix("<").removesuffix(">")), "record_type": kind,
        "refers_to": _page_of(fields.get("warc-refers-to")), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload": None, "record_id": fields.get("warc-record-id"),
    }
    size = left
    if fields.get("content-type", "").startswith("application/http"):
        block = source.read(min(left, 4096))
        left -= len(block)
        while b"\r\n\r\n" not in block and left and len(block) < HEAD:
            more = source.read(min(left, 4096))
            left -= len(more)
            block += more
        http, _, body = block.partition(b"\r\n\r\n")
        source.ahead, left = body + source.ahead, left + len(body)
        stated = parse_fields(http).get("content-length", "")
        size = int(stated) if kind == "revisit" and stated.isdigit() else left
    out["payload_bytes"] = size
    passes = _passes(out, filters)
    if passes and payloads and kind != "revisit":
        out["payload"] = source.read(left)
    else:
        source.skip(left)
    return True, out if passes else None


def read_records(file, filters: list, payloads: bool) -> Iterator[dict]:
    """The records of an archive that pass, headers first; file: open for reading bytes, at its start."""
    size = file.seek(0, 2)
    file.seek(0)
    first = file.read(2)
    file.seek(0)
    at = 0
    while first == b"\x1f\x8b" and at < size:
        start = file.read(24)
        if len(start) == 24 and start[3] == 4 and start[10:16] == b"\x0c\0sl\x08\0":
            total = struct.unpack("<I", start[16:20])[0]
            if at + total > size:
                raise ValueError("an archive is cut inside a record")
            file.seek(at)
            _, out = _read_one(_Source(_Inflated(file)), filters, payloads)
            if out is not None:
                yield out
            at += total
            file.seek(at)
            continue
        break
    if at >= size:
        return
    file.seek(at)
    source = _Source(_Inflated(file) if first == b"\x1f\x8b" else _Plain(file, size))
    there = True
    while there:
        there, out = _read_one(source, filters, payloads)
        if out is not None:
            yield out


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads, self.filters = path, payloads, []

    def pushFilters(self, filters):  # noqa: N802
        kinds = (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNull, IsNotNull)
        for f in filters:
            if isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        folder = Folder(self.path)
        names = folder.names()
        if MANIFEST in names:
            with folder.open(MANIFEST, "rb") as f:
                names = json.loads(f.read())
        return [InputPartition(n) for n in names if n.endswith((".warc.gz", ".warc"))]

    def read(self, partition):
        with Folder(self.path).open(partition.value, "rb") as f:
            rows, held = [], 0
            for head in read_records(f, self.filters, self.payloads):
                rows.append(head)
                held += 500 + len(head["payload"] or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, iterator):
        name = f"{uuid.uuid4().hex}.warc.gz"
        with Folder(self.path).open(name, "wb") as out:
            for batch in iterator:
                for x in batch.to_pylist():
                    out.write(member(record(x["page_id"], x["url"], x["record_type"], x["refers_to"], x["payload"] or b"", x["payload_bytes"], x["payload_digest"], self.date)))
        return _Written(name)

    def commit(self, messages):
        with Folder(self.path).open(MANIFEST, "wb") as f:
            f.write(json.dumps(sorted(m.name for m in messages if m)).encode())

    def abort(self, messages):
        folder = Folder(self.path)
        there = folder.names()
        for m in messages:
            if m and m.name in there:
                folder.delete(m.name)


class WarcDataSource(DataSource):
    """Options: path; payload (true or false: whether payloads are decoded); date (WARC-Date of written records)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], str(self.options.get("payload", "true")).lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The rows of the warc format for pages: of equal payloads of at least ``least`` bytes, the largest page_id responds.

    A null html is an empty payload.  Rows repeated with the same page_id and
    html are all responses if that id is the largest; a null page_id never is,
    unless all ids of its payload are null.  The payloads themselves are dealt
    by page_id, so a payload with very many copies meets in no task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    ids = hashed.where(F.col("payload_bytes") >= least).select("page_id", "payload_bytes", "payload_digest")
    groups = ids.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    marks = ids.join(groups, ["payload_digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("m_id"), F.col("payload_digest").alias("m_digest"), "refers_to").distinct()
    both = hashed.join(marks, F.col("page_id").eqNullSafe(F.col("m_id")) & (F.col("payload_digest") == F.col("m_digest")), "left")
    kind = F.when(F.col("refers_to").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))
    body = F.when(F.col("refers_to").isNull(), F.col("payload"))
    return both.select("page_id", "url", kind.alias("record_type"), "refers_to", "payload_bytes", "payload_digest", body.alias("payload"))


def write_warc(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def read_warc(spark, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


#: DuckDB's form of the query.
WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
