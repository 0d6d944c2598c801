"""WARC archives as a PySpark data source (operator 8), written and read.

Format "warc", option path. A record is a gzip member of its own whose extra field tells the member's length. The reader plans byte ranges of files as
partitions, looks for the first record in its range, inflates no more than the headers of a record, and goes on to the next record (by the extra field,
or by inflating into nothing in archives of other writers) unless the record passes the pushed predicates and its payload is wanted (option payload).
Bytes that only look like a member are passed over; a record whose body is damaged keeps what its headers say and has no payload. Files that end in .warc
hold plain records and are one partition each.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, WriterCommitMessage
from pyspark.sql.types import StructType

from . import common

WRITE_SCHEMA = "page_id long, url string, payload binary, refers_to long"
READ_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, headers map<string,string>, payload binary, damaged boolean"
HTTP, REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, SPLIT, STEP, HEAD_STEP, ROWS, BATCH_BYTES = b"\x1f\x8b\x08", 64 << 20, 1 << 16, 1 << 12, 2000, 16 << 20
MAX_DIGESTS = 500_000


def digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(raw: bytes) -> bytes:
    """A gzip member whose extra field MW holds the member's whole length."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(raw) + c.flush()
    size = 10 + 2 + 4 + 8 + len(body) + 8
    head = MAGIC + b"\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"MW", 8, size)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit of the response with page_id refers_to."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + (payload if refers_to is None else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Payload-Digest", "sha1:" + digest(payload)), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Part(WriterCommitMessage, InputPartition):
    file: str
    start: int = 0
    end: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, where = common.arrow_fs(self.path)
        fs.create_dir(where, recursive=True)
        name = f"{where}/part-{uuid.uuid4().hex}.warc.gz"
        with fs.open_output_stream(f"{name}.writing") as out:
            for b in iterator:
                for page_id, url, raw, ref in zip(*(b.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                    out.write(member(record(page_id.as_py(), url.as_py(), raw.as_py() or b"", ref.as_py(), self.date)))
        return Part(name)

    def commit(self, messages: list) -> None:  # a file gets its name only when its task has won
        fs, where = common.arrow_fs(self.path)
        fs.create_dir(where, recursive=True)
        for m in messages:
            if m is not None:
                fs.move(f"{m.file}.writing", m.file)

    def abort(self, messages: list) -> None:
        fs, _ = common.arrow_fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{m.file}.writing")


class _Stream:
    """Access from an offset, with skips; holds a step or what was asked for."""

    def __init__(self, f, at: int, size: int):
        self.f, self.at, self.size, self.buffer = f, at, size, b""

    def fill(self, n: int) -> bool:
        """At least n bytes in the buffer, unless the file ends."""
        if len(self.buffer) < n:
            parts, have = [self.buffer], len(self.buffer)
            while have < n:
                self.f.seek(self.at + have)
                got = self.f.read(max(STEP, n - have))
                if not got:
                    break
                parts.append(got)
                have += len(got)
            self.buffer = b"".join(parts)
        return len(self.buffer) >= n

    def move(self, at: int) -> None:
        self.buffer = self.buffer[at - self.at :] if at >= self.at else b""
        self.at = at


class _Member:
    """One gzip member, inflated as far as asked for."""

    def __init__(self, s: _Stream):
        s.fill(24)
        b, self.s, self.start = s.buffer, s, s.at
        self.length = struct.unpack_from("<Q", b, 16)[0] if _tells_length(b) else None
        self.z, self.out = zlib.decompressobj(31), bytearray()

    def more(self, most: int = STEP) -> bool:
        if self.z.eof or not self.s.fill(1):
            return False
        piece = self.s.buffer[:STEP]
        self.out += self.z.decompress(piece, most)
        rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        self.s.move(self.s.at + len(piece) - len(rest))
        return True

    def until(self, n: int) -> bytes:
        while len(self.out) < n and self.more(max(STEP, n - len(self.out))):
            pass
        return bytes(self.out[:n])

    def end(self) -> None:
        """Moves the stream behind the member."""
        if self.length is None:
            while self.more():
                self.out.clear()
        else:
            self.s.move(self.start + self.length)


class _Plain:
    """One record of an archive without compression."""

    def __init__(self, s: _Stream):
        self.s, self.start, self.length = s, s.at, 1

    @property
    def out(self) -> bytes:
        return self.s.buffer

    def more(self, most: int = STEP) -> bool:
        return self.s.fill(len(self.s.buffer) + 1)

    def until(self, n: int) -> bytes:
        self.s.fill(n)
        return self.s.buffer[:n]

    def end(self) -> None:
        self.s.move(self.start + self.length)


def _tells_length(b: bytes) -> bool:
    """Whether a gzip member begins with the extra field MW."""
    return len(b) >= 24 and bool(b[3] & 4) and b[12:16] == b"MW\x08\0"


def _starts_member(b: bytes, at: int, size: int) -> bool:
    """Whether these bytes, at this place of a file of this size, can begin a gzip member: no reserved flag is set, and a told length is possible. One beyond the end of the file is that of a cut record, if headers follow."""
    return len(b) >= 18 and b[:3] == MAGIC and b[3] < 32 and (not _tells_length(b) or struct.unpack_from("<Q", b, 16)[0] >= 24)


def _head(m) -> tuple[dict[str, str], int, int] | None:
    """The fields of a record, where its block starts and the size of the block; None if it isn't a record."""
    seen = 0
    while (at := m.out.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
        seen = len(m.out)
        if (seen >= 5 and m.out[:5] != b"WARC/") or not m.more(HEAD_STEP):
            return None
    raw = bytes(m.out[:at])
    try:
        lines = raw.decode("utf-8", "surrogatepass").split("\r\n")
    except UnicodeDecodeError:
        lines = raw.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("Content-Length", "0")
    return (fields, at + 4, int(size)) if lines[0].startswith("WARC/") and size.isascii() and size.isdigit() else None


def _page(urn: str | None) -> int | None:
    x = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x.lstrip("-").isdigit() else None


def _columns(h: dict[str, str]) -> dict:
    """The columns that headers alone give."""
    url, size = h.get("WARC-Target-URI"), h.get("X-Payload-Length", "")
    return {
        "page_id": _page(h.get("WARC-Record-ID")), "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "record_type": h.get("WARC-Type"),
        "payload_digest": h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, "payload_bytes": int(size) if size.isdigit() else None, "refers_to": _page(h.get("WARC-Refers-To")), "headers": h,
    }


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split: int):
        self.path, self.payload, self.split = path, payload, split
        self.tests: list[tuple[str, str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over (in)equality, membership and null tests on what headers give: record_type, url, ids, digest, and single headers."""
        for f in filters:
            inner, flag = (f.child, "not") if isinstance(f, Not) else (f, "")
            kind, name = type(inner), getattr(inner, "attribute", ())
            known = len(name) == 1 and name[0] in ("page_id", "url", "record_type", "payload_digest", "refers_to") or len(name) == 2 and name[0] == "headers"
            if known and kind in (EqualTo, In, IsNull, IsNotNull) and not (flag and kind in (IsNull, IsNotNull)):
                self.tests.append((flag, kind.__name__, ".".join(name), getattr(inner, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        from pyarrow import fs as pafs

        fs, where = common.arrow_fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(where, recursive=True))
        parts = []
        for i in sorted((x for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz"))), key=lambda x: x.path):
            step = self.split if i.path.endswith(".gz") else max(1, i.size)
            parts += [Part(i.path, a, min(i.size, a + step)) for a in range(0, i.size, step)]
        return parts or [Part("")]

    def _wanted(self, row: dict) -> bool:
        for flag, kind, name, value in self.tests:
            have = row["headers"].get(name[8:]) if name.startswith("headers.") else row[name]
            if kind == "IsNull" or kind == "IsNotNull":
                ok = (have is None) == (kind == "IsNull")
            else:
                ok = have is not None and ((have in value if kind == "In" else have == value) != (flag == "not"))
            if not ok:
                return False
        return True

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = common.arrow_fs(self.path)
        gz, rows, held = partition.file.endswith(".gz"), [], 0
        with fs.open_input_file(partition.file) as f:
            s = _Stream(f, partition.start, f.size())
            while self._seek(s, partition.end, gz):
                m = (_Member if gz else _Plain)(s)
                try:
                    found = _head(m)
                except zlib.error:
                    found = None
                if found is None:  # only looked like the beginning of a record
                    s.move(m.start + 1)
                    continue
                h, at, size = found
                if not gz:
                    m.length = at + size + 4
                row = _columns(h)
                cut = m.length is not None and m.start + m.length > s.size + (0 if gz else 4)  # the blank lines behind the last record may be missing
                row["payload"], row["damaged"] = None, cut
                wanted = self._wanted(row)
                if wanted:
                    rows.append(row)
                try:
                    if wanted and not cut and row["record_type"] != "revisit" and (self.payload or row["payload_bytes"] is None or row["payload_digest"] is None):
                        block = m.until(at + size)
                        body = block[block.find(b"\r\n\r\n", at) + 4 :] if "msgtype=response" in h.get("Content-Type", "") else block[at:]
                        sha, told = digest(body), row["payload_digest"]
                        row["damaged"] = len(block) < at + size or told is not None and len(told) == len(sha) and told.upper() != sha
                        if not row["damaged"]:
                            row["payload"] = body if self.payload else None
                            row["payload_bytes"], row["payload_digest"] = len(body), sha
                        held += len(body)
                    m.end()
                except zlib.error:  # what its headers say stays, without payload
                    row["damaged"] = True
                    s.move(m.start + (m.length or 1))
                if len(rows) >= ROWS or held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _seek(s: _Stream, end: int, gz: bool) -> bool:
        """Moves to the next place before end that looks like the beginning of a record; false if there is none."""
        mark = MAGIC if gz else b"WARC/"
        while s.at < end and s.fill(len(mark)):
            k = s.buffer.find(mark)
            s.move(s.at + (k if k >= 0 else len(s.buffer) - len(mark) + 1))
            if k >= 0:
                s.fill(24)
                if s.at < end and (not gz or _starts_member(s.buffer, s.at, s.size)):
                    return True
                s.move(s.at + 1)
        return False

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), "damaged": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array([list(r[c].items()) if c == "headers" else r[c] for r in rows], k) for c, k in kinds.items()], list(kinds))


class Warc(DataSource):
    """Options: path (with its scheme); payload (default true; false leaves payload null and skips it); split (bytes of a partition); date of written records."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() != "false", int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("date", "2024-01-01T00:00:00Z"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """A record for each row of pages (page_id, url, html) under path.

    Of rows with equal html of least_bytes or more in UTF-8, those with the largest page_id are responses and the others revisit it; all other rows, and
    those without page_id, are responses. Null html is an empty payload. Only digests are grouped; pages are shuffled only if more digests repeat than can be broadcast.
    """
    spark = pages.sparkSession
    spark.dataSource.register(Warc)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("key", F.sha1("payload"))
    sized = pages.select(F.col("page_id").cast("long"), payload.alias("p")).where(F.octet_length("p") >= least_bytes).select("page_id", F.sha1("p").alias("key"))
    twice = sized.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("key", "last")
    twice = common.small(common.store(twice, "digests"), MAX_DIGESTS)
    refers = F.when(F.col("page_id") != F.col("last"), F.col("last"))
    records = keyed.join(twice, "key", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
    records.write.format("warc").mode("append").save(common.qualified(spark, path))


def read(spark: SparkSession, path: str, payload: bool = True, split: int = SPLIT) -> DataFrame:
    """All records under path: page_id, url, record_type, payload_digest, payload_bytes, refers_to, headers, payload, damaged. Filters on record_type, url, ids, digest and headers['...'] reach the reader, for which the session's push-down for Python sources is set.

    A record that ends before its told length, or whose payload doesn't have the told digest, is damaged: it has what its headers say and no payload. A record cut within its headers
    has no name and gives nothing. split is the size of a partition in bytes.
    """
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("split", split).load(common.qualified(spark, path))


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url. Empty pages give an empty result, repeated rows a record each.

    Headers tell all of this, so payloads are passed over undecoded.
    """
    path = common.scratch(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    return read(pages.sparkSession, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
