"""WARC archives: a writer, and a Python data source that reads them.

The source plans one partition for each archive file and pushes filters on ``record_type`` and other header columns down:
headers are parsed first, records that fail are skipped without looking at their content, and payloads are decoded only if
the option ``payload`` asks for them. Records are compressed one by one. Each member names its length in the gzip header
(subfield SL), so what is left of an unwanted record is passed over without being inflated; members without it, and plain
archives, are read through. A record's block ends by its Content-Length; only blocks of type application/http are split
into HTTP head and payload, so records of any other type can stand between pages.

Of records with equal payloads (at least ``least`` bytes, by SHA-1) the one with the smallest page_id is a response and
stores the payload, the others are revisits that refer to it. Null html is an empty payload. Rows that repeat the page_id of
their response are responses too. A null page_id has no identity: such a record is a revisit if a page with an id has its
payload, else a response, and comes back as null. An empty table gives no files and no rows. Columns other than page_id,
url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition
from pyspark.sql.types import StructType

from ._common import load, shared_dir, stage
from .token_files import open_fs, write_file

SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Bytes after which a task starts its next archive.
ROLL = 32 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(name: str, value) -> str:
    return f"{name}: {re.sub(r'[\r\n]+', ' ', str(value))}\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One compressed record; a revisit if refers_to is given."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = f"{VERSION}\r\nWARC-Type: {kind}\r\n"
    head += _header("WARC-Record-ID", f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>")
    head += _header("WARC-Date", DATE)
    if url is not None:
        head += _header("WARC-Target-URI", url)
    head += _header("WARC-Payload-Digest", f"sha1:{digest(payload)}")
    if refers_to is not None:
        head += _header("WARC-Profile", PROFILE) + _header("WARC-Refers-To", f"<urn:x-page:{refers_to}>")
    head += _header("Content-Type", "application/http; msgtype=response") + _header("Content-Length", len(block))
    return member(head.encode() + b"\r\n" + block + b"\r\n\r\n")


def member(data: bytes) -> bytes:
    """A gzip member that names its own length and that of its content in the subfield SL, if 32 bits hold them."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(data)) >= 1 << 32:
        return struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 0, 0, 0, 255) + body + tail
    return struct.pack("<BBBBIBBH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"SL", 8, size, len(data)) + body + tail


def _writer(folder: str):
    def run(batches):
        held, size = [], 0

        def flush():
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            write_file(path, b"".join(held))
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                page_id, url, html, refers_to = (x.as_py() for x in row)
                held.append(record(page_id, url, (html or "").encode(), refers_to))
                size += len(held[-1])
                if size >= ROLL:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


#: Pages of a payload from which they are spread over ``SALTS`` tasks.
HOT, SALTS = 1000, 32


def write_warc(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes archives and returns their manifest, ``path, records``.

    The page of each payload's response is a minimum over digests, combined before the shuffle. Digests that many pages share
    meet their pages in salted tasks, the others by digest; only ids of revisits go back to the pages.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = F.coalesce("html", F.lit(""))
    slim = stage(pages.filter(F.octet_length(body) >= least).select("page_id", F.unhex(F.sha1(body.cast("binary"))).alias("sha")), "digests")
    first = stage(slim.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "shared")
    hot = first.filter(F.col("n") >= HOT).select("sha", F.col("first").alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    both = slim.withColumn("salt", salt).join(hot, ["sha", "salt"], "left")
    cold = both.filter("hot is null").select("page_id", "sha").join(first.filter(F.col("n") < HOT).select("sha", "first"), "sha")
    found = cold.unionByName(both.filter("hot is not null").select("page_id", "sha", F.col("hot").alias("first")))
    again = found.filter("first is not null and not (page_id <=> first)").distinct().select(F.col("page_id").alias("again"), F.col("sha").alias("again_sha"), F.col("first").alias("refers_to"))
    own = pages.withColumn("sha", F.unhex(F.sha1(body.cast("binary"))))
    rows = own.join(again, own["page_id"].eqNullSafe(F.col("again")) & (F.col("sha") == F.col("again_sha")), "left").select("page_id", "url", "html", "refers_to")
    return stage(rows.mapInArrow(_writer(shared_dir(pages.sparkSession, "warc")), "path string, records long"), "manifest")


# ------------------------------------------------------------------ reading


class ArchivePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Stream:
    """The content of an archive, record by record, with no more than one piece in memory; ``inflated`` counts its bytes."""

    #: Bytes that are read, and inflated, at a time.
    PIECE, FEED = 1 << 18, 1 << 13

    def __init__(self, raw):
        self.raw, self.data, self.gz, self.buffer, self.inflated = raw, b"", None, bytearray(), 0
        self.at = 0  # what of data is used
        self.plain = False
        self.left = self.total = None  # raw and inflated bytes that the member still has, where it says so

    def _fill(self, least: int) -> bool:
        while len(self.data) - self.at < least:
            piece = self.raw.read(self.PIECE)
            if not piece:
                return False
            self.data, self.at = self.data[self.at :] + piece, 0
        return True

    def _begin(self) -> bool:
        """At the start of a member: whether there is one, and how long it is."""
        self.gz = self.left = self.total = None
        if not self._fill(1):
            return False
        at = lambda a, b: self.data[self.at + a : self.at + b]
        if self.plain or not self._fill(2) or at(0, 2) != b"\x1f\x8b":
            self.plain = True
            return True
        self.gz = zlib.decompressobj(31)
        if self._fill(12) and at(3, 4)[0] & 4 and self._fill(12 + (size := int.from_bytes(at(10, 12), "little"))):
            extra = at(12, 12 + size)
            while len(extra) >= 4:
                name, n = extra[:2], int.from_bytes(extra[2:4], "little")
                if name == b"SL" and n == 8:
                    self.left, self.total = struct.unpack("<II", extra[4:12])
                extra = extra[4 + n :]
        return True

    def _more(self) -> bool:
        if (self.gz is None or self.gz.eof) and not self._begin():
            return False
        if self.plain:
            self.buffer += self.data[self.at :]
            self.data, self.at = b"", 0
            return True
        if not self._fill(1):
            return False
        most = self.FEED if self.left is None else min(self.left, self.FEED)
        some = self.data[self.at : self.at + most]
        out = self.gz.decompress(some)
        used = len(some) - len(self.gz.unused_data)
        self.at += used
        if self.left is not None:
            self.left -= used
            self.total -= len(out)
        self.inflated += len(out)
        self.buffer += out
        return True

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """What stands before the mark, which is consumed too; None if it does not come, or not within ``most`` bytes."""
        at = 0
        while (i := self.buffer.find(mark, at, most)) < 0:
            if most is not None and len(self.buffer) >= most:
                return None
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def skip(self, n: int) -> None:
        while n:
            k = min(n, len(self.buffer))
            del self.buffer[:k]
            n -= k
            if n and self.total is not None and self.gz is not None and not self.gz.eof and n >= self.total:
                n -= self.total
                self._pass_over()
            elif n and not self._more():
                return

    def _pass_over(self) -> None:
        """The rest of the member, as it is."""
        k = min(self.left, len(self.data) - self.at)
        self.at, rest = self.at + k, self.left - k
        if rest and self.raw.seekable():
            self.raw.seek(rest, 1)
        elif rest:
            self.raw.read(rest)
        self.gz = self.left = self.total = None


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_archive(raw, wanted, payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA; ``wanted(columns)`` sees what the record's headers tell and decides whether its content is read."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields.get("content-length", 0))
        row = {"page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "refers_to": _page(fields.get("warc-refers-to")), "payload_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None}
        if not wanted(row):
            stream.skip(size + 4)
            continue
        http = stream.until(b"\r\n\r\n", size) if fields.get("content-type", "").lower().startswith("application/http") else None
        rest = size if http is None else size - len(http) - 4
        m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http or b"")
        body = None
        if payload and row["record_type"] == "response":
            body = stream.take(rest)
            stream.skip(4)
        else:
            stream.skip(rest + 4)
        yield row["page_id"], row["url"], row["record_type"], row["refers_to"], int(m[1]) if m else rest, row["payload_digest"], body


class WarcReader(DataSourceReader):
    def __init__(self, paths: list[str], payload: bool):
        self.paths, self.payload, self.filters = paths, payload, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("record_type", "page_id", "url", "refers_to", "payload_digest") and isinstance(f, EqualTo | In | GreaterThanOrEqual):
                self.filters.append((name, "in" if isinstance(f, In) else "ge" if isinstance(f, GreaterThanOrEqual) else "eq", f.value))
            else:
                yield f

    def partitions(self):
        return [ArchivePartition(p) for p in self.paths] or [ArchivePartition("")]

    def _wanted(self, row: dict) -> bool:
        for name, how, value in self.filters:
            x = row[name]
            if x is None or not (x in value if how == "in" else x >= value if how == "ge" else x == value):
                return False
        return True

    def read(self, partition):
        if not partition.path:
            return
        store, name = open_fs(partition.path)
        with store.open_input_file(name) as raw:
            yield from read_archive(raw, self._wanted, self.payload)


class WarcDataSource(DataSource):
    """``spark.read.format("tidemark_warc")``; options: paths (one in each line), payload (true or false)."""

    @classmethod
    def name(cls):
        return "tidemark_warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        paths = [p for p in (self.options.get("paths") or self.options.get("path") or "").split("\n") if p]
        return WarcReader(paths, self.options.get("payload", "false").lower() == "true")


def read_warc(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """Rows of SCHEMA. The driver gets the list of files, as for any file source."""
    spark = manifest.sparkSession
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    paths = [r[0] for r in manifest.select("path").toLocalIterator()]
    return spark.read.format("tidemark_warc").option("paths", "\n".join(paths)).option("payload", str(payload).lower()).load()


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``; digests of responses are taken of what was read."""
    rows = read_warc(write_warc(pages, least), payload=True)

    def check(batches):
        for b in batches:
            sizes, digests = b.column("payload_bytes").to_pylist(), b.column("payload_digest").to_pylist()
            for i, body in enumerate(b.column("payload")):
                if body.is_valid:
                    own = bytes(body.as_buffer())
                    if digest(own) != digests[i] or len(own) != sizes[i]:
                        raise ValueError("a payload differs from its record's header")
            yield b.select(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").mapInArrow(check, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    return warc_round_trip(load(spark, sf_dir, "pages"))
