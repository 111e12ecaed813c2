"""A data source for ZIP archives of text members: ``spark.read.format("tidemark_zip").load(path)``.

The driver reads the central directory once; a partition carries the places and sizes of its members (about ``bytes``
compressed bytes, option, 4 MB), so a task reads its own local headers and nothing else of the directory.

Rows: ``member, row_number, line, size, compressed_size, crc32, error``. Lines end with a line feed; a carriage return before
it is no part of them. Bytes that are no UTF-8 become U+FFFD, which no field accepts. An empty member, a folder's file that
is not text (``lines`` false) and a member that cannot be read give one row without line; the last one has ``error``, and the
other members are read all the same. Only members that end in .txt are read.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "member string, row_number long, line string, size long, compressed_size long, crc32 string, error string"
ROWS = pa.schema([("member", pa.string()), ("row_number", pa.int64()), ("line", pa.string()), ("size", pa.int64()), ("compressed_size", pa.int64()), ("crc32", pa.string()), ("error", pa.string())])
PIECE = 1 << 20
#: Rows that a reader hands over at once.
BATCH = 10_000


@dataclass(frozen=True)
class Member:
    name: str
    offset: int
    compressed: int
    size: int
    crc: int
    method: int


class Members(InputPartition):
    def __init__(self, path: str, members: list[Member]):
        self.path, self.members = path, members


def _open(path: str):
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _create(path: str):
    if "://" not in path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    return store.open_output_stream(name)


def _remove(path: str) -> None:
    if "://" not in path:
        return shutil.rmtree(path, ignore_errors=True)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    if store.get_file_info(name).type != fs.FileType.NotFound:
        store.delete_dir(name)


def _entry(name: str) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(name)
    info.compress_type = zipfile.ZIP_DEFLATED
    return info


PACKED = pa.schema([("part", pa.string()), ("member", pa.string()), ("at", pa.int64()), ("compressed", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("flags", pa.int32())])
PART = "part string, member string, at long, compressed long, size long, crc long, flags int"


def _packer(folder: str, header: str):
    """Packs sorted lines into a part; rows are its members, and last its length, with a null member."""

    def run(batches):
        part, name, f, out, z = f"{folder}/{uuid.uuid4().hex}", None, None, None, None
        for batch in batches:
            for member, line in zip(batch.column("member").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if f is None or member != name:
                    if f:
                        f.close()
                    else:
                        out = _create(part)
                        z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    name, f = member, z.open(_entry(member), "w", force_zip64=True)
                    f.write(header.encode() + b"\n")
                f.write(line.encode() + b"\n")
        if f is None:
            return
        f.close()
        own, length = z.infolist(), z.start_dir
        z.close()
        out.close()
        for n in range(0, len(own), 10_000):
            rows = [(part, i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.flag_bits) for i in own[n : n + 10_000]]
            yield pa.RecordBatch.from_pylist([dict(zip(PACKED.names, r, strict=True)) for r in rows], PACKED)
        yield pa.RecordBatch.from_pylist([{"part": part, "at": length}], PACKED)

    return run


def write_zip(rows: DataFrame, path: str, header: str, more=()) -> None:
    """An archive of ``member, row_number, line``, each member's lines under the header; ``more`` has further (name, lines) pairs.

    Tasks pack whole members into parts beside the archive, so no line passes through the driver; it joins the parts' bytes
    and writes the directory.
    """
    folder = f"{path}.parts"
    lines = rows.select("member", "row_number", "line").repartition("member").sortWithinPartitions("member", "row_number").select("member", "line")
    parts: dict[str, list] = {}
    for r in lines.mapInArrow(_packer(folder, header), PART).collect():  # a row a member, as the directory has
        parts.setdefault(r["part"], []).append(r)
    with _create(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, own in more:
            with z.open(_entry(name), "w") as f:
                for line in own:
                    f.write(line.encode() + b"\n")
        for part, own in sorted(parts.items()):
            base, left = z.start_dir, next(r["at"] for r in own if r["member"] is None)
            with _open(part) as f:
                while left:
                    piece = f.read(min(PIECE, left))
                    if not piece:
                        raise OSError(f"{part} ends too early")
                    z.fp.write(piece)
                    left -= len(piece)
            for r in own:
                if r["member"] is not None:
                    info = _entry(r["member"])
                    info.header_offset, info.compress_size, info.file_size, info.CRC, info.flag_bits = base + r["at"], r["compressed"], r["size"], r["crc"], r["flags"]
                    info.external_attr = 0o600 << 16
                    z.filelist.append(info)
                    z.NameToInfo[info.filename] = info
            z.start_dir = z.fp.tell()
    _remove(folder)


def directory(path: str) -> list[Member]:
    """The files of an archive by name."""
    with _open(path) as f, zipfile.ZipFile(f) as z:
        return sorted((Member(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type) for i in z.infolist() if not i.is_dir()), key=lambda m: m.name)


def content(f, member: Member):
    """The pieces of a member's content, checked against its CRC."""
    f.seek(member.offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the directory says")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(member.offset + 30 + name + extra)
    if member.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression method {member.method}")
    packer = zlib.decompressobj(-15) if member.method == zipfile.ZIP_DEFLATED else None
    left, crc = member.compressed, 0
    while left:
        raw = f.read(min(PIECE, left))
        if not raw:
            raise ValueError("the member ends too early")
        left -= len(raw)
        piece = packer.decompress(raw) if packer else raw
        crc = zlib.crc32(piece, crc)
        yield piece
    if packer and (rest := packer.flush()):
        crc = zlib.crc32(rest, crc)
        yield rest
    if crc != member.crc:
        raise ValueError("CRC differs")


def lines(pieces):
    """Lines without their ends."""
    held = b""
    for piece in pieces:
        *whole, held = (held + piece).split(b"\n")
        yield from whole
    if held:
        yield held


class ZipReader(DataSourceReader):
    def __init__(self, path: str, step: int, text: bool, only: set[str]):
        self.path, self.step, self.text, self.only = path, step, text, only

    def partitions(self):
        groups, size = [[]], 0
        for m in directory(self.path):
            if self.only and m.name not in self.only:
                continue
            if groups[-1] and size + m.compressed > self.step:
                groups.append([])
                size = 0
            groups[-1].append(m)
            size += m.compressed
        return [Members(self.path, g) for g in groups]

    def read(self, partition):
        if not partition.members:
            return
        held: list[tuple] = []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), ROWS, strict=True)], schema=ROWS)
            held.clear()
            return out

        with _open(partition.path) as f:
            for m in partition.members:
                own = (m.size, m.compressed, f"{m.crc:08x}")
                if not self.text or not m.name.lower().endswith(".txt"):
                    held.append((m.name, None, None, *own, None))
                else:
                    n = 0
                    try:
                        for n, line in enumerate(lines(content(f, m)), 1):
                            held.append((m.name, n, line.rstrip(b"\r\n").decode("utf-8-sig" if n == 1 else "utf-8", "replace"), *own, None))
                            if len(held) >= BATCH:
                                yield batch()
                    except (ValueError, OSError, zlib.error) as e:
                        held.append((m.name, None, None, *own, f"{type(e).__name__}: {e}"))
                    else:
                        if not n:
                            held.append((m.name, None, None, *own, None))
                if len(held) >= BATCH:
                    yield batch()
        if held:
            yield batch()


class ZipSource(DataSource):
    @classmethod
    def name(cls):
        return "tidemark_zip"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ZipReader(self.options["path"], int(self.options.get("bytes", str(4 << 20))), self.options.get("lines", "true").lower() == "true", {x for x in self.options.get("only", "").split("\n") if x})


def read_zip(spark: SparkSession, path: str, lines: bool = True, only: list[str] | None = None) -> DataFrame:
    """The archive's rows, or those of the members that ``only`` names."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("tidemark_zip").option("lines", str(lines).lower()).option("only", "\n".join(only or [])).load(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Every file of the archive, from its directory alone: ``member, compressed_size, size, crc32, is_txt, classified`` and its identity."""
    from ..operators.validation import classify_paths

    found = classify_paths(read_zip(spark, path, lines=False).select("member", "compressed_size", "size", "crc32"))
    return found.withColumns({"is_txt": F.lower("member").endswith(".txt"), "classified": F.col("instrument_id").isNotNull()})


def _header_valid():
    from ..operators.validation import HEADER

    names = F.expr("transform(split(btrim(line, ' \\t\\r\\f\\u000b'), ',', -1), x -> btrim(x, ' \\t\\r\\f\\u000b'))")
    return names.eqNullSafe(F.array(*map(F.lit, HEADER)))


def headers(lines: DataFrame) -> DataFrame:
    """``member, header_valid`` of each member that has a line."""
    return lines.filter("row_number = 1").select("member", _header_valid().alias("header_valid"))


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines after the header, with ``header_valid`` of their member, ready for validation; the archive is read once."""
    w = Window.partitionBy("member").orderBy("row_number")  # the validation's own, so one exchange serves both
    rows = lines.filter("row_number is not null").select("member", "row_number", "line", F.when(F.col("row_number") == 1, _header_valid()).alias("header_valid"))
    return rows.withColumn("header_valid", F.max("header_valid").over(w)).filter("row_number > 1")


def states(lines: DataFrame) -> DataFrame:
    """``member, header_valid, broken`` of each member that has a line or an error; header_valid is null without a line."""
    rows = lines.filter("row_number = 1 or error is not null").select("member", F.when(F.col("row_number") == 1, _header_valid()).alias("h"), F.col("error").isNotNull().alias("e"))
    return rows.groupBy("member").agg(F.max("h").alias("header_valid"), F.max("e").alias("broken"))


def member_errors(lines: DataFrame) -> DataFrame:
    """``member, error`` of members that could not be read."""
    return lines.filter("error is not null").select("member", "error")
