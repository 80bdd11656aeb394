"""Zip archives as a source of Spark: `spark.read.format("zip_members")`, read by all tasks a range of members each.

The driver reads an archive's tail and goes through its table of members to cut it into ranges; a task reads its range of
the table and then the members' bytes by place. Nobody holds an archive, so its size does not matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Fixed values of the zip format: marks of its records, their fixed parts, the values that say "see the 64-bit field".
END, END64, LOCATOR64, MEMBER = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
END_PART, END64_PART, LOCATOR64_PART = struct.Struct("<4s4H2LH"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL")
MEMBER_PART, LOCAL_PART = struct.Struct("<4s6H3L5H2L"), struct.Struct("<26x2H")
NONE16, NONE32, MOST_COMMENT = 0xFFFF, 0xFFFFFFFF, 0xFFFF
STORED, DEFLATED, ENCRYPTED, UTF8 = 0, 8, 1, 1 << 11

#: Compressed bytes and members of a range; bytes read ahead; rows and bytes of a batch.
RANGE_BYTES, RANGE_MEMBERS, AHEAD, BATCH_ROWS, BATCH_BYTES = 16 << 20, 20_000, 1 << 20, 1000, 8 << 20

COLUMNS = "archive string, member string, match_id string, bytes long, text string, error string"


@dataclass
class Members(InputPartition):
    """A range of an archive's table of members; shift: bytes that stand before the archive in its file."""

    archive: str
    start: int
    end: int
    shift: int


@dataclass
class Entry:
    """A member as the table has it."""

    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    place: int


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Reader:
    """Bytes of a file by place, read ahead a little."""

    def __init__(self, path: str):
        store, path = store_of(path)
        self.file = store.open_input_file(path)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def read(self, place: int, n: int) -> bytes:
        if place < self.at or place + n > self.at + len(self.held):
            self.at, self.held = place, self.file.read_at(min(max(n, AHEAD), max(self.size - place, 0)), place)
        return self.held[place - self.at : place - self.at + n]


def table_range(reader: Reader) -> tuple[int, int, int]:
    """Where the table of members starts and ends, and the shift of all places."""
    begin = max(0, reader.size - END_PART.size - MOST_COMMENT)
    tail = reader.read(begin, reader.size - begin)
    at = tail.rfind(END)
    while at >= 0:
        if at + END_PART.size <= len(tail):
            *_, members, size, start, comment = END_PART.unpack_from(tail, at)
            if at + END_PART.size + comment == len(tail):
                break
        at = tail.rfind(END, 0, at)
    else:
        raise ValueError("not a zip archive: it has no end record")
    end = begin + at
    before = end - LOCATOR64_PART.size
    mark, _, place, _ = LOCATOR64_PART.unpack(reader.read(before, LOCATOR64_PART.size)) if before >= 0 else (b"", 0, 0, 0)
    if mark == LOCATOR64:
        for end in (before - END64_PART.size, place):  # it mostly stands right before; its own place knows of no shift
            if reader.read(end, 4) == END64:
                break
        *_, size, start = END64_PART.unpack(reader.read(end, END64_PART.size))
    elif members == NONE16 or size == NONE32 or start == NONE32:
        raise ValueError("not a zip archive: the 64-bit end record is missing")
    return end - size, end, end - size - start


def entries(reader: Reader, start: int, end: int) -> Iterator[tuple[int, Entry]]:
    """The members of a range of the table, each with the place where its record ends."""
    at = start
    while at < end:
        mark, _, _, flags, method, _, _, crc, packed, size, name_size, more_size, note, _, _, _, place = MEMBER_PART.unpack(reader.read(at, MEMBER_PART.size))
        if mark != MEMBER:
            raise ValueError(f"broken table of members at byte {at}")
        rest = reader.read(at + MEMBER_PART.size, name_size + more_size)
        name, more = rest[:name_size].decode("utf-8" if flags & UTF8 else "cp437"), rest[name_size:]
        while len(more) >= 4:  # extra fields; number 1 has the 64-bit values of those that say so, in this order
            number, length = struct.unpack_from("<2H", more)
            if number == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", more, 4))
                size = next(wide) if size == NONE32 else size
                packed = next(wide) if packed == NONE32 else packed
                place = next(wide) if place == NONE32 else place
            more = more[4 + length :]
        at += MEMBER_PART.size + name_size + len(rest) - name_size + note
        yield at, Entry(name, method, flags, crc, packed, size, place)


def is_document(name: str) -> bool:
    """JSON members but for any readme."""
    base = name.rsplit("/", 1)[-1].lower()
    return base.endswith(".json") and base != "readme.json"


def unpacked(reader: Reader, entry: Entry, shift: int) -> tuple[str | None, str | None]:
    """A member's text, or null and what is wrong with it."""
    try:
        if entry.flags & ENCRYPTED:
            return None, "encrypted"
        if entry.method not in (STORED, DEFLATED):
            return None, f"compressed by method {entry.method}"
        place = entry.place + shift
        data = place + 30 + sum(LOCAL_PART.unpack(reader.read(place, 30)))
        raw = reader.read(data, entry.packed)
        if entry.method == DEFLATED:
            raw = zlib.decompress(raw, -zlib.MAX_WBITS)
        if len(raw) != entry.size or zlib.crc32(raw) != entry.crc:
            return None, "broken bytes"
        return raw.decode("utf-8", "replace"), None
    except (zlib.error, struct.error) as e:
        return None, f"broken bytes: {e}"


class ZipReader(DataSourceReader):
    """Reads all members."""

    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.range_members = int(options.get("rangeMembers", RANGE_MEMBERS))
        self.wanted: set[str] | None = None

    def archives(self) -> list[str]:
        store, path = store_of(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [self.path]
        found = store.get_file_info(fs.FileSelector(path))
        return sorted(f"{self.path.rstrip('/')}/{x.base_name}" for x in found if x.type == fs.FileType.File and x.base_name.endswith(".zip"))

    def partitions(self) -> list[Members]:
        """Ranges of members; the driver goes through a table a piece at a time and keeps the edges."""
        out = []
        for archive in self.archives():
            reader = Reader(archive)
            start, end, shift = table_range(reader)
            begin = start
            packed = members = 0
            for at, entry in entries(reader, start, end):
                packed, members = packed + entry.packed, members + 1
                if packed >= self.range_bytes or members >= self.range_members or at >= end:
                    out.append(Members(archive, begin, at, shift))
                    begin, packed, members = at, 0, 0
        return out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without members
            return
        table, data = Reader(partition.archive), Reader(partition.archive)
        names = [f.name for f in self.schema.fields]
        kinds = pa.schema([(n, pa.int64() if n == "bytes" else pa.string()) for n in names])
        rows, size = [], 0
        for _, entry in entries(table, partition.start, partition.end):
            match_id = entry.name.rsplit("/", 1)[-1][:-5]
            if not is_document(entry.name) or self.wanted is not None and match_id not in self.wanted:
                continue
            text, error = unpacked(data, entry, partition.shift)
            rows.append({"archive": partition.archive, "member": entry.name, "match_id": match_id, "bytes": entry.size, "text": text, "error": error})
            size += entry.size
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


class FilteredZipReader(ZipReader):
    """Leaves members alone whose match id is not asked for."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Members whose match id is not asked for are not read; Spark applies the filters all the same."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("match_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            yield f


class ZipMembers(DataSource):
    """The JSON members of a zip archive, or of all archives of a folder: archive, member, match_id, bytes, text, error.

    Options: path (of any store that pyarrow.fs opens), rangeBytes and rangeMembers (of a partition), pushFilters (true
    where spark.sql.python.filterPushdown.enabled is: then members of other match ids than those asked for are not read). A member that
    cannot be unpacked has an error in place of its text. Deflated and stored members, 64-bit archives and archives
    behind other bytes are read.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> ZipReader:
        # Spark refuses a reader that takes filters in a session that pushes none down to Python
        return (FilteredZipReader if self.options.get("pushFilters") == "true" else ZipReader)(schema, self.options)


def read_members(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The JSON members of archives; see ZipMembers."""
    spark.dataSource.register(ZipMembers)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("zip_members").options(pushFilters=pushed, **options).load(path)
