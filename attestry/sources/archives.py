"""ZIP archives as a Spark data source: the directory is read for the plan, then each member is a task of its own.

A member's task reads the bytes of that member alone, by its place in the file, so an archive of many members is read by
many tasks and none holds it. An archive with a fault is refused by its directory, before any member is read.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "attestry_zip"
SCHEMA = "path string, member string, content binary"
#: Bytes that are read of a member at once.
STEP = 1 << 20

#: Fixed values of the format: a member's own header has 30 bytes, in which the lengths of its name and extra field stand.
LOCAL_HEADER, NAME_LENGTH, EXTRA_LENGTH, LOCAL_MARK = 30, slice(26, 28), slice(28, 30), b"PK\x03\x04"


class ArchiveError(ValueError):
    """A member that isn't what the archive's directory says."""


def local(path: str | Path) -> Path:
    return Path(str(path).removeprefix("file:"))


def directory(path: str | Path) -> list[zipfile.ZipInfo]:
    """The members as the directory at the archive's end lists them; nothing else of it is read."""
    with zipfile.ZipFile(local(path)) as z:
        return z.infolist()


@dataclass
class Member(InputPartition):
    name: str
    offset: int
    packed: int
    size: int
    crc: int
    method: int

    @classmethod
    def of(cls, info: zipfile.ZipInfo) -> Member:
        return cls(info.filename, info.header_offset, info.compress_size, info.file_size, info.CRC, info.compress_type)


def read_member(path: str | Path, member: Member) -> bytes:
    """A member's bytes. What doesn't unpack to the length and checksum of the directory is refused; no more than that
    length is ever unpacked."""
    with local(path).open("rb") as f:
        f.seek(member.offset)
        head = f.read(LOCAL_HEADER)
        if head[:4] != LOCAL_MARK:
            raise ArchiveError(f"{path}: {member.name} isn't where the archive says")
        f.seek(sum(int.from_bytes(head[s], "little") for s in (NAME_LENGTH, EXTRA_LENGTH)), 1)
        content = b"".join(_unpacked(f, member)) if member.method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) else None
    if content is None:
        # methods that hardly any archive has
        with zipfile.ZipFile(local(path)) as z, z.open(member.name) as f:
            content = f.read(member.size + 1)
    if len(content) != member.size:
        raise ArchiveError(f"{path}: {member.name} isn't as long as the archive says")
    if zlib.crc32(content) != member.crc:
        raise ArchiveError(f"{path}: {member.name} isn't what was packed")
    return content


def _unpacked(f, member: Member) -> Iterator[bytes]:
    left, room = member.packed, member.size + 1
    inflate = zlib.decompressobj(-zlib.MAX_WBITS) if member.method == zipfile.ZIP_DEFLATED else None
    while left and room > 0:
        data = f.read(min(STEP, left))
        if not data:
            return
        left -= len(data)
        try:
            out = inflate.decompress(data, room) if inflate else data[:room]
        except zlib.error as e:
            raise ArchiveError(f"{member.name} can't be unpacked") from e
        room -= len(out)
        yield out


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Member]:
        from attestry.sources import exports

        return [Member.of(i) for i in exports.checked_members(self.path)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        content = read_member(self.path, partition)
        yield pa.RecordBatch.from_arrays([pa.array([f"file:{local(self.path)}"]), pa.array([partition.name]), pa.array([content], pa.binary())], names=["path", "member", "content"])


class Archive(DataSource):
    """spark.read.format("attestry_zip").load(path): a row and a task for each conversation member of the archive."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])
