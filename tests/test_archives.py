"""Archives as a source: a task for each member, refusals by the directory, members read by their bytes alone."""

import json
import zipfile
from pathlib import Path

import pytest

from attestry.sources import archives, exports


def archive(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return path


def scan(spark, path):
    return exports.scan(spark, [{"provider": "chatgpt", "path": str(path), "attachment_root": None}])


def test_a_task_for_each_member(spark, tmp_path):
    want = {f"x/conversations-{i}.json": json.dumps([{"id": i, "t": "é" * i}]).encode() for i in range(1000)}
    place = archive(tmp_path / "a b.zip", want | {"media.bin": b"\0" * 100_000, "x/": b""})
    rows = scan(spark, place)
    assert rows.rdd.getNumPartitions() == 1000
    got = {(r.path, r.member): bytes(r.content) for r in rows.collect()}
    assert got == {(f"file:{place}", k): v for k, v in want.items()}
    assert exports.read_location(f"file:{place}", "x/conversations-7.json") == want["x/conversations-7.json"]


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_methods(tmp_path, method):
    data = b"[]" + b" " * 3_000_000
    place = archive(tmp_path / "a.zip", {"conversations.json": data, "conversations-1.json": b""}, method)
    assert [archives.read_member(place, archives.Member.of(i)) for i in exports.checked_members(place)] == [b"", data]


def test_only_the_members_bytes_are_read(tmp_path, monkeypatch):
    place = archive(tmp_path / "a.zip", {"media.bin": bytes(range(256)) * 40_000, "conversations.json": b"[1]"}, zipfile.ZIP_STORED)
    (info,) = exports.checked_members(place)
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, *a):
            return self.f.seek(*a)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    real = Path.open
    monkeypatch.setattr(Path, "open", lambda self, *a: Counted(real(self, *a)))
    assert archives.read_member(place, archives.Member.of(info)) == b"[1]" and sum(read) == archives.LOCAL_HEADER + 3


def test_refused_before_any_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "read_member", None)
    for name, members in {"none": {"a.json": b""}, "leaves": {"../conversations.json": b"[]"}}.items():
        with pytest.raises(exports.SourceError):
            scan(spark, archive(tmp_path / f"{name}.zip", members))
    monkeypatch.setattr(exports, "MAX_PAYLOAD", 10_000)
    with pytest.raises(exports.SourceError, match="more than 10000 bytes"):
        scan(spark, archive(tmp_path / "bomb.zip", {"conversations.json": b" " * 1_000_000}))


@pytest.mark.parametrize("what", ["size", "crc", "place", "data"])
def test_members_that_are_not_what_the_directory_says(tmp_path, what):
    place = archive(tmp_path / "a.zip", {"conversations.json": b"[1, 2, 3]" * 50})
    member = archives.Member.of(exports.checked_members(place)[0])
    if what == "size":
        member.size -= 1
    elif what == "crc":
        member.crc ^= 1
    elif what == "place":
        member.offset += 1
    else:
        raw = bytearray(place.read_bytes())
        raw[60:70] = b"\xff" * 10
        place.write_bytes(raw)
    with pytest.raises(archives.ArchiveError):
        archives.read_member(place, member)
