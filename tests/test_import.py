import json
import zipfile

import pytest
from pyspark.sql import functions as F

from attestry.functions.identity import StrictJsonError, strict_json
from attestry.operators.graph import branch_points
from attestry.operators.normalize import normalize, resolve_attachments
from attestry.sources import exports


def node(i, parent, children, message):
    return {"id": i, "parent": parent, "children": children, "message": message}


def said(i, role, parts, kind="text", **more):
    return {"id": i, "author": {"role": role}, "create_time": 1.5, "content": {"content_type": kind, "parts": parts}, "metadata": {}, **more}


TREE = {
    "id": "c1",
    "title": "One",
    "create_time": 10,
    "current_node": "b",
    "mapping": {
        "root": node("root", None, ["x/~y"], None),
        "x/~y": node("x/~y", "root", ["b", "a"], said("m1", "user", ["Grüße 🌱\nzwei", "{\"a\":1}"])),
        "b": node("b", "x/~y", [], said("m2", "assistant", [{"content_type": "audio_transcription", "text": "spoken"}, {"content_type": "image_asset_pointer", "name": "p.png"}, 7], "multimodal_text")),
        "a": node("a", "x/~y", [], said("m3", "robot", [], "thoughts", metadata={"attachments": [{"id": "f1", "file_name": None, "name": "n.txt"}]})),
    },
}
TALK = {
    "uuid": "k1",
    "name": "Two",
    "created_at": "2024-01-01T00:00:00Z",
    "chat_messages": [
        {"uuid": "u1", "sender": "human", "parent_message_uuid": "00000000-0000-4000-8000-000000000000", "text": "hi", "content": [{"type": "text", "text": "hi!"}, {"type": "odd"}], "attachments": [{"file_name": "q.txt", "extracted_content": "inside"}], "files": None},
        {"uuid": "u2", "sender": "assistant", "parent_message_uuid": "u1", "text": "", "content": [{"type": "thinking", "thinking": "hm"}]},
    ],
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("exports")
    (at / "folder").mkdir()
    (at / "folder" / "conversations-2.json").write_text("﻿" + json.dumps([TREE, {"id": "", "mapping": {}}], ensure_ascii=False), "utf-8")
    (at / "folder" / "other.json").write_text("[]")
    with zipfile.ZipFile(at / "c.zip", "w") as z:
        z.writestr("deep/conversations.json", json.dumps([TALK, {"uuid": "k2", "chat_messages": []}]))
        z.writestr("users.json", "[]")
    (at / "bad.json").write_text('[{"id": 1, "id": 2}]')
    (at / "s.toml").write_text('[[sources]]\nprovider="chatgpt"\npath="folder"\n[[sources]]\nprovider="claude"\npath="c.zip"\n[[sources]]\nprovider="claude"\npath="c.zip"\n[[sources]]\nprovider="chatgpt"\npath="bad.json"\n[expected]\nclaude_messages=2\n')
    sources, expected = exports.read_config(at / "s.toml")
    assert expected == {"claude_messages": 2}
    found = exports.inventory(exports.scan(spark, sources)).cache()
    assert found.count() == 3
    assert found.where("provider = 'claude'").first()["locations"][0]["member"] == "deep/conversations.json"
    return normalize(exports.conversations(found).cache())


def test_conversations_and_refusals(tables):
    rows = {r["original_id"]: r for r in tables.conversations.collect()}
    assert set(rows) == {"c1", "k1", "k2"}
    assert rows["c1"]["message_count"] == 3 and rows["k2"]["message_count"] == 0
    assert rows["k1"]["root_parent_ids"] == ["00000000-0000-4000-8000-000000000000"]
    assert rows["c1"]["current_node_id"] == "b"
    assert sorted(r["error"].split(" ")[0] for r in tables.refused.collect()) == ["an", "missing_id"]


def test_messages_keep_order_roles_and_pointers(tables):
    m = {r["original_id"]: r for r in tables.messages.collect()}
    assert [m[i]["position"] for i in ("m1", "m2", "m3")] == [1, 2, 3]
    assert m["m3"]["role"] == "unknown" and m["m3"]["role_raw"] == "robot"
    assert m["u1"]["role"] == "user" and m["u2"]["role"] == "assistant"
    assert m["m1"]["provenance"]["json_pointer"] == "/0/mapping/x~1~0y/message"
    assert m["m1"]["record_id"].startswith("message:") and len(m["m1"]["record_id"]) == 72


def test_segments(tables):
    got = tables.segments.join(tables.messages.select(F.col("record_id").alias("message_record_id"), "original_id"), "message_record_id")
    text = {(r["original_id"], r["segment_index"]): (r["text"], r["kind"]) for r in got.collect()}
    assert text == {
        ("m1", 0): ("Grüße 🌱\nzwei", "text"),
        ("m1", 1): ('{"a":1}', "text"),
        ("m2", 0): ("spoken", "transcription_text"),
        ("u1", 0): ("hi", "text"),
        ("u1", 1): ("hi!", "text"),
        ("u1", 2): ("inside", "attachment_text"),
        ("u2", 0): ("", "text"),
    }


def test_attachments_warnings_and_graph(tables):
    a = {r["attachment_kind"]: r for r in tables.attachments.collect()}
    assert a["attachment"]["filename"] in (None, "q.txt")
    found = {(r["attachment_kind"], r["filename"], r["original_id"]) for r in tables.attachments.collect()}
    # a null file_name that is there wins over name
    assert found == {("multimodal_reference", "p.png", None), ("attachment", None, "f1"), ("attachment", "q.txt", None)}
    assert sorted(r["code"] for r in tables.warnings.collect()) == ["unknown_content", "unknown_part"]
    nodes = tables.nodes.select(F.col("conversation_record_id").alias("conversation"), F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), "children_ids", "position")
    assert [r["node"] for r in branch_points(nodes).collect()] == ["x/~y"]
    assert {r["node"]: r["children_ids"] for r in nodes.collect()}["u1"] == ["u2"]


def test_attachment_resolution(spark, tables):
    source = tables.attachments.where("filename = 'q.txt'").first()["provenance"]["source_id"]
    roots = spark.createDataFrame([(source, "/r"), (source, "/s")], "source_id string, root string")
    files = spark.createDataFrame([("/r", "q.txt", "/r/q.txt")], "root string, name string, path string")
    got = {r["filename"]: r["availability"] for r in resolve_attachments(tables.attachments, roots, files).collect()}
    assert got["q.txt"] == "local_filename_match" and got["p.png"] == "unverified_reference"
    files = files.unionByName(spark.createDataFrame([("/s", "q.txt", "/s/q.txt")], files.schema))
    got = {r["filename"]: r["availability"] for r in resolve_attachments(tables.attachments, roots, files).collect()}
    assert got["q.txt"] == "ambiguous_candidates"


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', "[NaN]", "[1e999]", "[-Infinity]", b"\xff[]", "[", ""])
def test_strict_json_refuses(text):
    with pytest.raises(StrictJsonError):
        strict_json(text)
