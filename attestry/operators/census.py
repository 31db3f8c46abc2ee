"""The source read anew: what every derived record must say, told from the export's JSON without the adapters.

Plain Python over one conversation at a time, on purpose: normalize.py projects in the JVM, and two ways that share no
code can prove each other. A value becomes the text that the derived tables hold: a string as it is, null as null, any
other value as its JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attestry.functions.batches import slices
from attestry.functions.identity import StrictJsonError, canonical, strict_json

#: Fixed values of the export formats.
ROLES = {"chatgpt": {r: r for r in ("user", "assistant", "system", "tool")}, "claude": {"human": "user", "assistant": "assistant"}}
KNOWN = {"chatgpt": {"text", "multimodal_text", "thoughts", "reasoning_recap"}, "claude": {"text", "thinking", "tool_use", "tool_result", "token_budget", "flag"}}
MEDIA = {"image_asset_pointer", "audio_asset_pointer", "real_time_user_audio_video_asset_pointer"}
FIELDS = {
    "chatgpt": {"title": "title", "created_at_raw": "create_time", "updated_at_raw": "update_time", "list": "mapping"},
    "claude": {"title": "name", "created_at_raw": "created_at", "updated_at_raw": "updated_at", "list": "chat_messages"},
}
CLAUDE_ROOT = "00000000-0000-4000-8000-000000000000"

SCHEMA = "kind string, source_id string, provider string, sha256 string, conversation_pointer string, message_pointer string, json_pointer string, values map<string,string>"


def text_of(value) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False)


def _even(value):
    """Whole floats as whole numbers, so that 10.0 and 10 are one value."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53:
        return int(value)
    if isinstance(value, dict):
        return {k: _even(v) for k, v in value.items()}
    return [_even(v) for v in value] if isinstance(value, list) else value


def same_json(value) -> str:
    """One spelling for equal JSON values."""
    return canonical(_even(value), ascii_only=True)


@F.pandas_udf(StringType())
def json_key(texts):
    """A column's JSON texts in the spelling of same_json(); null for what isn't JSON."""

    def one(t):
        try:
            return same_json(strict_json(t)) if isinstance(t, str) else None
        except StrictJsonError:
            return None

    return texts.map(one)


def _token(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


class Shape(ValueError):
    """A conversation that isn't of its provider's form."""


def _is(value, kind, what: str):
    if not isinstance(value, kind):
        raise Shape(what)
    return value


def read_conversation(provider: str, value, pointer: str) -> Iterator[tuple[str, str | None, str, dict]]:
    """(kind, message pointer, pointer, values) of the conversation and of its nodes, messages, segments, attachments and
    warnings, in the export's order."""
    _is(value, dict, "not_an_object")
    names = FIELDS[provider]
    own_id = (value.get("id") or value.get("conversation_id")) if provider == "chatgpt" else value.get("uuid")
    if not isinstance(own_id, str) or not own_id:
        raise Shape("missing_id")
    listed = value.get(names["list"])
    _is(listed, dict if provider == "chatgpt" else list, f"{names['list']}_missing")
    if provider == "chatgpt":
        places = [(f"{pointer}/mapping/{_token(k)}/message", k, _is(n, dict, "bad_node")) for k, n in listed.items()]
        nodes = [(p, k, n.get("parent"), n.get("children"), {x: y for x, y in n.items() if x != "message"}, n.get("message")) for p, k, n in places]
        roots: list = []
    else:
        places = [(f"{pointer}/chat_messages/{i}", m) for i, m in enumerate(listed)]
        parents = [_is(m, dict, "bad_message").get("parent_message_uuid") for m in listed]
        under: dict = {}
        for m, p in zip(listed, parents, strict=True):
            under.setdefault(p, []).append(m.get("uuid"))
        nodes = [(p, m.get("uuid"), m.get("parent_message_uuid"), under.get(m.get("uuid"), []), {}, m) for p, m in places]
        roots = [CLAUDE_ROOT] if CLAUDE_ROOT in parents else []
    yield "conversation", None, pointer, {
        "original_id": own_id, "title": text_of(value.get(names["title"])), "created_at_raw": text_of(value.get(names["created_at_raw"])), "updated_at_raw": text_of(value.get(names["updated_at_raw"])),
        "current_node_id": text_of(value.get("current_node")) if provider == "chatgpt" else None, "root_parent_ids": json.dumps(roots),
        "raw_metadata": same_json({k: v for k, v in value.items() if k != names["list"]}), "message_count": str(sum(n[5] is not None for n in nodes)),
    }
    for position, (at, name, parent, children, fields, message) in enumerate(nodes):
        yield "node", at if message is not None else None, f"{pointer}#{position}", {
            "node_id": text_of(name), "parent_id": text_of(parent), "position": str(position), "node_fields": same_json(fields),
            "children_ids": None if children is None else json.dumps([text_of(c) for c in children]),
        }
        if message is not None:
            yield from _message(provider, _is(message, dict, "bad_message"), at, own_id, text_of(name), text_of(parent), position)


def _message(provider: str, m: dict, at: str, conversation: str, node: str | None, parent: str | None, position: int):
    names = FIELDS[provider]
    author = _is(m.get("author", {}), dict, "bad_author") if provider == "chatgpt" else {"role": m.get("sender")}
    role = author.get("role")
    content = m.get("content")
    kind = (content.get("content_type") if isinstance(content, dict) else None) if provider == "chatgpt" else "blocks"
    segments: list[tuple[str, str, str]] = []
    attached: list[tuple[str, object, str]] = []
    warned: list[str] = []
    if provider == "chatgpt":
        warned += ["unknown_content"] * (kind not in KNOWN["chatgpt"])
        parts = content.get("parts", []) if kind in ("text", "multimodal_text") else []
        for i, part in enumerate(_is(parts, list, "bad_parts")):
            place = f"{at}/content/parts/{i}"
            if isinstance(part, str):
                segments.append((place, part, "text"))
            elif not isinstance(part, dict):
                warned.append("unknown_part")
            elif part.get("content_type") == "audio_transcription" and isinstance(part.get("text"), str):
                segments.append((f"{place}/text", part["text"], "transcription_text"))
            else:
                attached.append((place, part, "multimodal_reference"))
                warned += ["unknown_multimodal_content"] * (part.get("content_type") not in MEDIA)
        listed = _is(m.get("metadata", {}), dict, "bad_metadata").get("attachments") or []
        attached += [(f"{at}/metadata/attachments/{i}", a, "attachment") for i, a in enumerate(_is(listed, list, "bad_attachments"))]
    else:
        if isinstance(m.get("text"), str):
            segments.append((f"{at}/text", m["text"], "text"))
        for i, block in enumerate(_is(content or [], list, "bad_content")):
            block_kind = block.get("type") if isinstance(block, dict) else None
            warned += ["unknown_content"] * (block_kind not in KNOWN["claude"])
            if block_kind == "text" and isinstance(block.get("text"), str):
                segments.append((f"{at}/content/{i}/text", block["text"], "text"))
        for field, reference in (("attachments", "attachment"), ("files", "file_reference")):
            for i, a in enumerate(_is(m.get(field) or [], list, "bad_attachments")):
                attached.append((f"{at}/{field}/{i}", a, reference))
                if isinstance(a, dict) and isinstance(a.get("extracted_content"), str):
                    segments.append((f"{at}/{field}/{i}/extracted_content", a["extracted_content"], "attachment_text"))
    known = ROLES[provider].get(role, "unknown") if isinstance(role, str) else "unknown"
    warned += ["unknown_role"] * (known == "unknown")
    yield "message", at, at, {
        "conversation_original_id": conversation, "original_id": text_of(m.get("id" if provider == "chatgpt" else "uuid")), "node_id": node, "parent_id": parent, "position": str(position),
        "role": known, "role_raw": text_of(role), "created_at_raw": text_of(m.get(names["created_at_raw"])), "updated_at_raw": text_of(m.get(names["updated_at_raw"])),
        "content_kind": text_of(kind), "raw": same_json(m), "segments": json.dumps(segments, ensure_ascii=False),
        "no_text": str(not any(t for _, t, k in segments if k != "attachment_text")).lower(),
        "text_differs": str(provider == "claude" and isinstance(m.get("text"), str) and m["text"] != "".join(t for p, t, k in segments if p.startswith(f"{at}/content/"))).lower(),
    }
    for index, (place, text, segment) in enumerate(segments):
        yield "segment", at, place, {"segment_index": str(index), "text": text, "kind": segment}
    for place, raw, reference in attached:
        o = raw if isinstance(raw, dict) else {}
        first = lambda *keys: text_of(next((o[k] for k in keys if k in o), None))  # noqa: B023, E731
        yield "attachment", at, place, {"attachment_kind": reference, "raw": same_json(raw), "filename": first("file_name", "name"), "original_id": first("file_id", "file_uuid", "id")}  # noqa: B023
    for i, code in enumerate(warned):
        yield "warning", at, f"{at}#{i}", {"code": code}


def census(raw: DataFrame) -> DataFrame:
    """Rows of SCHEMA for rows of sources.exports.conversations(). A conversation that its adapter refuses, and a payload
    that isn't JSON, give one row of kind ``refused`` with the reason as ``error``. An empty table gives no rows."""
    columns = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    kinds = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for source, provider, sha, index, text, error in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                pointer = None if index is None else f"/{index}"
                head = (source, provider, sha, pointer)
                try:
                    if error is not None:
                        raise Shape(error)
                    found = [(kind, *head, at, place, list(values.items())) for kind, at, place, values in read_conversation(provider, strict_json(text), pointer)]
                except (Shape, StrictJsonError) as e:
                    found = [("refused", *head, None, pointer, [("error", str(e))])]
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    return raw.select("source_id", "provider", "sha256", "index", "conversation", "error").mapInArrow(run, SCHEMA)
