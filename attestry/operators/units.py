"""What a reviewer reads of a message: its exported text segments, and placeholders for content that isn't text."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestry.functions.batches import slices
from attestry.functions.identity import strict_json

#: Kinds of content that stand for an assistant's inner work.
INNER_KINDS, INNER_BLOCKS = ("thoughts", "reasoning_recap"), ("thinking", "token_budget", "flag")
INTERNAL, MEDIA, UNPROJECTED = "internal_assistant_content", "multimodal_or_unrecognized_content", "unprojected_content"


def shown(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def placeholders(provider: str, role: str, kind: str | None, content, pointer: str) -> list[tuple[int, str, str, str]]:
    """(segment index, pointer, kind, text) of the content that no segment has; the indices are negative: -2 - the place
    of a part or block, -1 for the whole content."""
    out = []
    if provider == "chatgpt" and isinstance(content, dict) and kind in ("text", "multimodal_text"):
        for i, part in enumerate(content.get("parts", [])):
            spoken = isinstance(part, dict) and part.get("content_type") == "audio_transcription" and isinstance(part.get("text"), str)
            if not (isinstance(part, str) or spoken):
                out.append((-2 - i, f"{pointer}/parts/{i}", MEDIA, shown(part)))
    elif provider == "claude" and isinstance(content, list):
        for i, block in enumerate(content):
            of = block.get("type") if isinstance(block, dict) else None
            if of == "text" and isinstance(block.get("text"), str):
                continue
            out.append((-2 - i, f"{pointer}/{i}", INTERNAL, "") if of in INNER_BLOCKS else (-2 - i, f"{pointer}/{i}", UNPROJECTED, shown(block)))
    return out


def units_of(provider: str, role: str, kind: str | None, raw: str, pointer: str, segments: list[tuple[int, str, str, str]]) -> list[tuple[int, str, str, str]]:
    """All of a message's units in reading order; a message always has one. An assistant's inner work is one empty unit
    in place of its segments."""
    at = f"{pointer}/content"
    if role == "assistant" and kind in INNER_KINDS:
        return [(-1, at, INTERNAL, "")]
    content = strict_json(raw).get("content")
    return [*segments, *placeholders(provider, role, kind, content, at)] or [(-1, at, UNPROJECTED, shown(content))]


def units(messages: DataFrame, segments: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Rows (message_record_id, unit, segment_index, json_pointer, kind, text): ``unit`` orders a message's units from 0.
    Both are normalize's tables; a message without segments still has a unit. ``more`` names columns of the messages that
    their units have, too, so that no join has to bring them to the texts."""
    own = segments.groupBy("message_record_id").agg(F.array_sort(F.collect_list(F.struct(F.col("segment_index").cast("int").alias("i"), "json_pointer", "kind", "text"))).alias("own"))
    read = ["provider", "role", "content_kind", "raw", "at", "own"]
    along = [c for c in more if c not in read]
    joined = messages.withColumns({"message_record_id": F.col("record_id"), "at": F.col("provenance.json_pointer")}).select("message_record_id", *read[:-1], *along).join(own, "message_record_id", "left")
    kinds = {"unit": pa.int32(), "segment_index": pa.int32(), "json_pointer": pa.string(), "kind": pa.string(), "text": pa.string()}
    made = StructType.fromDDL("unit int, segment_index int, json_pointer string, kind string, text string")
    kept = ["message_record_id", *more]
    out = StructType([*[joined.schema[c] for c in kept], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, of = [], []
            for n, r in enumerate(batch.select(read).to_pylist()):
                listed = [(s["i"], s["json_pointer"], s["kind"], s["text"]) for s in r["own"] or []]
                found = units_of(r["provider"], r["role"], r["content_kind"], r["raw"], r["at"], listed)
                rows += [(i, *u) for i, u in enumerate(found)]
                of += [n] * len(found)
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            theirs = batch.select(kept).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*theirs.columns, *[pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]], names=[*kept, *kinds])

    return joined.mapInArrow(run, out)
