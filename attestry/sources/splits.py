"""One large payload over many tasks: a structural scan of its splits, and its conversations described on their own.

Where a split begins it isn't known whether that is inside a string, behind a backslash, or how deep. Each split is scanned
for every state that it may begin in, and says in which it ends and by how much the depth changes; folding that from the
first split on gives each its true state. With it, a split finds the marks that separate the elements of the outer array,
and cuts itself there. The pieces of an element come together in one task, which describes it like describe() does. Bases
of its character offsets are sums over narrow rows; those of bytes are the places of the marks.

What isn't an array of valid elements is left without a description. Nothing here decides why.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.identity import StrictJsonError, canonical, strict_json
from attestry.operators.rounds import written

#: Bytes of a split; smaller payloads aren't taken apart.
SPLIT = 4 << 20
#: What a split may begin (and end) in: outside strings, inside one, inside one behind a backslash.
OUT, IN, ESCAPED = 0, 1, 2
_OPEN, _CLOSE = np.isin(np.arange(256), [ord("["), ord("{")]), np.isin(np.arange(256), [ord("]"), ord("}")])
_BLANK = b" \t\r\n"


def _structure(raw: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """For each byte +1, -1 or 0, the change of depth outside strings (2 for a comma there), and the state at the end."""
    slash = raw == ord("\\")
    # a backslash counts if an even number of them stand right before it; a run begins anew behind an escaped byte
    at = np.arange(len(raw))
    last_other = np.maximum.accumulate(np.where(slash, -1, at))
    place = at - last_other - 1
    first = state == ESCAPED
    if first:
        # the run that begins the split, if any, has its first byte escaped
        place = np.where(last_other < 0, place - 1, place)
    escaping = slash & (place % 2 == 0) & (place >= 0)
    escaped = np.concatenate(([first], escaping[:-1]))
    quote = (raw == ord('"')) & ~escaped
    inside = (np.cumsum(quote) - quote + (state != OUT)) % 2 == 1
    open_ = bool((int(quote.sum()) + (state != OUT)) % 2)
    out = np.where(inside | quote, 0, _OPEN[raw].astype(np.int8) - _CLOSE[raw])
    out[(raw == ord(",")) & ~inside] = 2
    return out, (ESCAPED if len(raw) and escaping[-1] else IN) if open_ else OUT


def transitions(raw: bytes) -> list[int]:
    """For each state at a split's begin the state at its end and the change of depth, flat."""
    data, out = np.frombuffer(raw, dtype=np.uint8), []
    for state in (OUT, IN, ESCAPED):
        change, end = _structure(data, state)
        out += [end, int(change[change != 2].sum())]
    return out


def marks(raw: bytes, state: int, depth: int) -> list[int]:
    """Offsets of the outer array's brackets and of the commas between its elements."""
    data = np.frombuffer(raw, dtype=np.uint8)
    change, _ = _structure(data, state)
    step = np.where(change == 2, 0, change)
    after = depth + np.cumsum(step)
    comma = (change == 2) & (after == 1)
    return np.flatnonzero(comma | ((step == 1) & (after == 1)) | ((step == -1) & (after == 0))).tolist()


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [transitions(x) for x in b.column("bytes").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("payload_sha256"), b.column("k"), pa.array(found, pa.list_(pa.int64()))], names=["payload_sha256", "k", "ends"])


def _cut(batches: Iterator[pa.RecordBatch], split: int) -> Iterator[pa.RecordBatch]:
    """A split's pieces: ``mark`` is the payload's offset of the mark before, null for what goes on from the split before."""
    for b in batches:
        for sha, k, data, state, depth in zip(*[b.column(c).to_pylist() for c in ("payload_sha256", "k", "bytes", "state", "depth")], strict=True):
            at = marks(data, state, depth)
            ends = [*at, len(data)]
            mark = [None, *[k * split + a for a in at]]
            sign = [None, *[chr(data[a]) for a in at]]
            pieces = [data[a:b] for a, b in zip([0, *[x + 1 for x in at]], ends, strict=True)]
            chars = [sum((np.frombuffer(p, dtype=np.uint8) & 0xC0) != 0x80) for p in pieces]
            n = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array([sha] * n), pa.array([k] * n, pa.int32()), pa.array(mark, pa.int64()), pa.array(sign, pa.string()), pa.array([int(c) for c in chars], pa.int64()), pa.array(pieces, pa.binary())],
                names=["payload_sha256", "k", "mark", "sign", "chars", "piece"],
            )


def _element(index: int, data: bytes, char_base: int, byte_base: int) -> dict:
    """An element's description and its parts, with the blanks around it."""
    from attestry.sources import raw_store

    text = data.decode("utf-8")
    value = strict_json(text)
    local = {path: (a, b) for path, a, b in raw_store.value_spans(text, 0, 3)}
    mapping = value.get("mapping") if isinstance(value, dict) else None
    real = lambda p: p[:1] != ("mapping",) or len(p) < 2 or (isinstance(mapping, dict) and (len(p) < 3 or isinstance(mapping.get(p[1]), dict)))
    spans = {(index, *p): s for p, s in local.items() if real(p)}
    points = sorted({p for span in raw_store._cut_paths(spans) for p in span})
    place = raw_store._bytes_at(text, sorted({*points, *(x for s in spans.values() for x in s)}))
    chars = lambda p: [char_base + x for x in spans[p]] if p in spans else None
    spot = lambda p: [byte_base + place[x] for x in spans[p]] if p in spans else None
    found = raw_store.described_conversation(index, value, chars, spot)
    ends = [place[p] for p in points]
    parts = [data[a:b] for a, b in zip(ends, ends[1:], strict=False) if b > a]
    return {"json": canonical(found, ascii_only=True), "parts": [_part(p) for p in parts], "lead": data[: ends[0]], "trail": data[ends[-1] :]}


def _part(data: bytes) -> str:
    return canonical({"sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)}, ascii_only=True)


ELEMENT = "payload_sha256 string, number int, sign string, lead binary, trail binary, json string, parts array<string>, odd boolean"


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, those of an element one after the other, to a row for each element. Blanks alone have no JSON."""
    held: list[bytes] = []
    of = None

    def row() -> pa.RecordBatch:
        data, found, odd = b"".join(held), {"json": None, "parts": None, "lead": b"", "trail": None}, False
        if data.strip(_BLANK) and of["number"] > 0:
            try:
                found = _element(of["number"] - 1, data, of["char_base"], of["mark"] + 1)
            except (StrictJsonError, UnicodeDecodeError, ValueError):
                odd = True
        else:
            found["lead"] = data
        own = {"payload_sha256": of["payload_sha256"], "number": of["number"], "sign": of["sign"], "odd": odd} | found
        kinds = {"number": pa.int32(), "lead": pa.binary(), "trail": pa.binary(), "parts": pa.list_(pa.string()), "odd": pa.bool_()}
        names = [c.split()[0] for c in ELEMENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([own[n]], kinds.get(n, pa.string())) for n in names], names=names)

    for b in batches:
        for r in b.to_pylist():
            if of is not None and (r["payload_sha256"], r["number"]) != (of["payload_sha256"], of["number"]):
                yield row()
                held.clear()
            if not held:
                of = r
            held.append(r["piece"])
    if of is not None:
        yield row()


def _joined(payload: str, size: int, rows: list[dict]) -> str | None:
    """The payload's description from its elements' in order; None where they aren't an array's."""
    head, *rest = rows
    signs = [r["sign"] for r in rest]
    blank = head["lead"].removeprefix(codecs.BOM_UTF8).strip(_BLANK) == b""
    if len(rest) < 2 or signs != ["[", *[","] * (len(rest) - 2), "]"] or any(r["odd"] for r in rows) or not blank or rest[-1]["json"] is not None:
        return None
    elements = rest[:-1]
    empty = len(elements) == 1 and elements[0]["json"] is None
    if not empty and any(r["json"] is None for r in elements):
        return None
    parts, glue = [], head["lead"]
    for r in rest:
        glue += r["sign"].encode() + r["lead"]
        if r["json"] is not None:
            parts += [_part(glue), *r["parts"]]
            glue = r["trail"]
    parts += [_part(glue)] * bool(glue)
    found = ",".join(r["json"] for r in elements if r["json"] is not None)
    return f'{{"bytes":{size},"conversations":[{found}],"parts":[{",".join(parts)}],"sha256":{json.dumps(payload)}}}'


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            (r,) = b.slice(i, 1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["payload_sha256"]]), pa.array([_joined(r["sha256"], r["size"], r["rows"])], pa.string())], names=["payload_sha256", "description"])


def described(payloads: DataFrame, split: int = SPLIT) -> DataFrame:
    """Rows (payload_sha256, description) for payloads (payload_sha256, content) without nulls: the text that
    canonical(describe(content)) gives, null for what isn't an array of conversations. The same for any ``split``."""
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("content") / split) - 1, F.lit(0))).cast("array<int>"))
    sized = payloads.select("payload_sha256", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    parts = sized.select("payload_sha256", "size", "sha256", "content", k.alias("k")).select("payload_sha256", "size", "sha256", "k", F.substring("content", F.col("k") * split + 1, F.lit(split)).alias("bytes"))
    parts = written(parts.repartition("payload_sha256", "k"))
    ends = written(parts.select("payload_sha256", "k", "bytes").mapInArrow(_scanned, "payload_sha256 string, k int, ends array<bigint>"))
    # a payload has few splits: the fold goes over a row of three pairs for each
    order = Window.partitionBy("payload_sha256").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.struct(F.lit(OUT).cast("long").alias("state"), F.lit(0).cast("long").alias("depth"))
    fold = F.aggregate(F.collect_list("ends").over(order), start, lambda s, e: F.struct(F.element_at(e, (2 * s["state"] + 1).cast("int")).alias("state"), (s["depth"] + F.element_at(e, (2 * s["state"] + 2).cast("int"))).alias("depth")))
    states = ends.select("payload_sha256", "k", fold.alias("s")).select("payload_sha256", "k", "s.state", "s.depth")
    cut = parts.join(states, ["payload_sha256", "k"]).mapInArrow(lambda b: _cut(b, split), "payload_sha256 string, k int, mark bigint, sign string, chars bigint, piece binary")
    cut = written(cut)
    # a piece that goes on belongs to the last mark of the splits before; the first piece of all to none
    last = cut.groupBy("payload_sha256", "k").agg(F.max("mark").alias("last"))
    before = last.select("payload_sha256", "k", F.max("last").over(order).alias("before"))
    owned = cut.join(before, ["payload_sha256", "k"]).withColumn("mark", F.coalesce("mark", "before", F.lit(-1))).drop("before")
    narrow = owned.groupBy("payload_sha256", "mark").agg(F.sum("chars").alias("chars"), F.max("sign").alias("sign"))
    along = Window.partitionBy("payload_sha256").orderBy("mark")
    placed = narrow.select(
        "payload_sha256", "mark", "sign", (F.row_number().over(along) - 1).alias("number"),
        (F.coalesce(F.sum("chars").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.row_number().over(along) - 1).alias("char_base"),
    )
    pieces = owned.drop("sign", "chars").join(placed, ["payload_sha256", "mark"]).repartition("payload_sha256", "number").sortWithinPartitions("payload_sha256", "number", "k")
    elements = written(pieces.mapInArrow(_elements, ELEMENT))
    listed = elements.groupBy("payload_sha256").agg(F.array_sort(F.collect_list(F.struct("number", "sign", "lead", "trail", "json", "parts", "odd"))).alias("rows"))
    sizes = parts.groupBy("payload_sha256").agg(F.max("size").alias("size"), F.max("sha256").alias("sha256"))
    return listed.join(sizes, "payload_sha256").mapInArrow(_assembled, "payload_sha256 string, description string")
