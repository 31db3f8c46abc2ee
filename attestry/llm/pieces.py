"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a model goes on past a white-space marker, a text's segmentation is that of its marked words (a run of
markers and what follows it), one after the other. Tasks cut texts into marked words and number the distinct ones of a
block of texts; the numbers at each position stay with the block. Each distinct word goes to the bucket of its hash, once
for each block that has it, and is segmented there once; the ids come back to the blocks, where positions pick them.

A block's words and positions are packed and compressed, so that what is shuffled is a part of the text. For a model that
can't be proved to work like that a text is one chunk: then equal texts are segmented once.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import materialise_by

#: Characters of a block of texts; a longer text is a block of its own.
BLOCK_CHARS = 10_000_000
#: Ids that positions pick at once.
PICKED = 250_000

MARK = "▁"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")
_CODEC = pa.Codec("zstd", 3)


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte by byte: all lowest bytes first."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return _CODEC.compress(planes.tobytes(), asbytes=True)


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_CODEC.decompress(data, 4 * n, asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Model:
    """A sentencepiece model and whether its pieces keep within marked words."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.lib.get_piece_size())
        within = all(MARK not in self.lib.id_to_piece(i).lstrip(MARK) for i in ids)
        spelled = any(self.lib.is_byte(i) for i in ids)
        marks = {" a  b ": f"{MARK}{MARK}a{MARK}{MARK}b{MARK}", MARK: MARK * 2, "\n": f"{MARK}\n", "": ""}
        self.by_word = within and spelled and all(self.lib.normalize(k) == v for k, v in marks.items())
        self.ends = [[i] if i >= 0 else [] for i in (self.lib.bos_id(), self.lib.eos_id())]

    def chunks(self, text: str) -> list[str]:
        if not self.by_word:
            return [text] if text else []
        return _MARKED.findall(self.lib.normalize(text))

    def segment(self, chunks: list[str]) -> list[list[int]]:
        if not self.by_word:
            return self.lib.encode(chunks, num_threads=1)
        # the library puts the first marker there itself
        plain = [c[1:].replace(MARK, " ") for c in chunks]
        for i, (chunk, back) in enumerate(zip(chunks, self.lib.normalize(plain), strict=True)):
            if chunk != back and plain[i]:
                raise ValueError(f"the model normalizes {plain[i]!r} in another way when it stands alone")
        out = self.lib.encode(plain, num_threads=1)
        mark = self.lib.piece_to_id(MARK)
        return [x if plain[i] else [mark] for i, x in enumerate(out)]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _strings(values: list[str]) -> bytes:
    """Texts as one compressed value, to be read by _listed()."""
    array = pa.array(values, pa.large_string())
    offsets, data = array.buffers()[1:]
    body = b"" if data is None else data.to_pybytes()
    size = np.diff(np.frombuffer(offsets, dtype=np.int64)[: len(values) + 1])
    head = squeeze(size)
    return len(head).to_bytes(4, "little") + len(body).to_bytes(8, "little") + head + (_CODEC.compress(body, asbytes=True) if body else b"")


def _listed(packed: bytes, n: int) -> list[str]:
    head, size = int.from_bytes(packed[:4], "little"), int.from_bytes(packed[4:12], "little")
    offsets = np.concatenate(([0], np.cumsum(unsqueeze(packed[12 : 12 + head], n).astype(np.int64))))
    body = _CODEC.decompress(packed[12 + head :], size, asbytes=True) if size else b""
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(body)).to_pylist()


class _Block:
    def __init__(self):
        self.docs, self.counts, self.at, self.chars = [], [], [], 0
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__

    def add(self, doc: pa.Array, text: str, own: Model) -> None:
        chunks = own.chunks(text)
        self.at.append(np.fromiter(map(self.number.__getitem__, chunks), dtype=np.uint32, count=len(chunks)))
        self.docs.append(doc)
        self.counts.append(len(chunks))
        self.chars += len(text)

    def rows(self, block: int, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        words = list(self.number)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), dtype=np.uint32, count=len(words))
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        parts = [order[a:b] for a, b in zip(first, np.append(first[1:], len(order)), strict=True)]
        n = len(parts)
        docs = pa.concat_arrays(self.docs)
        columns = {
            "block": pa.array(np.full(n + 1, block)),
            "bucket": pa.array([None, *found.tolist()], pa.int32()),
            "docs": pa.ListArray.from_arrays(pa.array([0, *[len(docs)] * (n + 1)], pa.int32()), docs),
            "counts": pa.array([self.counts, *[None] * n], pa.list_(pa.int32())),
            "buckets": pa.array([squeeze(bucket), *[None] * n], pa.binary()),
            "n": pa.array([len(words), *map(len, parts)], pa.int32()),
            "packed": pa.array([squeeze(np.concatenate(self.at)), *[_strings([words[i] for i in p]) for p in parts]], pa.binary()),
        }
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, buckets: int, limit: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    own, block, name = model(path), _Block(), TaskContext.get().partitionId() << 32
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or ""
            if block.docs and block.chars + len(text) > limit:
                yield from block.rows(name, buckets, schema)
                block, name = _Block(), name + 1
            block.add(batch.column(0).slice(i, 1), text, own)
    if block.docs:
        yield from block.rows(name, buckets, schema)


def _segmented(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """For rows of one bucket after the other the ids of their chunks. A bucket's chunks are remembered until it ends."""
    own, bucket, known = model(path), None, {}
    for batch in batches:
        for block, now, n, packed in zip(*[batch.column(c).to_pylist() for c in ("block", "bucket", "n", "packed")], strict=True):
            if now != bucket:
                bucket, known = now, {}
            chunks = _listed(packed, n)
            new = [c for c in chunks if c not in known]
            known.update(zip(new, [np.array(x, dtype="<u4").tobytes() for x in own.segment(new)] if new else [], strict=True))
            ids = [known[c] for c in chunks]
            size = np.fromiter(map(len, ids), dtype=np.int64, count=n) // 4
            head = squeeze(size)
            body = squeeze(np.frombuffer(b"".join(ids), dtype="<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([n], pa.int32()), pa.array([int(size.sum())]), pa.array([head]), pa.array([body])], names=["block", "bucket", "n", "n_ids", "sizes", "ids"])


def _gather(values: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[first[i] : first[i] + size[i]] for each i of ``at``, joined."""
    own = size[at]
    begin = np.cumsum(own) - own
    return values[np.repeat(first[at] - begin, own) + np.arange(int(own.sum()))]


def _joined(left: pa.Table, right: pa.Table, path: str, schema: pa.Schema) -> pa.Table:
    """The texts of a block: ids picked by position, and what the library makes of them."""
    own = model(path)
    (row,) = left.select(["counts", "buckets", "n", "packed"]).to_pylist()
    counts, n = np.array(row["counts"], dtype=np.int64), row["n"]
    docs = left.column("docs").combine_chunks().flatten()
    at = unsqueeze(row["packed"], int(counts.sum()))
    order = np.argsort(unsqueeze(row["buckets"], n), kind="stable")
    parts = sorted(right.to_pylist(), key=lambda r: r["bucket"])
    none = np.zeros(0, dtype="<u4")
    size = np.concatenate([unsqueeze(p["sizes"], p["n"]) for p in parts] or [none]).astype(np.int64)
    values = np.concatenate([unsqueeze(p["ids"], p["n_ids"]) for p in parts] or [none])
    if len(size) != n:
        raise ValueError("a block's chunks didn't all come back")
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    first = np.cumsum(size) - size
    at = place[at]
    end = np.cumsum(counts)
    out, doc = [], 0
    while doc < len(counts):
        # as many texts as have about PICKED chunks, one at least
        stop = max(doc + 1, int(np.searchsorted(end, end[doc] - counts[doc] + PICKED, side="right")))
        here = at[end[doc] - counts[doc] : end[stop - 1]]
        ids = _gather(values, first, size, here)
        cuts = np.concatenate(([0], np.cumsum(size[here])))[np.concatenate(([0], np.cumsum(counts[doc:stop])))]
        lists = [own.ends[0] + ids[a:b].tolist() + own.ends[1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = [docs.slice(doc, stop - doc), pa.array([np.array(x, dtype="<u4").tobytes() for x in lists], pa.binary()), pa.array(own.lib.decode(lists), pa.string())]
        out.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
        doc = stop
    return pa.Table.from_batches(out, schema)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: the id, ``ids`` (the model's ids with begin and end ids, as little-endian unsigned 32-bit
    integers) and ``decoded``, what the library decodes them to.

    A null text is an empty one, which has the begin and the end id alone. Null and repeated ids are rows like others;
    a text of any length is encoded whole (its block holds it alone, at about 15 bytes a character). An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = dict(own.dtypes)["doc"]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ddl = f"block bigint, bucket int, docs array<{kind}>, counts array<int>, buckets binary, n int, packed binary"
    out_ddl = f"doc {kind}, ids binary, decoded string"
    schema, out_schema = (to_arrow_schema(_parse_datatype_string(d)) for d in (ddl, out_ddl))
    table = materialise_by(own.mapInArrow(lambda b: _blocks(b, path, buckets, block_chars, schema), ddl), "block", buckets)
    words = table.where("bucket is not null").select("block", "bucket", "n", "packed").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    segmented = words.mapInArrow(lambda b: _segmented(b, path), "block bigint, bucket int, n int, n_ids bigint, sizes binary, ids binary")
    blocks = table.where("bucket is null").select("block", "docs", "counts", "buckets", "n", "packed")
    both = blocks.groupBy("block").cogroup(segmented.groupBy("block")).applyInArrow(lambda a, b: _joined(a, b, path, out_schema), out_ddl)
    return both.select(F.col("doc").alias(id_col), "ids", "decoded")
