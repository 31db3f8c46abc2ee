"""Context-triggered piecewise hashing of whole texts.

A rolling hash over seven bytes ends a chunk wherever its last k bits are zero, so chunks depend on the text near them
only and the boundaries at 2**(k + 1) are among those at 2**k. Each chunk's hash gives one of 64 characters; the
signatures at the block sizes 2**k and 2**(k + 1) make the fingerprint ``2**k:signature:signature``. Fingerprints are
compared by edit distance where their block sizes agree, at the same size or one doubling apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestry.llm import textscan

ROLL = 7
#: A signature at the smaller block size has about 32 to 64 characters and these at most.
MOST, FEWEST = 160, 24
#: Code points of a text that order the rows of one id.
HEAD = 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)


def _signature(ends: np.ndarray, prefix: np.ndarray, down: np.ndarray, a: int, b: int) -> bytes:
    """Characters of the chunks of bytes a:b that end at ``ends`` and at b; more than three alike in a row count as three."""
    if a == b:
        return b""
    stop = ends if len(ends) and ends[-1] == b else np.append(ends, b)
    start = np.concatenate(([a], stop[:-1]))
    value = textscan.mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64))
    codes = (value >> np.uint64(58)).astype(np.int64)
    if len(codes) > 3:
        same = np.ones(len(codes), dtype=bool)
        same[:3] = False
        for d in (1, 2, 3):
            same[3:] &= codes[3:] == codes[3 - d : len(codes) - d]
        codes = codes[~same]
    return ALPHABET[codes].tobytes()


def fingerprints(texts: list[str | None]) -> list[str]:
    """A fingerprint for each text; null counts as empty. Equal texts have equal ones."""
    out: list[str] = []
    for part in textscan.chunks(texts):
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts[part]]
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        up, down = textscan._powers(textscan._R, len(raw) + 1)
        prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(textscan._BYTE[raw] * up[: len(raw)], out=prefix[1:])
        at = 0
        for d in data:
            out.append(_one(prefix, down, at, at + len(d)))
            at += len(d)
    return out


def _one(prefix: np.ndarray, down: np.ndarray, a: int, b: int) -> str:
    n = b - a
    # hash of the ROLL bytes that end at each place, fewer at the text's start
    end = np.arange(a + 1, b + 1)
    begin = np.maximum(end - ROLL, a)
    rolled = textscan.mix((prefix[end] - prefix[begin]) * down[begin])
    top = max(1, int(n).bit_length())
    zeros = np.uint64((1 << top) - 1)
    low = rolled & zeros
    counts = [n] + [int(np.count_nonzero((low & np.uint64((1 << k) - 1)) == 0)) for k in range(1, top + 1)]
    k = max(0, int(np.ceil(np.log2(max(n, 1) / 64))))
    while k > 0 and counts[k] < FEWEST and counts[k - 1] <= MOST:
        k -= 1
    while True:
        first, second = (
            _signature(end[(low & np.uint64((1 << j) - 1)) == 0], prefix, down, a, b).decode() for j in (k, k + 1)
        )
        if len(first) <= MOST or k >= top:
            return f"{1 << k}:{first}:{second}"
        k += 1


def _alike(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, 0 for block sizes more than one doubling apart."""
    pa_, pb = F.split(a, ":"), F.split(b, ":")
    size_a, size_b = pa_[0].cast("long"), pb[0].cast("long")
    return (
        F.when(a == b, F.lit(1.0))
        .when(size_a == size_b, F.greatest(_alike(pa_[1], pb[1]), _alike(pa_[2], pb[2])))
        .when(size_a == 2 * size_b, _alike(pa_[1], pb[2]))
        .when(size_b == 2 * size_a, _alike(pa_[2], pb[1]))
        .otherwise(F.lit(0.0))
    )


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each row's text as ``out_col`` (replacing a column of that name); needs no shuffle."""

    @F.pandas_udf("string")
    def prints(texts):
        import pandas as pd

        return pd.Series(fingerprints([t if isinstance(t, str) else None for t in texts]))

    return docs.withColumn(out_col, prints(F.col(text_col)))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints each text, and the text with its last quarter replaced by the start of the next document.

    Returns one row per input row: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint,
    near_edited, near_next. Ids are of any type that can be ordered. The next document is that of the next id (rows of one
    id in the order of their texts' first HEAD code points, then of their texts' hashes; null ids before all others; after
    the last, the first). A null text is empty. An empty table gives no rows. Other columns are ignored.

    Texts are dealt once, into ranges of (id, head, hash) whose bounds come from a sample of these keys; the first row of
    each range also goes to the end of the range before, so every row meets its next one in a stream, and a range is never
    held whole. So many rows of one id, or without an id, take several ranges; only rows alike in id and text share one.
    """
    spark = docs.sparkSession
    kind = dict(docs.select(F.col(id_col).alias("doc")).dtypes)["doc"]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("key", F.struct("doc", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("hash")))
    key = base.schema["key"].dataType
    # the sample only places the bounds
    share = min(1.0, 50 * parts / max(base.count(), 1))
    sample = [r["key"] for r in base.select("key").sample(share, seed=1).orderBy("key").collect()]
    bounds = [tuple(sample[len(sample) * i // parts]) for i in range(1, parts)] if sample else []
    bounds = list(dict.fromkeys(bounds))
    literal = lambda k: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(k, key.fields, strict=True)])
    holds = F.array(*[literal(k) for k in bounds]) if bounds else None
    range_ = F.size(F.filter(holds, lambda b: b <= F.col("key"))) if bounds else F.lit(0)
    ranged = base.withColumn("range", range_)
    firsts = ranged.groupBy("range").agg(F.min("key").alias("first")).orderBy("range").collect()  # at most parts rows
    before = {r["range"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)}
    ids = spark.createDataFrame([(r["range"], r["first"], before[r["range"]]) for r in firsts], StructType().add("range", "integer").add("first", key).add("also", "integer"))
    placed = ranged.join(F.broadcast(ids), "range")
    # of rows alike in the key, one goes before the range as its first row: which of them doesn't show
    also = F.when(F.col("key") == F.col("first"), F.col("also"))
    dealt = (
        placed.select(
            "key",
            "text",
            F.explode(F.filter(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("tail")), F.struct(also.alias("range"), F.lit(True).alias("tail"))), lambda x: x["range"].isNotNull())).alias("at"),
        )
        .select("key.doc", "text", "at.range", "at.tail", "key")
        .repartitionByRange(max(1, len(firsts)), "range")
        .sortWithinPartitions("range", "tail", "key")
        .select("doc", "text", "range", "tail")
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (id as array of one, text, range, fingerprint)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts, ranges, tails = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
                prints = fingerprints(texts)
                ids = batch.column(0)
                if held is not None:
                    ids = pa.concat_arrays([held[0], ids])
                    texts, ranges, tails, prints = [held[1], *texts], [held[2], *ranges], [False, *tails], [held[3], *prints]
                held = None if tails[-1] else (ids.slice(len(ids) - 1), texts[-1], ranges[-1], prints[-1])
                own = [i for i in range(len(texts) - 1) if not tails[i] and ranges[i] == ranges[i + 1]]
                quarter = [len(texts[i]) // 4 for i in own]
                edited = [texts[i][: len(texts[i]) - q] + texts[i + 1][:q] for i, q in zip(own, quarter, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(own, pa.int64())),
                        pa.array([len(texts[i]) for i in own], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([prints[i] for i in own], pa.string()),
                        pa.array(fingerprints(edited), pa.string()),
                        pa.array([prints[i + 1] for i in own], pa.string()),
                    ],
                    names=["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"],
                )

    found = dealt.mapInArrow(stream, f"doc {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    return found.withColumns(
        {
            "near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")),
            "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint")),
        }
    ).withColumnRenamed("doc", id_col)
