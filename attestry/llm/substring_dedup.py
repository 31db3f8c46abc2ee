"""Substring dedup by compaction of a sparse de Bruijn graph of word k-mers.

Every window of ``window`` words has one *anchor*: the k-mer of ``k`` words in it with the least hash (the first of
equal ones). The choice depends on the window's words alone, so two equal windows have equal anchors at equal places.
The anchors are the graph's nodes, sampled from all k-mers; consecutive windows with one anchor form one *edge*, named by
the hash of all words under them, that leads from the k-mer before to the k-mer after it in the document. Then

1. all edges are dealt out by anchor and sorted (one shuffle of about 1/13 of the words): their counts, and of those that
   occur twice or more the one edge that follows and the one that precedes, if it is the same everywhere;
2. edges that agree on being each other's only neighbour make nonbranching paths. Pointer-doubling joins compact each
   path to its first edge (*head*) and every edge's place in it;
3. a repeated edge's source coordinates and its place give the path's span in each document. The spans' words are read
   from the texts again and compared by 128-bit digests of the words: only equal ones count as repeats;
4. anchors under several edges are the branches (a shared passage begins or ends there, an edit): for one edge of each
   kind there the text's single windows are compared, by two 64-bit hashes.

Each step's output is at most proportional to its input; no pairs of documents are made. The state of the streaming
steps is one row. Equal rows of about COMBINE rows are combined before they are dealt out, and anchors under very many
different edges (told by a sample of the texts) are dealt out by edge, so neither a passage nor a k-mer of a third of all
documents fills one task. Which anchors those are doesn't change the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import textscan
from attestry.llm.shared import discard, materialise, row_key, spread_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows that are combined before a shuffle.
COMBINE = 200_000
#: Share of the texts whose anchors are counted for those to be dealt out by edge, the edges of one that make it such, and
#: how many anchors there may be (the least count rises with the sample, so there are fewer).
SHARE, MANY, MOST_ANCHORS = 1 / 16, 100, 20_000


def _edge(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    return textscan.mix(anchor * np.uint64(0x8CB92BA72F3D8DD7) + context) | np.uint64(1)


def graph_edges(texts: list[str | None], window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For chunks of whole texts: anchor, edge, the next and the one before in the text (0 for none), index of the text,
    first window's word and number of windows."""
    for part in textscan.chunks(texts):
        words = textscan.scan(texts[part])
        kmers, _ = words.windows(k)
        at = textscan.sliding_argmin(kmers, window - k + 1)
        last = np.repeat(words.first[1:], np.diff(words.first))
        valid = np.flatnonzero(np.arange(len(last)) + window <= last)
        if not len(valid):
            continue
        anchor = at[valid]
        new = np.ones(len(valid), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(valid)))
        start, anchor = valid[begin], anchor[begin]
        place = (anchor - start).astype(np.uint64)
        context = textscan.mix(words.spans(start, start + count + window - 1) + place * np.uint64(0x9FB21C651E98DF25))
        doc = np.searchsorted(words.first, start, side="right") - 1
        edge = _edge(kmers[anchor], context)
        follows = np.zeros(len(edge) + 1, dtype=bool)
        follows[1:-1] = doc[1:] == doc[:-1]
        following, before = np.zeros_like(edge), np.zeros_like(edge)
        following[follows[1:]] = edge[1:][follows[1:-1]]
        before[follows[:-1]] = edge[:-1][follows[1:-1]]
        yield kmers[anchor], edge, following, before, doc + part.start, start - words.first[doc], count


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, for rows sorted by them."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def combine(first: np.ndarray, rest: tuple[np.ndarray, ...], key: np.ndarray, place: np.ndarray, agree: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Combines rows of equal (first, *rest) before they are dealt out: returns new firsts, weights and new ``agree``.

    The first row of several equal ones stands for them with weight 2; of each array of ``agree`` it has the value that
    they share, 0 if they differ. The others are repeats for certain; they get weight 0 and a ``first`` of their own, so
    they are spread evenly and pass through.
    """
    order = np.lexsort((*reversed(rest), first))
    begin = _runs(first[order], *[x[order] for x in rest])
    many = np.diff(np.append(begin, len(order)))
    weight = np.zeros(len(order), dtype=np.int64)
    weight[order[begin]] = np.minimum(many, 2)
    own = textscan.mix(key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
    out = []
    for x in agree:
        x = x.copy()
        x[order[begin]] = _common(x[order], begin)
        out.append(x)
    return np.where(weight == 0, own, first), weight, out


def _common(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each run the value that all its rows have, 0 if they differ."""
    low = np.minimum.reduceat(x, begin)
    return np.where(low == np.maximum.reduceat(x, begin), low, 0).astype(x.dtype)


REPEAT, ASK, LINK = 0, 1, 2


def _found(kind: int, edge: np.ndarray, key: np.ndarray, place: np.ndarray, next_: np.ndarray | None = None, before: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(edge)
    none = pa.nulls(n, pa.int64())
    columns = [pa.array(np.full(n, kind, dtype=np.int32)), _long(edge), _long(key), _long(place), none if next_ is None else _long(next_), none if before is None else _long(before)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "edge", "key", "place", "next", "before"])


def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (deal, edge, next, before, key, place * 8 + split * 4 + weight) sorted by the first two.

    Returns the coordinates of repeated edges (REPEAT), those of one edge of each kind of an anchor with several kinds
    (ASK), and for each repeated edge the only edge that follows and that comes before it, 0 for none (LINK, with its
    windows as place). Keeps one row between batches.
    """
    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        deal, edge, after, before, key, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        weight, split, place = place & 3, (place & 4) > 0, place >> 3
        # told: the row was returned; asked: for its kind; several: its anchor was seen to have several kinds
        told, asked, several_ = (np.zeros(len(deal), dtype=bool) for _ in range(3))
        columns = (deal, edge, after, before, key, place, weight, split, told, asked, several_)
        if tail is not None:
            columns = tuple(np.concatenate(([x], y)) for x, y in zip(tail, columns, strict=True))
        deal, edge, after, before, key, place, weight, split, told, asked, several_ = columns
        begin = _runs(deal, edge)
        run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(deal))))
        total = np.add.reduceat(weight, begin)
        node = np.cumsum(np.append(True, deal[begin][1:] != deal[begin][:-1])) - 1
        several = (np.bincount(node) > 1)[node] | split[begin]
        if several_[0]:
            several |= node == 0
        rows = np.flatnonzero(((total[run] > 1) | (weight == 0)) & ~told)
        yield _found(REPEAT, edge[rows], key[rows], place[rows])
        reps = begin[several & ~asked[begin]]
        yield _found(ASK, edge[reps], key[reps], place[reps])
        following, prior = _common(after, begin), _common(before, begin)
        done = np.flatnonzero(total[:-1] > 1)
        at = begin[done]
        yield _found(LINK, edge[at], key[at], place[at] & 255, following[done], prior[done])
        b = begin[-1]
        tail = (deal[b], edge[b], following[-1], prior[-1], key[b], place[b], min(int(total[-1]), 2), split[b], bool(total[-1] != 1), bool(several[-1]), bool(several[-1]))
        tail = tuple(np.asarray(x, dtype=c.dtype)[()] for x, c in zip(tail, columns, strict=True))
    if tail is not None and tail[6] > 1:
        one = [np.array([x]) for x in tail]
        yield _found(LINK, one[1], one[4], one[5] & 255, one[2], one[3])


def paths(links: DataFrame) -> DataFrame:
    """Rows (edge, head, at) for each edge that isn't the first of its nonbranching path: the first one, and the windows
    between the two. ``links``: edge, next, before, windows of the repeated edges.

    Every round doubles how far an edge's pointer reaches. A document's first edge has none before it, so a path can't
    lead back to itself.
    """
    back = links.where("before <> 0").select(F.col("edge"), F.col("before").alias("head"))
    ahead = links.where("next <> 0 and next <> edge").select(F.col("next").alias("edge"), F.col("edge").alias("head"), F.col("windows").alias("at"))
    now = materialise(ahead.join(back, ["edge", "head"]).distinct())
    for _ in range(64):
        step = now.select(F.col("edge").alias("head"), F.col("head").alias("_head"), F.col("at").alias("_at"))
        further = now.select("edge", "head", "at").join(step, "head", "left")
        now = materialise(further.select("edge", F.coalesce("_head", "head").alias("head"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"), F.col("_head").isNotNull().alias("moved")), now)
        if now.where("moved").isEmpty():
            return now.select("edge", "head", "at")
    raise RuntimeError("a path of edges leads back to itself")


def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, c, key, start, n * 4 + weight) sorted by the first three: returns (key, start, n) of those whose first
    three occur again. Keeps one row."""
    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        columns = (*columns[:5], columns[5] >> 2, columns[5] & 3, np.zeros(len(columns[0]), dtype=bool))
        if tail is not None:
            columns = tuple(np.concatenate(([x], y)) for x, y in zip(tail, columns, strict=True))
        a, b, c, key, start, n, weight, told = columns
        same = np.zeros(len(a) + 1, dtype=bool)
        same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])
        again = same[1:] | same[:-1] | (weight != 1) | told
        rows = np.flatnonzero(again & ~told)
        yield pa.RecordBatch.from_arrays([_long(key[rows]), _long(start[rows]), _long(n[rows])], names=["key", "start", "n"])
        tail = (a[-1], b[-1], c[-1], key[-1], start[-1], n[-1], weight[-1], again[-1])


def remove_spans(text: str | None, start: np.ndarray, count: np.ndarray, window: int) -> tuple[int, list[str]]:
    """Number of words, and the words left without those under ``count`` windows from word ``start`` on."""
    words = WORD.findall(text or "")
    if not len(start):
        return len(words), words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count + window - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


class _Dealer:
    """Gathers rows of numpy columns and hands them on combined, COMBINE rows or more at a time."""

    def __init__(self, give):
        self.give, self.held, self.n = give, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(columns)
            self.n += len(columns[0])
        if self.n >= COMBINE:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
            self.held, self.n = [], 0
            yield self.give(*columns)


def _split_anchors(keyed: DataFrame, window: int, k: int) -> np.ndarray:
    """Anchors under very many different edges, sorted: MOST_ANCHORS at most."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, edge, *_ in graph_edges(batch.column(0).to_pylist(), window, k):
                yield pa.RecordBatch.from_arrays([_long(anchor), _long(edge)], names=["anchor", "edge"])

    seen = keyed.select("text").sample(SHARE, seed=1).mapInArrow(edges, "anchor long, edge long").groupBy("anchor").agg(F.approx_count_distinct("edge").alias("n"))
    seen = materialise(seen.where(F.col("n") >= MANY))
    least = max(MANY, -(-(seen.agg(F.sum("n")).first()[0] or 0) // MOST_ANCHORS))
    anchors = np.array([r["anchor"] for r in seen.where(F.col("n") >= least).collect()], dtype=np.int64)
    discard(seen)
    return np.sort(anchors.view(np.uint64))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = 10) -> DataFrame:
    """Rows (key, start, n): n windows from word ``start`` on whose word sequences occur elsewhere too. ``key`` is
    row_key(id_col, text_col)."""
    if not 1 <= k <= window or window - k + 1 > 255:
        raise ValueError("k must lie between 1 and window, and window - k + 1 must be at most 255")
    keyed = _keyed(docs, id_col, text_col)
    split = _split_anchors(keyed, window, k)

    def deal(anchor, edge, after, before, keys, place):
        apart = np.isin(anchor, split)
        first, weight, (after, before) = combine(np.where(apart, edge, anchor), (edge,), keys, place, (after, before))
        place = place * 8 + apart * 4 + weight
        return pa.RecordBatch.from_arrays([_long(x) for x in (first, edge, after, before, keys, place)], names=["deal", "edge", "next", "before", "key", "place"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(deal)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for anchor, edge, after, before, doc, start, count in graph_edges(batch.column(1).to_pylist(), window, k):
                yield from dealer.add(anchor, edge, after, before, keys[doc], start * 256 + count)
        yield from dealer.rest()

    dealt = (
        keyed.select("key", "text")
        .mapInArrow(edges, "deal long, edge long, next long, before long, key long, place long")
        .repartition("deal")
        .sortWithinPartitions("deal", "edge")
    )
    found = materialise(dealt.mapInArrow(classify, "kind int, edge long, key long, place long, next long, before long"))
    repeats = found.where(F.col("kind") == REPEAT).select("edge", "key", "place")
    heads = paths(found.where(F.col("kind") == LINK).select("edge", "next", "before", F.col("place").alias("windows")))
    # a path's span in a document: all its edges there lead to one place of its head
    start, n = F.shiftright("place", 8), F.col("place").bitwiseAND(F.lit(255))
    placed = spread_join(repeats, heads, "edge", F.col("key"), "left").select(
        "key", F.coalesce("head", "edge").alias("head"), (start - F.coalesce("at", F.lit(0))).alias("origin"), start.alias("start"), (start + n).alias("stop")
    )
    spans = placed.groupBy("key", "head", "origin").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("n"))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("head", "start", "n")).alias("spans"))
    asked = found.where(F.col("kind") == ASK).select("key", "place").distinct().groupBy("key").agg(F.collect_list("place").alias("asked"))

    def compare(a, b, c, keys, start, n):
        first, weight, _ = combine(a, (b, c), keys, start)
        return pa.RecordBatch.from_arrays([_long(x) for x in (first, b, c, keys, start, n * 4 + weight)], names=["a", "b", "c", "key", "start", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(compare)
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            head, first, count = (_flat(batch.column(3), i) for i in range(3))
            own = _flat(batch.column(4))
            for part in textscan.chunks(texts):
                words = textscan.scan(texts[part])
                at = _owners(batch.column(3), part)
                if len(at):
                    rows = slice(*_bounds(batch.column(3), part))
                    digests = np.frombuffer(b"".join(_digests(words, words.first[at] + first[rows], count[rows] + window - 1)), dtype=np.uint64).reshape(-1, 2)
                    yield from dealer.add(head[rows].view(np.uint64), digests[:, 0], digests[:, 1], keys[part][at], first[rows], count[rows])
                at = _owners(batch.column(4), part)
                if len(at):
                    places = own[slice(*_bounds(batch.column(4), part))]
                    begin, many = places >> 8, places & 255
                    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    begin, at = np.repeat(begin, many) + step, np.repeat(at, many)
                    word = words.first[at] + begin
                    one, two = words.spans(word, word + window), words.spans(word, word + window, 1)
                    yield from dealer.add(one, two, np.zeros_like(one), keys[part][at], begin, np.ones_like(begin))
        yield from dealer.rest()

    work = spans.join(asked, "key", "full_outer")
    return (
        keyed.join(work.hint("shuffle_hash"), "key")
        .select("key", "doc", "text", "spans", "asked")
        .mapInArrow(read, "a long, b long, c long, key long, start long, n long")
        .repartition("a")
        .sortWithinPartitions("a", "b", "c")
        .mapInArrow(matching, "key long, start long, n long")
    )


def _digests(words: textscan.Scan, start: np.ndarray, length: np.ndarray) -> Iterator[bytes]:
    """128 bits of the words from each start on, joined by one space."""
    for a, n in zip(start.tolist(), length.tolist(), strict=True):
        part = words.data[words.begin[a] : words.end[a + n - 1]]
        yield hashlib.blake2b(b" ".join(part.split()), digest_size=16).digest()


def _flat(column: pa.ListArray, field: int | None = None) -> np.ndarray:
    values = column.values if field is None else column.values.field(field)
    return values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _bounds(column: pa.ListArray, part: slice) -> tuple[int, int]:
    offsets = column.offsets.to_numpy()
    return int(offsets[part.start]), int(offsets[part.stop])


def _owners(column: pa.ListArray, part: slice) -> np.ndarray:
    """For each value of the lists of ``part`` the index of its list, from 0."""
    return np.repeat(np.arange(part.stop - part.start), np.diff(column.offsets.to_numpy()[part.start : part.stop + 1]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = 10, with_text: bool = False) -> DataFrame:
    """Removes each word covered by a ``window``-word sequence that also starts elsewhere, in the same document or not.

    Returns one row per input row: the id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and,
    on request, kept_text. A null or empty text has no words. Words are compared unchanged. Rows with equal id and text
    get equal results; rows that repeat an id with other text are documents of their own. Null ids are kept as they are.
    An empty table gives no rows. Columns other than the two named are ignored, whatever their names.
    """
    # both joins with the texts deal them out alike, so one shuffle serves both
    keyed = _keyed(docs, id_col, text_col)
    packed = find_repeats(docs, id_col, text_col, window, k).distinct().groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    kind = dict(docs.select(F.col(id_col).alias("doc")).dtypes)["doc"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, count, offsets = _flat(batch.column(3), 0), _flat(batch.column(3), 1), batch.column(3).offsets.to_numpy()
            n, removed, sha, kept = [], [], [], []
            for i, t in enumerate(batch.column(2)):
                own = slice(offsets[i], offsets[i + 1])
                total, words = remove_spans(t.as_py(), start[own], count[own], window)
                left = " ".join(words)
                n.append(total)
                removed.append(total - len(words))
                sha.append(hashlib.sha256(left.encode()).hexdigest())
                if with_text:
                    kept.append(left)
            out = [batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.string())] * with_text, names=names + ["kept_text"] * with_text)

    schema = f"doc {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return (
        keyed.join(packed.hint("shuffle_hash"), "key", "left")
        .select("key", "doc", "text", "places")
        .mapInArrow(cut, schema)
        .withColumnRenamed("doc", id_col)
    )
