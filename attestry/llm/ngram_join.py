"""Jaccard join of word n-gram sets with a count-vector R-tree.

A document's set holds the hashes of its distinct n-word shingles. Hashing the shingles into groups turns a set into a
point, its counts by group; the summed coordinate minima of two points bound their overlap from above, and those of a
point and a box's upper corner bound it for all points in the box. So a packed R-tree over the points finds for a
document all partners that may reach the threshold, and the sets themselves settle the surviving pairs.

First the points alone, without the sets, cut loose clusters into those whose bounds admit links; then the sets go to
their clusters' tasks. A tree needs its points in one place. Documents come together by an exact filter: two sets of similarity t differ in
at most (|A| + |B|) * (1 - t) / (1 + t) shingles, so among one group more than that at least one group of shingles is
equal in both. A document emits the hash of each of its groups (about 1/9 as many as shingles at t = 0.9); documents
that share one are joined to a star, the stars' components are the clusters, and each cluster gets its trees. Groups of
shingles that very many documents have (a license line, a common passage) would join unrelated documents, and the more of
them the larger the table; a document emits none of those while enough others are left. A large
cluster is divided by size band and hash into blocks of bounded size, and each pair of blocks that sizes allow is a
task of its own, so no cluster has to fit into one task. Equal sets are one vertex from the start, and each task
returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import textscan
from attestry.llm.shared import components, materialise, row_key, spread_join

#: Shingles of a block; a task holds two blocks.
BLOCK = 2_000_000
#: Sizes of one band differ by this factor at most, or by the threshold's inverse if that is more.
BAND = 1.25
#: Divisions that are tried; each fails for few sets.
LEVELS = 64
#: The first divisions leave out groups of common shingles alone, as many further ones those of very common ones alone.
TRIES = 2
#: Shingles that a task counts at a time, and in how many of these counts one that is common comes up twice at least.
COUNTED, COMMON = 2_000_000, 4
#: Common shingles that are told to all tasks; which ones they are decides on clusters, never on links.
MOST_COMMON = 500_000
MASK = (1 << 64) - 1


def shingle_sets(texts: list[str | None], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text, in order, its index and the sorted hashes of its distinct n-word shingles (A-Z lower-cased)."""
    for part in textscan.chunks(texts):
        words = textscan.scan(texts[part], lower=True)
        hashes, ok = words.windows(n)
        for i in range(part.stop - part.start):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= n:
                yield part.start + i, np.unique(hashes[a : b - n + 1])
            elif b > a:
                yield part.start + i, words.spans(np.array([a]), np.array([b]))
            else:
                yield part.start + i, np.zeros(0, dtype=np.uint64)


def band(size: float, ratio: float) -> int:
    return int(math.floor(math.log(size) / math.log(ratio) + 1e-9))


def band_start(b: int, ratio: float) -> int:
    """Least size of band b, in step with band()."""
    at = max(1, math.floor(ratio**b) - 1)
    while band(at, ratio) < b:
        at += 1
    return at


@functools.cache
def plan_of_band(b: int, num: int, den: int, ratio: float) -> tuple[int, int, int]:
    """Least size that may link with one of band b, the most shingles that may differ there, and the groups to take.

    The groups exceed the differences by more than the empty groups that a set of the least size is likely to have.
    """
    start, top = band_start(b, ratio), band_start(b + 1, ratio) - 1
    least = -(-start * num // den)
    differ = math.floor(2 * top * (den - num) / (den + num) + 1e-9)
    groups = differ + 1
    for _ in range(20):
        groups = differ + 1 + math.floor(1.3 * groups * math.exp(-least / groups))
    return least, differ, min(groups, 2 * top + 1)


def commonness(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each shingle its rank, 0 if it isn't common. ``common`` is sorted."""
    if not len(common):
        return np.zeros(len(shingles), dtype=np.int8)
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    return np.where(common[at] == shingles, rank[at], 0).astype(np.int8)


def signatures(shingles: np.ndarray, num: int, den: int, rank: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the groups of a set, divided for its own band and, if it may link with sets of the next one, for that.

    Linked sets lie in one band or in neighbouring ones, since a band's ratio is den / num at least. Of two linked sets
    divided alike, groups - differ groups at least are equal. A division leaves out empty groups and, by ``rank`` of
    the shingles, those of common ones alone: what equal groups hold is left out in both sets or in none. Where all the
    equal groups are left out, both sets leave out that many, and both take another division in turn; the later ones
    leave out empty groups alone. So one of their signatures is equal in any case.
    """
    n = len(shingles)
    ratio = max(BAND, den / num)
    own = band(n, ratio)
    out = []
    for b in (own, own + 1):
        least, differ, g = plan_of_band(b, num, den, ratio)
        if n < least:
            continue
        for level in range(LEVELS):
            spread = textscan.mix(shingles + np.uint64(0x5851F42D4C957F2D * (level + 1) & MASK))
            which = (((spread >> np.uint64(32)) * np.uint64(g)) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(g, dtype=np.uint64)
            np.add.at(total, which, spread | np.uint64(1))
            telling = which if rank is None or level >= 2 * TRIES else which[rank <= level // TRIES]
            used = np.flatnonzero(np.bincount(telling, minlength=g))
            label = used.astype(np.uint64) + np.uint64((b << 40) + (level << 34))
            out.append(textscan.mix(total[used] + textscan.mix(label)))
            if g - len(used) < g - differ:
                break
        else:
            raise ValueError(f"no division of {n} shingles into {g} groups")
    return np.concatenate(out)


def groups_for(size: int) -> int:
    """Groups of a set's point: a power of two near a quarter of its size."""
    return 1 << int(np.clip(math.ceil(math.log2(max(size / 4, 1))), 6, 10))


def point(shingles: np.ndarray) -> np.ndarray:
    """A set's counts by group. Those by half as many groups are the sums of the two halves."""
    g = groups_for(len(shingles))
    return np.bincount((shingles >> np.uint64(20)).astype(np.int64) % g, minlength=g).astype(np.uint32)


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points by as many groups as the smallest has."""
    g = min(len(p) for p in points)
    return np.stack([p.reshape(-1, g).sum(axis=0, dtype=np.int32) for p in points])


class CountTree:
    """Packed R-tree over count vectors: leaves of ``fan`` neighbouring points, boxes kept by their upper corner."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        self.fan = fan
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > fan:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), fan)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, i: int, num: int, den: int, label: np.ndarray, all_: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Positions after i (or ``all_``) of another label than i's whose bound admits den * overlap >= num * union with
        point i, and the bounds."""
        point, size = self.levels[0][0][i], int(self.levels[0][1][i])
        at, bound = np.arange(len(self.levels[-1][0])), None
        for level in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[level]
            if level < len(self.levels) - 1:
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(top)]
            if not all_:
                at = at[at >= (i + 1 if level == 0 else i // self.fan**level)]
            if level == 0:
                at = at[label[at] != label[i]]
            at = at[(num * size <= den * high[at]) & (num * low[at] <= den * size)]
            bound = np.minimum(top[at], point).sum(axis=1)
            keep = (num + den) * bound >= num * (size + low[at])
            at, bound = at[keep], bound[keep]
        return at, bound


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def forest(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, found by tree search and settled on the sets."""
    m = len(sets)
    if m < 2:
        return []
    if m == 2:
        a, b = sets
        common = overlap(a, b)
        return [(0, 1)] if den * common >= num * (len(a) + len(b) - common) else []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)

    def settled(i: int, j: int) -> bool:
        common = overlap(sets[i], sets[j])
        return den * common >= num * (len(sets[i]) + len(sets[j]) - common)

    return _forest([point(s) for s in sets], sizes, num, den, settled)


def _forest(points: list[np.ndarray], sizes: np.ndarray, num: int, den: int, settled=None) -> list[tuple[int, int]]:
    """Links that connect what is connected, by trees over two neighbouring size bands each, whose points have as many
    groups as suit these sizes."""
    if len(sizes) <= 64:
        return _spanning(folded(points), sizes, num, den, settled)
    band_ = np.floor(np.log(sizes) / (math.log(den / num) if num < den else 1.0) + 1e-9).astype(np.int64)
    links = []
    for b in np.unique(band_):
        own = np.flatnonzero((band_ == b) | (band_ == b + 1))
        if len(own) > 1:
            found = (lambda i, j, own=own: settled(int(own[i]), int(own[j]))) if settled else None
            links += [(int(own[i]), int(own[j])) for i, j in _spanning(folded([points[k] for k in own]), sizes[own], num, den, found)]
    return links


def _spanning(points: np.ndarray, sizes: np.ndarray, num: int, den: int, settled=None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose bound admits a link and that ``settled`` (if given) confirms."""
    # neighbours in the order get into one leaf: by size, then by some coordinates
    some = range(0, points.shape[1], max(1, points.shape[1] // 6))
    order = np.lexsort((*[points[:, j] for j in some], np.log(np.maximum(sizes, 1)) // 0.1))
    tree = CountTree(points[order], sizes[order])
    label = np.arange(len(sizes))
    links = []
    # copies of one text are far from each other but near it: the point most like the mean meets all others first, and
    # what it links needs no search among itself
    mean = points[order].mean(axis=0)
    center = int(np.minimum(points[order], mean).sum(axis=1).argmax()) if len(sizes) > tree.fan else -1
    for i in [center] * (center >= 0) + list(range(len(sizes))):
        at, bound = tree.search(i, num, den, label, i == center)
        at = at[np.argsort(-bound, kind="stable")]
        while len(at):
            at = at[label[at] != label[i]]
            if not len(at):
                break
            j, at = at[0], at[1:]
            if settled is None or settled(int(order[i]), int(order[j])):
                links.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return links


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, node) sorted: joins each further node of a signature to its first one. Keeps one row."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        new = np.ones(len(sig), dtype=bool)
        new[1:] = sig[1:] != sig[:-1]
        if last is not None and sig[0] == last[0]:
            new[0] = False
            heads = np.concatenate(([last[1]], node[new]))
            head = heads[np.cumsum(new)]
        else:
            head = node[new][np.cumsum(new) - 1]
        last = (sig[-1], head[-1])
        pairs = np.unique(np.stack((head, node), axis=1)[head != node], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _names(shingles: np.ndarray) -> tuple[bytes | None, int | None]:
    """128 bits that name a set, and 64 of them; none for an empty set."""
    if not len(shingles):
        return None, None
    spread = textscan.mix(shingles)
    one = textscan.mix(spread.sum(keepdims=True) + np.uint64(len(shingles)))
    two = textscan.mix(np.bitwise_xor.reduce(spread * np.uint64(0xC2B2AE3D27D4EB4F), keepdims=True))
    return one.tobytes() + two.tobytes(), int(one.view(np.int64)[0])


def _doubled(held: list[np.ndarray]) -> np.ndarray:
    """The shingles that two or more of the sets have, sorted."""
    every = np.sort(np.concatenate(held))
    return np.unique(every[1:][every[1:] == every[:-1]])


def _common(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that came up twice in COMMON counts (rows with an array ``doubled``) or more, sorted, and their rank: 2 if
    in a quarter of all counts, else 1. Of more than MOST_COMMON those that came up most."""
    total = counts.count()
    if total < COMMON:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int8)
    often = counts.select(F.explode("doubled").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = often.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    shingle, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], np.where(4 * n[order] >= total, 2, 1).astype(np.int8)


def _signed(held: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
    """Rows (sig, node) of some sets. Of sets that share a signature only the first is dealt out by it; each other one goes
    with the first under a signature of their own, once for all that the two share. So a signature that a large part of
    all sets has sends one row of each batch to its task."""
    node = np.repeat(np.array(nodes, dtype=np.int64), [len(h) for h in held])
    sig = np.concatenate(held).view(np.int64)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = sig[1:] != sig[:-1]
    head = node[new][np.cumsum(new) - 1]
    # a set may have one signature twice
    pairs = np.unique(np.stack((head, node), axis=1)[head != node], axis=0)
    own = textscan.mix(pairs[:, 1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + textscan.mix(pairs[:, 0].view(np.uint64))).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((sig[new], own, own))), pa.array(np.concatenate((node[new], pairs[:, 0], pairs[:, 1])))], names=["sig", "node"])


def _near(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, task, vertex, size, counts) sorted by the first two: a forest of the pairs that may link."""
    task, held = None, {}

    def pairs() -> pa.RecordBatch:
        names = list(held)
        sizes = np.array([s for s, _ in held.values()], dtype=np.int64)
        found = _forest([np.frombuffer(c, dtype=np.uint32) for _, c in held.values()], sizes, num, den)
        return pa.RecordBatch.from_arrays([pa.array([names[p[k]] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        cluster, todo, vertex, size, counts = (batch.column(i) for i in range(5))
        for i in range(batch.num_rows):
            now = (cluster[i].as_py(), todo[i].as_py())
            if now != task:
                if len(held) > 1:
                    yield pairs()
                task, held = now, {}
            held[vertex[i].as_py()] = (size[i].as_py(), counts[i].as_py())
    if len(held) > 1:
        yield pairs()


def _link(batches: Iterator[pa.RecordBatch], num: int, den: int, n: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, task, vertex, text) sorted by the first two: returns each task's forest of links. Texts take less
    room in the shuffle than the sets that are made of them here, once for each vertex of a task."""
    task, held = None, {}

    def links() -> pa.RecordBatch:
        names = list(held)
        pairs = forest(list(held.values()), num, den)
        return pa.RecordBatch.from_arrays([pa.array([names[p[k]] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        cluster, todo, vertex = (batch.column(i).to_pylist() for i in range(3))
        for i, s in shingle_sets(batch.column(3).to_pylist(), n):
            now = (cluster[i], todo[i])
            if now != task:
                if len(held) > 1:
                    yield links()
                task, held = now, {}
            held[vertex[i]] = s
    if len(held) > 1:
        yield links()


def _tasks(members: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Adds ``tasks``, an array of (band, i, j), to members (cluster, vertex, size, ...).

    A cluster of at most ``block`` shingles is one task. A larger one is divided by size band and a hash of the vertex
    into parts; each part meets each part of its band and of the next one in a task of theirs.
    """
    step = math.log(den / num) if num < den else 1.0
    banded = members.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(step) + F.lit(1e-9)))
    totals = banded.groupBy("cluster", "band").agg(F.sum("size").alias("band_size"))
    whole = totals.groupBy("cluster").agg(F.sum("band_size").alias("cluster_size"))
    parts = totals.join(whole, "cluster").select(
        "cluster", "band", F.when(F.col("cluster_size") <= block, 0).otherwise(F.ceil(F.col("band_size") / block)).cast("int").alias("parts")
    )
    above = parts.select("cluster", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = parts.select("cluster", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    parts = parts.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left").na.fill(0)
    # tasks of a set: with each part of its own band, of the next and of the one before
    plan = f"""case when parts = 0 then array(struct(-1L as band, 0 as i, 0 as j)) else concat(
        transform(sequence(0, parts - 1), x -> struct(band, least(x, part) as i, greatest(x, part) as j)),
        if(above > 0, transform(sequence(0, greatest(above, 1) - 1), x -> struct(band, part as i, x + 1000000 as j)), array()),
        if(below > 0, transform(sequence(0, greatest(below, 1) - 1), x -> struct(band - 1 as band, x as i, part + 1000000 as j)), array())) end"""
    return (
        banded.join(parts, ["cluster", "band"])
        .withColumn("part", F.when(F.col("parts") > 0, F.pmod(F.xxhash64("vertex"), F.greatest("parts", F.lit(1)))).otherwise(0).cast("int"))
        .withColumn("tasks", F.expr(plan))
    )


def linked_rows(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: tuple[int, int], block: int) -> DataFrame:
    """Rows (doc, key, size, root, least) for ngram_join(): root names the component, null for an empty set."""
    num, den = threshold
    if num > den or 10 * num < 7 * den:
        raise ValueError("the threshold must lie between 0.7 and 1")
    kind = dict(docs.select(F.col(id_col).alias("doc")).dtypes)["doc"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "key", "size", "vertex", "node", "counts", "doubled"]
        # each distinct set is counted once, so copies of one text don't make it common
        held: dict[bytes, np.ndarray] = {}
        many = 0
        doc = None

        def counted() -> pa.RecordBatch:
            twice = _doubled(list(held.values())).view(np.int64)
            told = pa.ListArray.from_arrays(pa.array([0, len(twice)], pa.int32()), pa.array(twice))
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in (doc, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())], told], names=names)

        for batch in batches:
            found = []
            doc = batch.column(0).type
            for _, s in shingle_sets(batch.column(1).to_pylist(), n):
                vertex, node = _names(s)
                found.append((len(s), vertex, node, point(s).tobytes()))
                if vertex is not None and vertex not in held:
                    held[vertex] = s
                    many += len(s)
                    if many >= COUNTED or len(held) >= 200_000:
                        yield counted()
                        held, many = {}, 0
            size, vertices, nodes, counts = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(vertices, pa.binary()), pa.array(nodes, pa.int64()), pa.array(counts, pa.binary()), pa.nulls(batch.num_rows, pa.list_(pa.int64()))],
                names=names,
            )
        if held:
            yield counted()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            held: list[np.ndarray] = []
            nodes: list[int] = []
            for _, s in shingle_sets(batch.column(0).to_pylist(), n):
                vertex, node = _names(s)
                if vertex is not None and vertex not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(vertex)
                    held.append(signatures(s, num, den, commonness(s, *common)))
                    nodes.append(node)
                if len(held) >= 2000:
                    yield _signed(held, nodes)
                    held, nodes = [], []
            if held:
                yield _signed(held, nodes)

    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    written = materialise(base.mapInArrow(sets, f"doc {kind}, key long, size long, vertex binary, node long, counts binary, doubled array<long>"))
    common = _common(written.where("doubled is not null").select("doubled"))
    table = written.where("doubled is null").drop("doubled")
    # signatures are a second scan's work: kept beside the table, they'd take more room than the texts
    clusters = components(
        base.select("text").mapInArrow(sign, "sig long, node long").repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_star, "a long, b long")
    ).select(F.col("v").alias("node"), F.col("root").alias("cluster"))
    # one row per distinct set; the key of any one of its rows leads back to a text
    sets_ = table.where("vertex is not null").groupBy("vertex", "node", "size").agg(F.min("key").alias("key"), F.first("counts").alias("counts"))
    # the clusters' points alone say which of their sets may link: their trees cut loose clusters into tight ones
    near = components(
        _tasks(sets_.join(clusters, "node"), num, den, block)
        .select("cluster", F.explode("tasks").alias("t"), "vertex", "size", "counts")
        .select("cluster", F.concat_ws(",", "t.band", "t.i", "t.j").alias("task"), "vertex", "size", "counts")
        .repartition("cluster", "task")
        .sortWithinPartitions("cluster", "task")
        .mapInArrow(lambda batches: _near(batches, num, den), "a binary, b binary")
    ).select(F.col("v").alias("vertex"), F.xxhash64("root").alias("cluster"))
    tasks = _tasks(sets_.drop("counts").join(near, "vertex"), num, den, block).select("key", "vertex", "cluster", "tasks")

    joined = components(
        base.select("key", "text")
        .join(tasks.hint("shuffle_hash"), "key")
        .select("text", "vertex", "cluster", F.explode("tasks").alias("t"))
        .select("cluster", F.concat_ws(",", "t.band", "t.i", "t.j").alias("task"), "vertex", "text")
        .repartition("cluster", "task")
        .sortWithinPartitions("cluster", "task")
        .mapInArrow(lambda batches: _link(batches, num, den, n), "a binary, b binary")
    ).select(F.col("v").alias("vertex"), "root")
    # the least id of a vertex, then of a root, then back: each step is a combined minimum, and joins split hot keys
    linked = materialise(joined)
    own = table.where("vertex is not null").groupBy("vertex").agg(F.min("doc").alias("least"))
    roots = linked.join(own, "vertex").groupBy("root").agg(F.min("least").alias("least"))
    known = spread_join(linked, roots, "root", F.col("vertex"), "left")
    alone = own.join(linked, "vertex", "left_anti").select("vertex", F.col("vertex").alias("root"), "least")
    named = known.select("vertex", "root", "least").unionByName(alone)
    out = spread_join(table.select("doc", "key", "size", "vertex"), named, "vertex", F.col("key"), "left")
    return out.select("doc", "key", "size", "root", F.coalesce("least", "doc").alias("least"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: tuple[int, int] = (90, 100), block: int = BLOCK) -> DataFrame:
    """Components of the documents linked by den * intersection >= num * union of their n-word shingle sets.

    Returns one row per input row: the id, n_shingles and component_id, the least id reachable by links, itself
    included. A text with fewer than n words has its whole word sequence as one shingle. A null text, or one without
    words, has an empty set and is linked with nothing. Rows that repeat an id with another text are vertices of their
    own. A null id is never a component's least one unless all ids of the component are null. Other columns are
    ignored, whatever their names. Sets are compared by 64-bit shingle hashes.
    """
    found = linked_rows(docs, id_col, text_col, n, threshold, block)
    return found.select(F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (80, 100), block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each component: the one of the least id (a null id comes last), and of rows that
    repeat an id the one of the least key. Rows with equal id and text are one document. Texts without words all stay, but
    for such repeats. An empty table gives no rows. Columns keep their names and values, whatever they are."""
    found = materialise(linked_rows(docs, id_col, text_col, n, threshold, block).select("doc", "key", "root"))
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "key")).alias("first"))
    keys = first.select(F.col("first.key").alias("_key")).unionByName(found.where("root is null").select(F.col("key").alias("_key")))
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_docs"), row_key(id_col, text_col).alias("_key"))
    # rows of one key are one document if a second hash agrees: none is lost to two documents of one key
    held = held.withColumn("_twin", F.xxhash64(F.lit(1), F.col("_docs")[text_col], F.col("_docs")[id_col], F.col("_docs")[text_col].isNull()))
    kept = held.join(keys.distinct().hint("shuffle_hash"), "_key", "left_semi").dropDuplicates(["_key", "_twin"])
    return kept.select(*[F.col("_docs")[c].alias(c) for c in docs.columns])
