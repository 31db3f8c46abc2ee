"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Documents are tokenized once; pieces (doc, piece, start, length, crc32 of the ids) are written to the shared folder, and
everything after works on lengths. Pieces of full length are sequences as they are. The others are dealt at random into
problems of about ``problem`` pieces, whose number grows with the input. Each problem is first packed by best-fit
decreasing; where that has as few bins as the lower bound, nothing can be better. The others are evolved on several
islands, one task each, from that solution. Between epochs each island's best solution migrates to the next island of its
problem. A solution is a grouping of pieces into bins; crossover injects whole well-filled bins of one parent into the
other, drops the bins that hold any piece twice, and best-fits the displaced pieces, after displaced pieces took the place
of smaller ones in bins that they fill better. An island stops as soon as its best solution reaches the lower bound.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import materialise

#: Words whose ids a worker remembers.
MEMORY = 400_000
#: Tasks of an epoch; further problems share them.
MOST_TASKS = 4_000

#: Letters and then punctuation without an apostrophe: what the tokenizers below cut into these two parts.
_SIMPLE = re.compile(r"([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


class Words:
    """Ids of single words from a tokenizers file, remembered within bounds.

    That is for tokenizers whose setup shows that they drop white space and join nothing across it: they lower-case, cut
    at the border of letters and other signs and spell in bytes. A simple word's two parts go to the model directly, which
    spares the tracking of offsets; every other word goes through the whole tokenizer. Any other tokenizer gets whole texts
    (``spell`` is None).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.spell = self._spelling() if self._splits_simply(json.loads(self.tokenizer.to_str())) else None

    @staticmethod
    def _splits_simply(setup: dict) -> bool:
        steps = [x.get("type") for x in (setup["normalizer"] or {}).get("normalizers", [])]
        cuts = (setup["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in cuts] == ["Split", "ByteLevel"]
            and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in cuts[0]["pattern"].get("Regex", "")
            and not cuts[1]["add_prefix_space"]
            and setup["model"]["type"] == "BPE"
            and not setup["model"]["dropout"]
        )

    @staticmethod
    def _spelling() -> dict[int, str]:
        """Bytes as the characters that byte-level models use: printable ones stand for themselves, others follow 255."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _part(self, text: str) -> bytes:
        if text not in self.parts:
            spelled = text.encode().decode("latin-1").translate(self.spell)
            self.parts[text] = np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], dtype="<u4").tobytes()
        return self.parts[text]

    def learn(self, words: set[str]) -> None:
        if len(self.known) > MEMORY:
            self.known.clear()
        if len(self.parts) > MEMORY:
            self.parts = {"": b""}
        for w in words.difference(self.known):
            simple = _SIMPLE.fullmatch(w) if self.spell else None
            if simple:
                self.known[w] = self._part(simple[1].lower()) + self._part(simple[2])
            else:
                self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()


_words: dict[str, Words] = {}


def token_ids(texts: list[str | None], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, without special tokens; null has none. They are those of
    the whole text for every tokenizer, by words where its setup shows that this gives the same."""
    if path not in _words:
        _words[path] = Words(path)
    words = _words[path]
    if words.spell is None:
        # nothing is known of what it joins across white space: whole texts
        return [np.array(e.ids, dtype="<u4").tobytes() for e in words.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    get, out = words.known.__getitem__, []
    for t in texts:
        own = (t or "").replace("\n", " ").split(" ")
        try:
            ids = b"".join(map(get, own))
        except KeyError:
            words.learn(set(own))
            ids = b"".join(map(get, own))
        out.append(ids)
    return out


def pieces_of(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, size: int, end_id: int) -> DataFrame:
    """Rows (doc, piece, start, length, ids_crc32); each document's ids end with end_id."""
    kind = dict(docs.select(F.col(id_col).alias("doc")).dtypes)["doc"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                which, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(token_ids(some.column(1).to_pylist(), tokenizer)):
                    ids += end
                    for k in range(0, len(ids), 4 * size):
                        own = ids[k : k + 4 * size]
                        which.append(i)
                        piece.append(k // (4 * size))
                        start.append(k // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"doc {kind}, piece int, start long, length long, ids_crc32 long"
    )


class Bins:
    """Open bins by free space, for best-fit in constant time: the tightest free space that fits is found by a bit scan."""

    def __init__(self, size: int):
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.has = 0

    def add(self, b: int, free: int) -> None:
        self.by_free[free].append(b)
        self.has |= 1 << free

    def take(self, need: int) -> tuple[int, int]:
        """(bin, free space) of the tightest bin that fits; bin -1 if none."""
        above = self.has >> need
        if not above:
            return -1, 0
        free = need + ((above & -above).bit_length() - 1)
        own = self.by_free[free]
        b = own.pop()
        if not own:
            self.has &= ~(1 << free)
        return b, free


def best_fit(lengths: np.ndarray, order: np.ndarray, size: int, bin_of: np.ndarray, free: list[int]) -> tuple[np.ndarray, list[int]]:
    """Places the pieces of ``order``, one after the other, each into the tightest bin that fits, else a new one."""
    open_ = Bins(size)
    for b, f in enumerate(free):
        if f > 0:
            open_.add(b, f)
    placed = []
    for n in lengths[order].tolist():
        b, f = open_.take(n)
        if b < 0:
            b, f = len(free), size
            free.append(size)
        f -= n
        free[b] = f
        if f:
            open_.add(b, f)
        placed.append(b)
    bin_of[order] = placed
    return bin_of, free


def fitness(free: np.ndarray, size: int) -> tuple[int, float]:
    """Fewer bins first; then fuller full bins and emptier last ones (mean squared fill)."""
    return -len(free), float(np.square(1 - np.asarray(free) / size).sum())


def compact(bin_of: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Renumbers the bins from 0 without gaps and returns their free space."""
    _, bin_of = np.unique(bin_of, return_inverse=True)
    return bin_of, size - np.bincount(bin_of, weights=lengths).astype(np.int64)


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Injects well-filled bins of b into a; bins of a that hold an injected piece go, and what they displace is best-fitted."""
    a, free_a = compact(a, lengths, size)
    b, free_b = compact(b, lengths, size)
    good = np.flatnonzero(free_b <= max(1, size // 200))
    if not len(good):
        good = np.argsort(free_b, kind="stable")[: max(1, len(free_b) // 4)]
    chosen = rng.choice(good, max(1, int(len(good) * rng.uniform(0.1, 0.5))), replace=False)
    injected = np.isin(b, chosen)
    hit = np.zeros(len(free_a), dtype=bool)
    hit[a[injected]] = True
    # mutation: the emptiest bins are opened as well
    loose = np.argsort(-free_a, kind="stable")[: max(1, len(free_a) // 50)]
    hit[loose] = True
    kept = ~hit[a] & ~injected
    displaced = np.flatnonzero(hit[a] & ~injected)
    child = np.full(len(a), -1, dtype=np.int64)
    numbers = np.cumsum(~hit) - 1
    child[kept] = numbers[a[kept]]
    first = int((~hit).sum())
    child[injected] = first + np.searchsorted(np.sort(chosen), b[injected])
    free = np.concatenate((free_a[~hit], free_b[np.sort(chosen)])).tolist()
    child, free, displaced = swap_in(lengths, child, free, displaced)
    order = displaced[np.lexsort((rng.random(len(displaced)), -lengths[displaced]))]
    child, _ = best_fit(lengths, order, size, child, free)
    return child


def swap_in(lengths: np.ndarray, bin_of: np.ndarray, free: list[int], displaced: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Lets displaced pieces take the place of a smaller piece, or of two, in bins that are filled better so. Returns the
    solution, the bins' free space and the pieces that are displaced then (smaller ones, which are easier to place)."""
    out = sorted((int(n), int(i)) for n, i in zip(lengths[displaced], displaced, strict=True))
    inside: dict[int, list[int]] = {}
    for i in np.flatnonzero(bin_of >= 0).tolist():
        if free[bin_of[i]] > 0:
            inside.setdefault(int(bin_of[i]), []).append(i)
    for b, own in inside.items():
        if not out:
            break
        parts = [(int(lengths[i]), (i,)) for i in own]
        if len(own) <= 12:
            parts += [(int(lengths[i] + lengths[j]), (i, j)) for k, i in enumerate(own) for j in own[:k]]
        best = None
        for n, gone in parts:
            # the longest displaced piece that fits in their place
            at = bisect.bisect_right(out, (n + free[b], len(lengths))) - 1
            if at >= 0 and out[at][0] > n and (best is None or out[at][0] - n > best[0]):
                best = (out[at][0] - n, at, gone)
        if best:
            gain, at, gone = best
            bin_of[out.pop(at)[1]] = b
            free[b] -= gain
            for i in gone:
                bin_of[i] = -1
                bisect.insort(out, (int(lengths[i]), i))
    return bin_of, free, np.array([i for _, i in out], dtype=np.int64)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """No packing has fewer bins: by total, and by pieces over half the size, no two of which share a bin."""
    return max(-(-int(lengths.sum()) // size), int((lengths > size // 2).sum()))


def evolve(lengths: np.ndarray, size: int, seed: int, migrants: list[np.ndarray], generations: int, population: int = 4) -> np.ndarray:
    """The best solution of an island: bin numbers by piece."""
    rng = np.random.default_rng(seed)
    n, least = len(lengths), lower_bound(lengths, size)
    people = [np.asarray(m, dtype=np.int64) for m in migrants]
    score = lambda x: fitness(compact(x, lengths, size)[1], size)

    def done() -> bool:
        return any(-score(x)[0] <= least for x in people)

    while len(people) < (population if generations else 1) and not (people and done()):
        # the first is best-fit decreasing; the others perturb its order
        noise = 0 if not people else rng.normal(0, 0.02 * size * len(people), n)
        people.append(best_fit(lengths, np.argsort(-(lengths + noise), kind="stable"), size, np.full(n, -1, dtype=np.int64), [])[0])
    people.sort(key=score, reverse=True)
    for _ in range(generations):
        if -score(people[0])[0] <= least or len(people) < 2:
            break
        i, j = rng.choice(len(people), 2, replace=False)
        child = crossover(people[i], people[j], lengths, size, rng)
        people[-1] = max(people[-1], child, key=score)
        people.sort(key=score, reverse=True)
    return compact(people[0], lengths, size)[0]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0,
         problem: int = 20_000, islands: int = 3, epochs: int = 2, generations: int = 12, seed: int = 1) -> DataFrame:
    """Packs tokenized documents into sequences of at most ``size`` tokens.

    Returns one row per piece: the id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty and so
    the end id alone. A document longer than ``size`` is cut into pieces of ``size``, the last maybe shorter. Rows that
    repeat an id or everything are packed each for itself; null ids are kept. An empty table gives no rows. Columns
    other than the two named are ignored, whatever their names.
    """
    if size < 1 or problem < 1 or islands < 1:
        raise ValueError("size, problem and islands must be at least 1")
    pieces = materialise(pieces_of(docs, tokenizer, id_col, text_col, size, end_id).withColumn("row", F.monotonically_increasing_id()))
    return _named(pack_pieces(pieces, size, problem, islands, epochs, generations, seed), id_col)


def pack_pieces(pieces: DataFrame, size: int = 2048, problem: int = 20_000, islands: int = 3, epochs: int = 2, generations: int = 12, seed: int = 1) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``, a written table with a unique long ``row`` and a ``length`` of at most
    ``size``. A null length is refused by the lower bound's sum; an empty table gives no rows."""
    loose = pieces.where(F.col("length") < size)
    problems = -(-loose.count() // problem)
    full = pieces.where(F.col("length") >= size).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    if not problems:
        return full
    dealt = loose.withColumn("problem", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(problems)))

    def gather(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("row")
        return pd.DataFrame({"problem": [p["problem"].iloc[0]], "lengths": [p["length"].to_numpy(np.int32).tobytes()], "rows": [p["row"].to_numpy(np.int64).tobytes()]})

    world = materialise(
        dealt.select("problem", "row", "length").groupBy("problem").applyInPandas(gather, "problem long, lengths binary, rows binary")
    )

    def epoch(number: int, generations: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    which, lengths, island, guests = (batch.column(k)[i].as_py() for k in range(4))
                    lengths = np.frombuffer(lengths, dtype=np.int32).astype(np.int64)
                    own = [np.frombuffer(g, dtype=np.int32) for g in guests or []]
                    best = evolve(lengths, size, hash((seed, which, island, number)) & 0x7FFFFFFF, own, generations)
                    bins, score = fitness(compact(best, lengths, size)[1], size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([which], pa.int64()), pa.array([island], pa.int32()), pa.array([bins], pa.int64()), pa.array([score]), pa.array([-bins > lower_bound(lengths, size)]), pa.array([best.astype(np.int32).tobytes()], pa.binary())],
                        names=["problem", "island", "bins", "score", "open", "best"],
                    )

        return run

    def evolved(tasks: DataFrame, count: int, number: int, generations: int) -> DataFrame:
        """One row per problem and island; a task takes several of them where there are more than MOST_TASKS."""
        dealt = tasks.select("problem", "lengths", "island", "guests").repartition(max(1, min(count, MOST_TASKS)), "problem", "island")
        return materialise(dealt.mapInArrow(epoch(number, generations), "problem long, island int, bins long, score double, open boolean, best binary"))

    # best-fit decreasing by one task per problem; the islands evolve those that it leaves above their lower bound
    first = evolved(world.select("problem", "lengths", F.lit(0).alias("island"), F.lit(None).cast("array<binary>").alias("guests")), problems, 0, 0)
    found, state, left = first, first.where("open"), first.where("open").count()
    for number in range(1, epochs + 1):
        if not left:
            break
        if number == 1:
            guests = state.select("problem", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array("best").alias("guests"))
        else:
            # an island keeps its own best and gets that of the island before it
            stay = state.select("problem", "island", "best")
            go = state.select("problem", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "best")
            guests = stay.unionByName(go).groupBy("problem", "island").agg(F.array_sort(F.collect_set("best")).alias("guests"))
        state = evolved(guests.join(world.select("problem", "lengths"), "problem"), left * islands, number, generations)
        found = found.unionByName(state)
        # a problem that one of its islands has solved is done
        done = state.where("not open").select("problem").distinct()
        state = state.join(done, "problem", "left_anti")
        left = state.select("problem").distinct().count()
    best = found.groupBy("problem").agg(F.max_by("best", F.struct("bins", "score", -F.col("island"))).alias("best"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                which, lengths, rows, own = (batch.column(k)[i].as_py() for k in range(4))
                lengths, rows, own = np.frombuffer(lengths, dtype=np.int32).astype(np.int64), np.frombuffer(rows, dtype=np.int64), np.frombuffer(own, dtype=np.int32)
                order = np.argsort(own, kind="stable")
                ends = np.cumsum(lengths[order])
                begin = ends - lengths[order]
                new = np.flatnonzero(np.diff(own[order], prepend=-1))
                offset = begin - np.repeat(begin[new], np.diff(np.append(new, len(order))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[order]), pa.array((which << 32) + own[order].astype(np.int64)), pa.array(offset)], names=["row", "sequence_id", "offset"]
                )

    placed = world.join(best, "problem").select("problem", "lengths", "rows", "best").mapInArrow(place, "row long, sequence_id long, offset long")
    return full.unionByName(loose.join(placed, "row"))


def _named(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
