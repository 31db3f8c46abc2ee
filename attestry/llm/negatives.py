"""Hard negatives by a dual-tree search: trees over anchors and candidates, intervals of inner products for pairs of nodes.

A splitting tree is fitted on a bounded sample of the vectors; every row is routed through it, and rows of a leaf are
packed into pages with their own centre and radius. A node's centre is the sample's; its radius covers all its pages, so
intervals hold for every row. Anchors go through the same tree, a page of them having one label.

The search walks both trees down at once, a level a join: a pair of nodes splits into pairs of their children, each gets
the interval of the inner products between its rows, and pairs go whose interval can't reach what the anchors of the node
need: whole groups of anchors are settled at once. Pairs of pages that are left are scored exactly. It is run twice, for
the positives and then for the negatives, whose scores lie in a range that the positives' set.

Rows of equal vector and label are one point of the candidates with as many of the least ids as a result can hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.shared import discard, materialise

#: Vectors that the tree is fitted on at most; points of a page of candidates and of anchors.
SAMPLE, PAGE, ANCHORS = 20_000, 512, 1_024
#: Binary splits between a level of nodes and the next; pages of candidates that a task of the exact scores takes.
BITS, TASK_PAGES = 3, 16


@dataclass
class Tree:
    """Splits in heap order (1 is the root): a row goes right where its product with the axis is above the cut."""

    depth: int
    axis: np.ndarray
    above: np.ndarray
    centre: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.axis[node]) > self.above[node])
        return node

    def ancestors(self, node: int, levels: int) -> list[int]:
        """The nodes of each level above the pages, from the root; a node stands for itself on levels below its own."""
        depth = node.bit_length() - 1
        return [node >> (depth - min(BITS * n, depth)) for n in range(levels)]


def fit(sample: np.ndarray, leaves: int) -> Tree:
    """Halves the sample along its widest direction until there are ``leaves``; rows of equal product stay together."""
    depth = max(0, min(int(np.ceil(np.log2(max(leaves, 1)))), int(np.log2(max(len(sample), 1)))))
    dim = sample.shape[1]
    tree = Tree(depth, np.zeros((1 << depth, dim)), np.zeros(1 << depth), np.zeros((2 << depth, dim)))
    node = np.ones(len(sample), dtype=np.int64)
    rng = np.random.default_rng(7)
    for level in range(depth + 1):
        for k in range(1 << level, 2 << level):
            own = sample[node == k]
            tree.centre[k] = own.mean(axis=0) if len(own) else tree.centre[k // 2]
            if level < depth and len(own) > 1:
                away, axis = own - tree.centre[k], rng.standard_normal(dim)
                for _ in range(8):
                    axis = away.T @ (away @ axis)
                    axis /= np.linalg.norm(axis) or 1.0
                tree.axis[k], tree.above[k] = axis, np.median(own @ axis)
        if level < depth:
            node = 2 * node + (np.einsum("ij,ij->i", sample, tree.axis[node]) > tree.above[node])
    return tree


def _quantised(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Vectors as floor(scale * x) in 64-bit integers; rows with a null or non-finite component, or past 2**62, go."""
    for batch in batches:
        keep, out = [], []
        for i, v in enumerate(batch.column("vector")):
            x = np.array(v.values.cast(pa.float64()).to_numpy(zero_copy_only=False)) if v.is_valid and not v.values.null_count else np.full(1, np.nan)
            x = np.floor(scale * x)
            if np.isfinite(x).all() and (np.abs(x) < 2.0**62).all():
                keep.append(i)
                out.append(x.astype("<i8").tobytes())
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), rows.column("anchor"), pa.array(out, pa.binary())], names=["id", "label", "anchor", "vec"])


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<i8").reshape(len(values), -1)


def _routed(batches: Iterator[pa.RecordBatch], trees: dict[int, Tree], depth: int) -> Iterator[pa.RecordBatch]:
    """Each row's node, ``depth`` splits below the root or a leaf above that."""
    for batch in batches:
        vec = batch.column("vec").to_pylist()
        leaf = np.ones(len(vec), dtype=np.int64)
        size = np.array([len(v) // 8 for v in vec], dtype=np.int64)
        for dim, tree in trees.items():
            own = np.flatnonzero(size == dim)
            if len(own) and dim:
                leaf[own] = tree.leaf(_matrix([vec[i] for i in own]).astype(float)) >> max(0, tree.depth - depth)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(leaf)], names=[*batch.schema.names, "dim", "leaf"])


def _packed(batches: Iterator[pa.RecordBatch], trees: dict[int, Tree], levels: int, most: int, by_label: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pages of consecutive rows of one dimension and leaf, of one label each if ``by_label``."""
    page, held, of = TaskContext.get().partitionId() << 32, [], None

    def full(rows: list[dict], name: int) -> pa.RecordBatch:
        vec = _matrix([r["vec"] for r in rows])
        dim, leaf = rows[0]["dim"], rows[0]["leaf"]
        x = vec.astype(float)
        centre = x.mean(axis=0)
        radius = float(np.sqrt(np.square(x - centre).sum(axis=1)).max()) if dim else 0.0
        labels = {r["label"] for r in rows}
        side = f"{rows[0]['label']}:" if by_label else ""
        above, parent = [], None
        tree = trees.get(dim) or Tree(0, np.zeros((1, dim)), np.zeros(1), np.zeros((2, dim)))
        for level, node in enumerate(tree.ancestors(leaf, levels)):
            own, c = f"{side}{dim}:{level}:{node}", tree.centre[node]
            above.append({"level": level, "node": own, "parent": parent, "centre": c.tobytes(), "radius": float(np.linalg.norm(c - centre)) + radius, "tally": None})
            parent = own
        above.append({"level": len(above), "node": f"{side}page:{name}", "parent": parent, "centre": centre.tobytes(), "radius": radius, "tally": list(Counter(r["label"] for r in rows).items())})
        small = dim and np.abs(vec).max() < 1 << 15
        return pa.RecordBatch.from_pylist([{
            "page": above[-1]["node"], "dim": dim, "n": len(rows), "label": labels.pop() if len(labels) == 1 else None, "above": above,
            "ids": [r["ids"] for r in rows], "labels": [r["label"] for r in rows], "small": bool(small), "vecs": vec.astype("<i2" if small else "<i8").tobytes(),
        }], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            now = (r["dim"], r["leaf"], r["label"] if by_label else None)
            if held and (now != of or len(held) >= most):
                yield full(held, page)
                held, page = [], page + 1
            of = now
            held.append(r)
    if held:
        yield full(held, page)


PAGES = """page string, dim int, n int, label bigint, above array<struct<level: int, node: string, parent: string, centre: binary, radius: double, tally: map<bigint, int>>>,
    ids array<array<bigint>>, labels array<bigint>, small boolean, vecs binary"""


def _nodes(pages: DataFrame, *extra: Column) -> DataFrame:
    """The nodes of all levels; ``label`` where all rows have it, ``tally`` the labels' counts of a page. ``extra``: more sums over the pages below."""
    each = pages.withColumn("x", F.explode("above"))
    same = F.when((F.count("label") == F.count("*")) & (F.min("label") == F.max("label")), F.min("label"))
    return each.groupBy("x.level", "x.node", "x.parent").agg(F.first("x.centre").alias("centre"), F.max("x.radius").alias("radius"), F.sum("n").alias("n"), same.alias("label"), F.first("x.tally", ignorenulls=True).alias("tally"), *extra)


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Between which bounds every inner product of a pair of nodes lies; rounding is allowed for."""
    for batch in batches:
        a, c = ([np.frombuffer(v, dtype=float) for v in batch.column(f"{s}_centre").to_pylist()] for s in "ac")
        ra, rc = (batch.column(f"{s}_radius").to_numpy(zero_copy_only=False) for s in "ac")
        mid = np.array([x @ y for x, y in zip(a, c, strict=True)])
        na, nc = (np.array([np.linalg.norm(x) for x in v]) for v in (a, c))
        wide = na * rc + nc * ra + ra * rc
        wide = wide + 1e-9 * (na + ra) * (nc + rc) + 1e-3
        rest = [n for n in batch.schema.names if not n.endswith(("_centre", "_radius"))]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(mid - wide), pa.array(mid + wide)], names=[*rest, "least", "most"])


def _pairs(anchors: DataFrame, candidates: DataFrame, levels: int, keep: Column, sure: Column) -> DataFrame:
    """Pairs of pages (a, c, most) that the walk down both trees leaves.

    ``anchors`` and ``candidates`` are nodes with their columns prefixed a_ and c_. ``keep`` says which pairs can matter;
    ``sure`` holds for pairs whose candidates are enough for each anchor, so that what is all below them can go.
    """
    now = None
    for level in range(levels):
        a = anchors.where(F.col("a_level") == level)
        c = candidates.where(F.col("c_level") == level)
        if now is None:
            pairs = a.join(c, F.col("a_dim") == F.col("c_dim"))
        else:
            pairs = now.select(F.col("a").alias("a_parent"), F.col("c").alias("c_parent")).join(a, "a_parent").join(c, "c_parent")
        columns = [n for n in pairs.columns if not n.endswith(("_parent", "_level"))]
        types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
        ddl = ", ".join([f"{n} {types[n]}" for n in columns if not n.endswith(("_centre", "_radius"))] + ["least double", "most double"])
        found = materialise(pairs.select(*columns).mapInArrow(_intervals, ddl).where(keep), *([now] if now is not None else []))
        need = found.where(sure).groupBy("a").agg(F.max("least").alias("need"))
        now = materialise(found.join(need, "a", "left").where(F.col("need").isNull() | (F.col("most") >= F.col("need"))).select("a", "c", "most"), found)
    return now


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while those are whole numbers, else in integers, else as Python's."""
    bound = max(a.shape[1], 1) * int(np.abs(a).max(initial=0)) * int(np.abs(c).max(initial=0))
    if bound < 1 << 53:
        return (a.astype(float) @ c.astype(float).T).astype(np.int64)
    return a @ c.T if bound < 1 << 63 else a.astype(object) @ c.astype(object).T


class Best:
    """The ``k`` best candidates of each query: higher scores, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.n = k, queries
        self.query, self.score, self.id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.least = np.full(queries, -np.inf)

    def offer(self, at: np.ndarray, values: np.ndarray, allowed: np.ndarray, ids: list[list[int]], without: np.ndarray | None) -> None:
        """``values`` of queries ``at`` by candidates, of which ``allowed`` count; each has its ids, save the query's own."""
        wanted = allowed & (values >= self.least[at][:, None])
        if not wanted.any():
            return
        k = self.k + (without is not None)
        if values.shape[1] > k and values.dtype != object:
            some = np.where(wanted, values, np.iinfo(np.int64).min)
            wanted &= values >= np.partition(some, values.shape[1] - k, axis=1)[:, values.shape[1] - k, None]
        i, j = np.nonzero(wanted)
        size = np.fromiter((len(ids[x]) for x in j), dtype=np.int64, count=len(j))
        own = np.fromiter((y for x in j for y in ids[x]), dtype=np.int64, count=int(size.sum()))
        i, j = np.repeat(i, size), np.repeat(j, size)
        if without is not None:
            other = own != without[i]
            i, j, own = i[other], j[other], own[other]
        query, score, own = np.append(self.query, at[i]), np.append(self.score, values[i, j]), np.append(self.id, own)
        order = np.lexsort((own, -score, query))
        query, score, own = query[order], score[order], own[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        held = rank < self.k
        self.query, self.score, self.id = query[held], score[held], own[held]
        last = rank[held] == self.k - 1
        self.least[self.query[last]] = self.score[last].astype(float)


FOUND = "a string, row int, anchor bigint, place int, positive bigint, positive_score bigint, id bigint, score bigint"


def _scored(batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """For a page of anchors and then pages of candidates, the best first, the best rows of each anchor (and positive)."""
    best = anchors = queries = None
    fit_long = lambda s: max(-(2**63), min(2**63 - 1, int(s)))

    def out() -> pa.RecordBatch:
        q = [queries[i] for i in best.query.tolist()]
        columns = [pa.array([anchors["page"]] * len(q), pa.string()), pa.array([x[0] for x in q], pa.int32()), pa.array([anchors["ids"][x[0]][0] for x in q], pa.int64())]
        columns += [pa.array([x[j] for x in q], t) for j, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(best.id), pa.array([fit_long(s) for s in best.score.tolist()], pa.int64())], names=[c.split()[0] for c in FOUND.split(", ")])

    for batch in batches:
        for i in range(batch.num_rows):
            (r,) = batch.slice(i, 1).to_pylist()
            vec = np.frombuffer(r["vecs"], dtype="<i2" if r["small"] else "<i8").reshape(r["n"], -1).astype(np.int64)
            if r["most"] is None:
                if best is not None and len(best.query):
                    yield out()
                anchors, matrix = r, vec
                queries = [(row, None, None, None) for row in range(r["n"])] if r["wants"] is None else [(w["row"], w["place"], w["positive"], w["positive_score"]) for w in r["wants"]]
                best, own = Best(len(queries), k), np.array([ids[0] for ids in r["ids"]])
                continue
            if best.least.min(initial=np.inf) > r["most"]:
                continue
            values = scores(matrix, vec)
            same = np.array([x == anchors["label"] for x in r["labels"]])
            if anchors["wants"] is None:
                best.offer(np.arange(len(queries)), values, np.broadcast_to(same, values.shape), r["ids"], own)
                continue
            # one positive of each anchor at a time
            for place in sorted({q[1] for q in queries}):
                at = np.array([n for n, q in enumerate(queries) if q[1] == place])
                mine = values[[queries[n][0] for n in at]]
                target = np.array([queries[n][3] for n in at], dtype=values.dtype)[:, None]
                big = values.dtype == object or np.abs(values).max(initial=0) >= 1 << 54 or np.abs(target).max(initial=0) >= 1 << 54
                x, t = (mine.astype(object), target.astype(object)) if big else (mine, target)
                best.offer(at, mine, ~same & ((100 * x >= low * t) & (100 * x <= high * t)).astype(bool), r["ids"], None)
    if best is not None and len(best.query):
        yield out()


def _exact(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """Exact scores of the pairs of pages, dealt by anchors' page and a part of the candidates' pages."""
    spark = pairs.sparkSession
    parts = max(1, -(-candidates.count() // TASK_PAGES))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(parts)))
    columns = ["a", "salt", "most", "page", "n", "label", "ids", "labels", "small", "vecs", "wants"]
    wants = anchors.schema["wants"].dataType
    own = dealt.select("a", "salt").distinct().join(anchors, F.col("a") == F.col("page")).withColumn("most", F.lit(None).cast("double"))
    other = dealt.join(candidates.withColumnRenamed("page", "c"), "c").withColumn("page", F.col("c")).withColumn("wants", F.lit(None).cast(wants))
    rows = own.select(*columns).unionByName(other.select(*columns)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "salt")
    return rows.sortWithinPartitions("a", "salt", F.col("most").desc_nulls_first()).mapInArrow(lambda b: _scored(b, k, low, high), FOUND)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, page: int = PAGE, anchor_page: int = ANCHORS,
) -> DataFrame:
    """For each anchor and each of its positives the negatives, best first: (anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score).

    A component x counts as floor(scale * x), a score is the inner product of such vectors, higher ones come first, ties
    by smaller id. Rows where ``anchors`` holds (a condition on the columns of ``rows``) are anchors; the positives are an
    anchor's first other rows of its label, the negatives the first rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score.

    Rows with a null id, label or vector, or a component that is null, not finite or past 2**62 when scaled, take no part.
    Rows equal in id, label and vector count once, other rows that repeat an id are rows of their own but never positives
    of an anchor of that id. Vectors of different lengths aren't compared. Scores past 64 bits are given as the largest
    such number. An anchor without positives, or a positive without negatives, has no rows; an empty table gives none.
    Other columns are ignored. ``sample`` bounds the vectors that the tree is fitted on; results don't depend on it.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vector"))
    whole = own.where("id is not null and label is not null and vector is not null")
    table = materialise(whole.mapInArrow(lambda b: _quantised(b, scale), "id bigint, label bigint, anchor boolean, vec binary").dropDuplicates(["id", "label", "vec"]))
    n = table.count()
    part = min(1.0, 2 * sample / max(n, 1))
    taken = [bytes(r.vec) for r in table.select("vec").sample(part, seed=5).limit(sample).collect()]
    trees = {d: fit(_matrix([v for v in taken if len(v) == 8 * d]).astype(float), -(-n // page)) for d in {len(v) // 8 for v in taken} if d}

    schema = _arrow_schema(PAGES)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (64 * page)))
    kept = max(positives + 1, negatives)
    ranked = table.withColumn("r", F.row_number().over(Window.partitionBy("vec", "label").orderBy("id"))).where(F.col("r") <= kept)
    points = ranked.groupBy("vec", "label").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    single = table.where("anchor").select("vec", "label", F.array("id").alias("ids"))
    levels = 1 + max([-(-t.depth // BITS) for t in trees.values()], default=0)
    asking = table.where("anchor").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    # no deeper than fills pages of anchors, each of one label
    shallow = max(0, (asking.n // (anchor_page * max(1, asking.labels))).bit_length())
    sides = []
    for side, most, by_label, depth in ((single, anchor_page, True, shallow), (points, page, False, 64)):
        routed = side.mapInArrow(lambda b, d=depth: _routed(b, trees, d), "vec binary, label bigint, ids array<bigint>, dim bigint, leaf bigint")
        key = ["dim", "label", "leaf"] if by_label else ["dim", "leaf", "label"]
        order = [*key, F.xxhash64("vec"), F.col("ids")[0]]
        sorted_ = routed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        sides.append(materialise(sorted_.mapInArrow(lambda b, m=most, y=by_label: _packed(b, trees, levels, m, y, schema), PAGES)))
    discard(table)
    a_pages, c_pages = sides

    def named(nodes: DataFrame, side: str) -> DataFrame:
        dim = F.when(F.col("level") == 0, F.element_at(F.split("node", ":"), -3))
        named_ = nodes.withColumn("dim", dim)
        return named_.select(*[F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in named_.columns])

    candidates = named(materialise(_nodes(c_pages)), "c")
    mixed = F.col("c_label").isNull()
    same = F.col("c_label") == F.col("a_label")
    # how many points of a node surely have the anchors' label; of nodes above pages it is known for those of one label
    like = F.when(F.col("c_tally").isNotNull(), F.coalesce(F.try_element_at("c_tally", F.col("a_label")), F.lit(0))).otherwise(F.when(same, F.col("c_n")).otherwise(0))
    unlike = F.when(F.col("c_tally").isNotNull(), F.col("c_n") - like).otherwise(F.when(mixed | same, 0).otherwise(F.col("c_n")))
    enough = like >= positives + 1
    pairs = _pairs(named(_nodes(a_pages), "a"), candidates, levels + 1, mixed | same, enough)
    wants = "array<struct<row: int, place: int, positive: bigint, positive_score: bigint>>"
    found = _exact(pairs, a_pages.withColumn("wants", F.lit(None).cast(wants)), c_pages, positives, low, high)
    first = Window.partitionBy("a", "row").orderBy(F.desc("score"), "id")
    best = found.select("a", "row", "anchor", "id", "score").withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    chosen = materialise(best)

    asked = chosen.groupBy("a").agg(
        F.array_sort(F.collect_list(F.struct("row", "place", F.col("id").alias("positive"), F.col("score").alias("positive_score")))).cast(wants).alias("wants"),
        F.max("score").alias("top"), F.min("score").alias("bottom"),
    )
    a_wanting = materialise(a_pages.join(asked.withColumnRenamed("a", "page"), "page"))
    bounds = [F.max("top").alias("top"), F.min("bottom").alias("bottom")]
    anchor_nodes = named(_nodes(a_wanting, *bounds), "a")
    # both ends of a range, whatever the sign of the scores; a little wider, as these are floating-point numbers
    ends = [F.col(c).cast("double") * f / 100 for c in ("a_top", "a_bottom") for f in (low, high)]
    within = (F.col("most") >= F.least(*ends) - F.abs(F.least(*ends)) * 1e-12 - 1) & (F.col("least") <= F.greatest(*ends) + F.abs(F.greatest(*ends)) * 1e-12 + 1)
    lowest = F.least(F.col("a_bottom").cast("double") * high / 100, F.col("a_top").cast("double") * high / 100)
    all_under = (unlike >= negatives) & (F.col("most") <= lowest) & (F.col("least") >= F.greatest(*[F.col(c).cast("double") * low / 100 for c in ("a_top", "a_bottom")]))
    pairs = _pairs(anchor_nodes, candidates, levels + 1, (mixed | ~same) & within, all_under)
    found = _exact(pairs, a_wanting, c_pages, negatives, low, high)
    first = Window.partitionBy("a", "row", "place").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= negatives)
        .select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
