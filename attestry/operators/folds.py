"""Folds along the order of a group of any size, without one task for the group.

Rows are dealt into ranges of (group, order). A range starts and ends within a group, so at most two groups of it, its first
and its last, go on beyond it; all others are folded where they are. What a range does to the state of those two is
summed up in a row each, the rows are put together along the ranges, and each range then folds from the state it starts
with. The driver holds these rows alone: at most two for each range, however many rows there are. Rows that are equal in
group and order stay in one range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from attestry.operators.ranges import range_of
from attestry.operators.rounds import written


def _in_ranges(rows: DataFrame, group: str, order: list[str], parts: int | None) -> DataFrame:
    """``rows`` with ``_range``, written once: the sample, the sums and the fold read the table."""
    keyed = rows.withColumn("_key", F.struct(F.col(group).alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]))
    kept = written(keyed)
    return kept.withColumn("_range", range_of(kept, "_key", parts)).drop("_key")


def running(rows: DataFrame, group: str, order: list[str], size: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``size`` (null counts as 0) over the rows of the group before this one.

    Each range adds up its own rows. What stands before it concerns its first group alone: one row for each range, which
    is broadcast. Rows without a group are one group; an empty table gives no rows.
    """
    placed = _in_ranges(rows.drop(name), group, order, parts)
    n = F.coalesce(F.col(size), F.lit(0))
    key = F.struct(F.col(group).alias("g"))
    ends = placed.groupBy("_range").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    tails = placed.join(F.broadcast(ends), "_range").where((key == F.col("_last")) | (key == F.col("_first")))
    sums = tails.groupBy("_range", key.alias("_g")).agg(F.sum(n).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.select("_range", "_g", before.alias("_before")).where("_before is not null")
    within = F.sum(n).over(Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    own = placed.withColumn("_within", within).withColumn("_g", key)
    total = F.coalesce("_within", F.lit(0)) + F.coalesce("_before", F.lit(0))
    # equal structs are equal with a null in them, too
    return own.join(F.broadcast(carried), ["_range", "_g"], "left").withColumn(name, total).drop("_range", "_g", "_within", "_before")


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Any, bool, np.ndarray]]:
    """(range, group, whether it is the range's first, sizes) of the first and the last group of each range; batches of
    (range, group, size) in order. Only the sizes of one such group are held."""
    now, first, held = None, True, []
    for batch in batches:
        for r, g, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or r != now[0]:
                if now is not None:
                    yield (*now, first, np.array(held, np.int64))
                now, first, held = (r, g), True, []
            elif g != now[1]:
                if first:
                    yield (*now, first, np.array(held, np.int64))
                now, first, held = (r, g), False, []
            held.append(n or 0)
    if now is not None:
        yield (*now, first, np.array(held, np.int64))


def _summed_up(placed: DataFrame, group: str, order: list[str], size: str, fields: dict[str, pa.DataType], sql: str, sum_up: Callable) -> list:
    """The rows (range, group, fields) of each range's outer groups, by range and place in it."""
    of = placed.schema[group].dataType
    own = placed.select("_range", F.col(group).alias("_g"), F.col(size).cast("long").alias("_n"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    slim = own.repartition("_range").sortWithinPartitions("_range", "_g", *[f"_o{i}" for i in range(len(order))]).select("_range", "_g", "_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(1).type
                yield batch

        for r, g, first, sizes in _parts_of(seen()):
            values = sum_up(sizes)
            columns = [pa.array([r], pa.int32()), pa.array([g], kind), pa.array([first])]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([v], t) for v, t in zip(values, fields.values(), strict=True)]], names=["_range", "_g", "_first", *fields])

    told = slim.mapInArrow(run, StructType([StructField("_range", IntegerType()), StructField("_g", of), StructField("_first", BooleanType()), *StructType.fromDDL(sql).fields]))
    return sorted(told.collect(), key=lambda r: (r["_range"], not r["_first"]))


def _chains(told: list) -> list[list]:
    """The summaries of each group that more than one range has, in order."""
    chains: list[list] = []
    for row in told:
        if chains and row["_g"] == chains[-1][-1]["_g"] and row["_range"] != chains[-1][-1]["_range"]:
            chains[-1].append(row)
        else:
            chains.append([row])
    return [c for c in chains if len(c) > 1]


def _folded(placed: DataFrame, group: str, order: list[str], size: str, name: str, kind: str, states: list[tuple], step: Callable) -> DataFrame:
    """Adds ``name``: step(state, size) gives (state, value) for each row of a group in order, from None or from the state
    that ``states`` (range, group, two longs) has for the range."""
    spark = placed.sparkSession
    schema = StructType([StructField("_range", IntegerType()), StructField("_g", placed.schema[group].dataType), *StructType.fromDDL("_a long, _b long").fields])
    entry = spark.createDataFrame([(r, g, a, b) for r, g, a, b in states], schema)
    known = entry.select("_range", F.struct(F.col("_g").alias("g")).alias("_key"), "_a", "_b")
    joined = placed.withColumn("_key", F.struct(F.col(group).alias("g"))).join(F.broadcast(known), ["_range", "_key"], "left").drop("_key")
    kept = [c for c in joined.columns if c not in ("_range", "_a", "_b")]
    held = joined.select(*kept, "_range", "_a", "_b")
    at = [held.columns.index(c) for c in ("_range", group, size, "_a", "_b")]
    arrow, plain = {"integer": (pa.int32(), IntegerType()), "boolean": (pa.bool_(), BooleanType())}[kind]
    out = StructType([*[held.schema[c] for c in kept], StructField(name, plain)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            values = []
            for r, g, n, a, b in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if now is None or now[0] != r or now[1] != g:
                    now, state = (r, g), None if a is None else (a, b)
                state, value = step(state, n or 0)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(values, arrow)], names=[*kept, name])

    return held.repartition("_range").sortWithinPartitions("_range", group, *order).mapInArrow(run, out)


def fill(rows: DataFrame, group: str, order: list[str], size: str, limit: int, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``, numbered from 1 in each group: rows in order share a number until the next would exceed ``limit``.

    What a range does depends on what is used when it begins, and that only by the row at which it first opens a number.
    From there on all is settled, so a range tells for each such row, of which there are at most limit + 1, how many
    numbers it opens and what is used at its end.
    """
    placed = _in_ranges(rows.drop(name), group, order, parts)

    def sum_up(sizes: np.ndarray):
        up_to = np.cumsum(sizes)
        before = up_to - sizes
        # the row that opens the next number after one opened at each row
        following = np.maximum(np.searchsorted(up_to, before + limit, side="right"), np.arange(1, len(sizes) + 1)).tolist()
        opened, used = [0] * len(sizes), [0] * len(sizes)
        for i in range(len(sizes) - 1, -1, -1):
            j = following[i]
            opened[i], used[i] = (1, int(up_to[-1] - before[i])) if j == len(sizes) else (1 + opened[j], used[j])
        reached, at = np.unique(up_to[: int(np.searchsorted(up_to, limit, side="right")) + 1], return_index=True)
        return reached.tolist(), [opened[i] for i in at], [used[i] for i in at], int(up_to[-1])

    longs = pa.list_(pa.int64())
    fields = {"_reached": longs, "_opened": longs, "_used": longs, "_total": pa.int64()}
    told = _summed_up(placed, group, order, size, fields, "_reached array<long>, _opened array<long>, _used array<long>, _total long", sum_up)
    states = []
    for chain in _chains(told):
        # the first row of a group always opens a number
        number, used = 0, limit + 1
        for i, row in enumerate(chain):
            if i:
                states.append((row["_range"], row["_g"], number, used))
            k = int(np.searchsorted(row["_reached"], limit - used, side="right"))
            number, used = (number, used + row["_total"]) if k == len(row["_reached"]) else (number + row["_opened"][k], row["_used"][k])

    def step(state, n):
        number, used = state or (1, 0)
        # the first row of a number always goes in
        if state is not None and used + n > limit:
            number, used = number + 1, 0
        return (number, used + n), number

    return _folded(placed, group, order, size, name, "integer", states, step)


def take(rows: DataFrame, group: str, order: list[str], size: str, budget: int, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: rows in order are taken if they fit into what is left of the group's budget, else skipped, and later
    smaller ones may still fit. Sizes aren't negative.

    While what is left lies between 2^k and 2^(k+1), rows under 2^k always fit and the first larger one that fits ends
    this. A range tells for each k the sum of the former and the least that must be left for one of the latter to fit, so
    ranges in which k stays are passed by sums; the others are folded, at most one for each k and group.
    """
    placed = _in_ranges(rows.drop(name), group, order, parts)
    ks = range(int(budget).bit_length())

    def sum_up(sizes: np.ndarray):
        small, needed = [], []
        for k in ks:
            always = np.where(sizes < 1 << k, sizes, 0)
            up_to = np.cumsum(always)
            larger = (sizes >= 1 << k) & (sizes < 2 << k)
            small.append(int(up_to[-1]))
            needed.append(int((sizes + up_to)[larger].min()) if larger.any() else None)
        return small, needed

    longs = pa.list_(pa.int64())
    chains = _chains(_summed_up(placed, group, order, size, {"_small": longs, "_needed": longs}, "_small array<long>, _needed array<long>", sum_up))

    def step(state, n):
        left = state[0] if state else budget
        return ((left - n, 0), True) if n <= left else ((left, 0), False)

    # what is left when a range of a chain begins; those behind a range that has to be folded wait for it
    left = [[budget] for _ in chains]
    while True:
        waiting = []
        for chain, known in zip(chains, left, strict=True):
            while len(known) < len(chain):
                now, row = known[-1], chain[len(known) - 1]
                k = now.bit_length() - 1
                if now and (now - row["_small"][k] < 1 << k or (row["_needed"][k] or now + 1) <= now):
                    waiting.append((row["_range"], row["_g"], now, known))
                    break
                known.append(now - row["_small"][k] if now else 0)
        if not waiting:
            break
        within = placed.where(F.col("_range").isin(sorted({w[0] for w in waiting}))).withColumn("_of", F.col("_range"))
        sums = _folded(within, group, order, size, "_taken", "boolean", [(r, g, now, 0) for r, g, now, _ in waiting], step)
        taken = sums.where("_taken").groupBy("_of", F.struct(F.col(group).alias("g")).alias("_key")).agg(F.sum(F.coalesce(size, F.lit(0))).cast("long").alias("n"))
        asked = placed.sparkSession.createDataFrame([(r, g) for r, g, *_ in waiting], StructType([StructField("_of", IntegerType()), StructField("_g", placed.schema[group].dataType)]))
        found: dict[int, list] = {}
        for r in taken.join(F.broadcast(asked.select("_of", F.struct(F.col("_g").alias("g")).alias("_key"))), ["_of", "_key"]).collect():
            found.setdefault(r["_of"], []).append((r["_key"]["g"], r["n"]))
        for r, g, now, known in waiting:
            known.append(now - next((n for h, n in found.get(r, []) if h == g), 0))
    states = [(row["_range"], row["_g"], now, 0) for chain, known in zip(chains, left, strict=True) for row, now in list(zip(chain, known, strict=True))[1:]]
    return _folded(placed, group, order, size, name, "boolean", states, step)
