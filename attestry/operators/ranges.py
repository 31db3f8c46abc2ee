"""Whole-table order without one task: ranges of a sort key, their sizes, and places within them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_of(rows: DataFrame, key: str, parts: int | None = None) -> Column:
    """The number of the range that a row's struct column ``key`` lies in, from 0, ascending with the key.

    A sample places at most ``parts`` - 1 bounds (the shuffle partitions by default); which ones doesn't change what a
    user of the ranges gets. Equal keys share a range; nulls in a key come first.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, 50 * parts / max(rows.count(), 1))
    sample = [r[0] for r in rows.select(key).sample(share, seed=1).orderBy(key).collect()]
    bounds = list(dict.fromkeys(tuple(sample[len(sample) * i // parts]) for i in range(1, parts))) if sample else []
    if not bounds:
        return F.lit(0)
    fields = rows.schema[key].dataType.fields
    literals = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, fields, strict=True)]) for b in bounds]
    # every wide-th bound first, then those behind the last of them that the key has passed
    wide = math.isqrt(len(literals) - 1) + 1
    passed = lambda some: F.size(F.filter(some, lambda b: b <= F.col(key)))
    full = passed(F.array(*literals[wide - 1 :: wide])) * wide
    return full + passed(F.slice(F.array(*literals), full + 1, wide))


def numbered(rows: DataFrame, order: list[str], name: str, kind: str = "int") -> DataFrame:
    """Adds ``name``, the row's place from 1 by the columns ``order`` (nulls first), of type ``kind``. Each range numbers its own rows and
    adds how many the ranges before it hold; that table has one row for each range. An empty table gives no rows."""
    keyed = rows.withColumn("_key", F.struct(*order))
    placed = keyed.withColumn("_range", range_of(keyed, "_key"))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    joined = placed.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return joined.withColumn(name, (within + F.col("_before")).cast(kind)).drop("_key", "_range", "_before")
