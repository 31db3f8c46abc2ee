"""Overlap of half-open intervals as an equi-join on buckets, so that no pair is tried only because it shares a key.

A bucket is 4^n wide, n the least for which it is no shorter than the interval, so an interval lies in one or two buckets of
its own width. Two intervals meet at the width of the longer one: the shorter is dealt to the wider widths that the other
side has. They are tested in the bucket that the later start lies in, and nowhere else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bucket widths are powers of this.
BASE = 4
WIDTHS = [BASE**n for n in range(31)]


def _width(start: str, end: str) -> Column:
    """The width of an interval's own buckets; that of an empty one is the least."""
    length = F.col(end).cast("long") - F.col(start).cast("long")
    return F.element_at(F.filter(F.lit(WIDTHS), lambda w: w >= length), 1)


def _dealt(rows: DataFrame, start: str, end: str, widths: list[int], mark: str) -> DataFrame:
    """A row for each bucket of the widths from its own on (_w, _b); ``mark``: whether the width is its own."""
    wide = rows.withColumn("_own", _width(start, end)).withColumn("_w", F.explode(F.filter(F.lit(widths), lambda w: w >= F.col("_own"))))
    bucket = lambda at: F.floor(at.cast("long") / F.col("_w"))
    last = F.greatest(F.col(end).cast("long") - 1, F.col(start).cast("long"))
    return wide.withColumn(mark, F.col("_w") == F.col("_own")).withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(last)))).drop("_own")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of a row of ``left`` and one of ``right`` with equal ``keys`` whose intervals [start, end) overlap: each starts
    before the other ends. Both sides' columns, named apart but for the keys, once for each pair of rows.

    An empty interval overlaps what it lies strictly within. Null keys or bounds, and an end before its start, overlap
    nothing. Equal rows are paired each for itself. The widths in use, at most 31 numbers, are read before the join.
    """
    (ls, le), (rs, re_) = left_span, right_span
    if shared := (set(left.columns) & set(right.columns)) - set(keys):
        raise ValueError(f"columns of both sides: {sorted(shared)}")
    sound = lambda df, s, e: df.where(F.col(s) <= F.col(e))
    left, right = sound(left, ls, le), sound(right, rs, re_)
    own = left.select(_width(ls, le).alias("w")).unionByName(right.select(_width(rs, re_).alias("w"))).distinct()
    widths = sorted(r["w"] for r in own.collect()) or [1]
    a = _dealt(left, ls, le, widths, "_l")
    b = _dealt(right, rs, re_, widths, "_r")
    later = F.floor(F.greatest(F.col(ls), F.col(rs)).cast("long") / F.col("_w")) == F.col("_b")
    meets = [F.col("_l") | F.col("_r"), later, F.col(ls) < F.col(re_), F.col(rs) < F.col(le)]
    return a.join(b, [*keys, "_w", "_b"]).where(reduce(Column.__and__, meets)).drop("_w", "_b", "_l", "_r")
