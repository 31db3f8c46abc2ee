"""Review pieces and packets: spans of bounded length and the greedy filling of packets in reading order.

The folds along a group's order go over ranges of it (``folds``), so a group takes as many tasks as its rows need. Rows
without a group are one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import span
from attestry.operators import folds


def split_spans(segments: DataFrame, max_chars: int, text_col: str = "text") -> DataFrame:
    """One row per piece of at most max_chars code points: adds start, end (half-open) and piece (its text, which
    replaces no column). An empty text gives one piece (0, 0); a null text gives none."""
    if max_chars < 1:
        raise ValueError("max_chars must be positive")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(max_chars))
    out = segments.where(F.col(text_col).isNotNull()).withColumn("start", F.explode(starts))
    end = F.least(F.col("start") + max_chars, F.length(text_col))
    return out.withColumn("end", end).withColumn("piece", span(F.col(text_col), F.col("start"), F.col("end")))


def fill_packets(pieces: DataFrame, group: str, order: list[str], size: str, limit: int) -> DataFrame:
    """Adds ``packet``, numbered from 1 in each group: pieces in order go into a packet until the next one would exceed
    the limit. A piece over the limit has a packet of its own; a null size counts as 0."""
    return folds.fill(pieces, group, order, size, limit, "packet")


def packet_summary(packets: DataFrame, group: str, size: str) -> DataFrame:
    """Rows (group, packet, pieces, chars)."""
    return packets.groupBy(group, "packet").agg(F.count("*").alias("pieces"), F.sum(F.col(size).cast("long")).alias("chars"))


def budgeted(items: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Adds ``included``: items in order are taken if they fit into what is left of the group's budget, else skipped,
    and later smaller ones may still fit. A null size counts as 0."""
    return folds.take(items, group, order, size, budget, "included")


def started_within(jobs: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """The jobs of each group that start before its budget is used up, with ``used_before``: the costs of the jobs before
    it (a null cost counts as 0). A job that starts may go over; none starts after that."""
    return folds.running(jobs, group, order, cost, "used_before").where(F.col("used_before") < budget)
