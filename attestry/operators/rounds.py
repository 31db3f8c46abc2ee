"""Pointer doubling: what lies along chains of any length, in as many written joins as the logarithm of the longest."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Where rounds are written: spark.checkpoint.dir, which driver and executors share. A local session without it gets
    a temporary folder; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="attestry-rounds-"))
    return _own[0]


def new_place(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else has, deleted when the driver ends."""
    place = f"{shared_folder(spark)}/attestry-round-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, place)
    return place


def written(rows: DataFrame, *done: DataFrame) -> DataFrame:
    """``rows`` from a table in the shared folder, so that no lineage grows and a lost executor costs a reread. The tables
    ``done`` are deleted, as nothing reads them any more; others when the driver ends."""
    spark = rows.sparkSession
    place = new_place(spark)
    rows.write.parquet(place)
    out = spark.read.schema(rows.schema).parquet(place)
    out._round_place = place
    for d in done:
        _remove(spark, d._round_place)
    return out


class Once(dict):
    """Tables by name; each is written when it is first asked for and read from there after that."""

    def __getitem__(self, name: str) -> DataFrame:
        table = super().__getitem__(name)
        if not hasattr(table, "_round_place"):
            table = written(table)
            self[name] = table
        return table


def _remove(spark: SparkSession, place: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def longest(rows: DataFrame, group: str) -> int:
    """Rounds that reach the end of every chain within a group: chains have no more links than a group has rows."""
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0]
    return int(most or 1).bit_length() + 1


def doubled(state: DataFrame, rounds: int, fold: dict[str, Column] | None = None, stop: Column | None = None) -> DataFrame:
    """``state`` (at, next, and values): in each round a row takes on what the row at its ``next`` has, whose next becomes
    its own. ``fold`` gives new values from the row's own columns and the other's, prefixed far_. Rows without a next, or
    where ``stop`` holds, are done; rows that lead round a cycle are left with a next. One row for each ``at``."""
    fold = fold or {}
    now = written(state)
    done = F.col("next").isNull() | (stop if stop is not None else F.lit(False))
    for _ in range(rounds):
        open_ = now.where(~done)
        if open_.isEmpty():
            break
        far = now.select(F.col("at").alias("next"), *[F.col(c).alias(f"far_{c}") for c in ("next", *fold)])
        # what is no place of the table ends a chain
        moved = open_.join(far, "next", "left").select("at", F.col("far_next").alias("next"), *[v.alias(c) for c, v in fold.items()])
        now = written(now.where(done).unionByName(moved), now)
    return now
