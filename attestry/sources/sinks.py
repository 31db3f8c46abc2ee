"""Sinks that either happen whole or not at all, and that can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from attestry.functions.identity import table_print
from attestry.sources import known, lookup


class PublishError(RuntimeError):
    """A target that exists with other content, or a staged result that fails its checks."""


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def publish_tables(tables: dict[str, DataFrame], target: str, check: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> None:
    """Writes tables as Parquet next to ``target``, checks them as they read back, and renames them in place.

    ``check`` gives rows of what is wrong; with any, or if the target exists, nothing is published and the stage is gone.
    Tables of records are sorted by their ids and get their lines, so that one record is found without a scan.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, place = _fs(spark, target)
    if fs.exists(place):
        raise PublishError(f"{target} exists")
    staging = f"{target.rstrip('/')}.staging"
    _, stage = _fs(spark, staging)
    fs.delete(stage, True)
    try:
        for name, df in tables.items():
            at = f"{staging}/{name}"
            if "record_id" not in df.columns:
                df.write.mode("errorifexists").parquet(at)
                continue
            df.write.mode("errorifexists").parquet(f"{at}.unsorted")
            lookup.write(spark.read.schema(df.schema).parquet(f"{at}.unsorted"), at, "record_id")
            fs.delete(_fs(spark, f"{at}.unsorted")[1], True)
            if "provenance" in df.columns:
                lookup.write_lines(spark.read.schema(df.schema).parquet(at), f"{at}.lines")
        written = {name: spark.read.parquet(f"{staging}/{name}") for name in tables}
        wrong = check(written) if check else None
        if wrong is not None and not wrong.isEmpty():
            raise PublishError(f"checks found: {[r.asDict() for r in wrong.limit(20).collect()]}")
        if not fs.rename(stage, place):
            raise PublishError(f"{target} couldn't be put in place")
    finally:
        fs.delete(stage, True)


def append_blobs(blobs: DataFrame, path: str, had: DataFrame | None = None) -> int:
    """Appends blobs (sha256, bytes, content) that the store lacks, by the first two characters of their hash; refuses a
    hash that doesn't fit its content, and then appends nothing. Repeating it adds nothing. What the store has is told by
    its filters and, where they can't, by the folders of the blobs' own prefixes (see sources.known); a caller that has
    asked already gives the answer. The hash is proved and the rows are counted while they're written. Returns the number
    of new blobs."""
    if had is None:
        had = known.had(blobs.select("sha256"), path)
    new = blobs.dropDuplicates(["sha256"]).join(had, "sha256", "left_anti")
    wrong = F.raise_error(F.lit("a blob's hash isn't that of its content")).cast("binary")
    proved = new.withColumn("content", F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(wrong))
    seen = Observation()
    # before the blobs: a filter may have too much, never too little
    digits = known.add(new.select("sha256"), known.filters_of(path))
    # by prefix and block, or each task would write a file into each of the 256 folders
    dealt = proved.withColumn("prefix", known.prefix()).repartition("prefix", F.substring("sha256", 3, digits))
    # counted above the exchange: an empty one would leave nothing below it to count
    dealt = dealt.observe(seen, F.count("*").alias("n"))
    try:
        dealt.write.mode("append").partitionBy("prefix").parquet(path)
    except Exception as e:
        if "hash isn't that of its content" in str(e):
            raise PublishError("a blob's hash isn't that of its content") from e
        raise
    return seen.get["n"]


class Journal:
    """Batches of row appends that are installed once: ``installing`` is written first, ``complete`` last. An exact
    repeat of a complete batch does nothing; a batch left installing is finished before any other may start."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def entries(self) -> DataFrame:
        schema = "batch string, fingerprint string, state string, at timestamp"
        fs, place = _fs(self.spark, f"{self.path}/journal")
        return self.spark.read.schema(schema).parquet(f"{self.path}/journal") if fs.exists(place) else self.spark.createDataFrame([], schema)

    def _note(self, batch: str, fingerprint: str, state: str) -> None:
        self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(fingerprint).alias("fingerprint"), F.lit(state).alias("state"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{self.path}/journal")

    def install(self, batch: str, rows: DataFrame) -> str:
        """Returns installed, or already_installed."""
        fingerprint = table_print(rows)
        seen = {(r["batch"], r["state"]): r["fingerprint"] for r in self.entries().collect()}
        open_ = {b for b, s in seen if s == "installing"} - {b for b, s in seen if s == "complete"}
        if (batch, "complete") in seen:
            if seen[batch, "complete"] != fingerprint:
                raise PublishError(f"batch {batch} was installed with other rows")
            return "already_installed"
        if open_ - {batch}:
            raise PublishError(f"batch {sorted(open_)[0]} isn't complete")
        if seen.get((batch, "installing"), fingerprint) != fingerprint:
            raise PublishError(f"batch {batch} began with other rows")
        if (batch, "installing") not in seen:
            self._note(batch, fingerprint, "installing")
        rows.write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        self._note(batch, fingerprint, "complete")
        return "installed"
