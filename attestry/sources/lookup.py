"""Tables that are asked for single rows: sorted by a key, with the first and last key of each file beside them.

A lookup reads the rows of that small table that can hold the key, then those files alone; in them Parquet's row group
statistics leave the one group that can hold it, or its Bloom filter none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.ranges import numbered


def bounds_of(place: str) -> str:
    """Where the first and last keys of a table's files lie."""
    return f"{place.rstrip('/')}.bounds"


def write(rows: DataFrame, place: str, key: str, options: dict[str, str] | None = None) -> None:
    """Writes ``rows`` as a table sorted by ``key`` in ranges, as many as AQE finds right, and its files' bounds. Equal keys
    share a range. Rows are read twice, once for a sample of keys: give a written table. A null key is never found."""
    bloom = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    rows.repartitionByRange(key).sortWithinPartitions(key).write.options(**bloom, **(options or {})).parquet(place)
    files = rows.sparkSession.read.schema(rows.schema).parquet(place).select(key, F.col("_metadata.file_name").alias("file"))
    files.groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last")).coalesce(1).write.parquet(bounds_of(place))


def find(spark: SparkSession, place: str, key: str, value) -> DataFrame:
    """The rows of a table of write() whose ``key`` is ``value``, out of the files that can hold it."""
    bounds = spark.read.parquet(bounds_of(place))
    files = [r[0] for r in bounds.where((F.col("first") <= F.lit(value)) & (F.col("last") >= F.lit(value))).select("file").collect()]
    whole = spark.read.parquet(place)
    if not files:
        return whole.limit(0)
    return spark.read.schema(whole.schema).parquet(*[f"{place}/{f}" for f in files]).where(F.col(key) == F.lit(value))


def export_order(rows: DataFrame) -> dict[str, Column]:
    """The columns that put records in the export's order: source, conversation, place in it (not the pointers' order as
    texts); what still ties goes by pointer."""
    placed = F.col("position") if "position" in rows.columns else F.lit(0)
    pointer = F.col("provenance.json_pointer")
    index = F.try_element_at(F.split(pointer, "/"), F.lit(2)).try_cast("long")
    return {"_source": F.col("provenance.source_id"), "_index": index, "_placed": placed, "_pointer": pointer}


def lines(rows: DataFrame) -> DataFrame:
    """Rows (line, record_id): records numbered from 1 in the export's order."""
    order = export_order(rows)
    return numbered(rows.select("record_id", *[c.alias(n) for n, c in order.items()]), [*order, "record_id"], "line", "long").select("line", "record_id")


def write_lines(rows: DataFrame, place: str) -> None:
    """Writes the lines of a written table of records to be looked up by number."""
    write(lines(rows), place, "line")


def record(spark: SparkSession, place: str, record_id: str | None = None, line: int | None = None) -> DataFrame:
    """The record of an id, or of a line of the export; the table's lines lie beside it. No rows for one that isn't there."""
    if line is not None:
        row = find(spark, f"{place.rstrip('/')}.lines", "line", line).first()
        if row is None:
            return spark.read.parquet(place).limit(0)
        record_id = row["record_id"]
    return find(spark, place, "record_id", record_id)
