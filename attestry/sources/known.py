"""Which blobs a store has, told without a scan of the store.

Beside the blobs lie Bloom filters of their hashes, by the prefix that the blobs' folders are named by. A hash asks one
block of each filter; what no filter has is new. The rest, false positives among it, is looked up exactly, in the folders
of its own prefixes alone. Filters are written before blobs are, so an interruption leaves a filter that has too much,
never a blob that no filter has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import rounds

#: Bits of a block: those of bitmap_construct_agg.
BLOCK = 32768
#: Bits that a hash sets, and the hashes that a block is made for: under 1 % of others find all their bits set.
ASKED, PER_BLOCK = 5, 3000
#: Digits of a hash: the first two are the prefix, up to seven after them name a block, those from here on its bits.
BITS_FROM, MOST_DIGITS = 10, 7

SCHEMA = "digits int, block string, bits binary, prefix string"


def filters_of(blobs: str) -> str:
    """Where the filters of a table of blobs lie."""
    return f"{blobs.rstrip('/')}.filters"


def prefix(sha: str = "sha256") -> Column:
    return F.substring(sha, 1, 2)


def positions(sha: str = "sha256") -> Column:
    """The bits of a block that a hash sets."""
    four = [F.conv(F.substring(sha, BITS_FROM + 4 * i, 4), 16, 10).cast("int") for i in range(ASKED)]
    return F.array(*[n % BLOCK for n in four])


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def add(hashes: DataFrame, filters: str) -> int:
    """Adds a filter of ``hashes`` (sha256). The more there are, the more blocks it has, so that it stays as sharp. Returns
    how many digits name a block."""
    n, digits = hashes.count(), 0
    while digits < MOST_DIGITS and n > 256 * 16**digits * PER_BLOCK:
        digits += 1
    bits = hashes.select(prefix().alias("prefix"), F.substring("sha256", 3, digits).alias("block"), F.explode(positions()).alias("bit"))
    made = bits.groupBy("prefix", "block").agg(F.bitmap_construct_agg("bit").alias("bits")).withColumn("digits", F.lit(digits))
    made.select("digits", "block", "bits", "prefix").write.mode("append").partitionBy("prefix").parquet(filters)
    return digits


def maybe(hashes: DataFrame, filters: str) -> DataFrame:
    """``hashes`` (sha256), once each, with ``maybe``: whether a filter has it. False is sure."""
    spark, own = hashes.sparkSession, hashes.select("sha256").distinct().withColumn("prefix", prefix())
    made = spark.read.schema(SCHEMA).parquet(filters)
    sizes = [r[0] for r in made.select("digits").distinct().collect()]  # at most MOST_DIGITS + 1
    asked = F.array(*[F.struct(F.lit(d).alias("digits"), F.substring("sha256", 3, d).alias("block")) for d in sizes])
    byte = lambda at: F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    in_block = F.forall(positions(), lambda at: F.getbit(byte(at), at % 8) == 1)
    asking = own.withColumn("_ask", F.explode(asked)).select("sha256", "prefix", "_ask.*")
    hit = asking.join(made, ["prefix", "digits", "block"]).where(in_block).select("sha256").distinct()
    marked = own.join(hit.withColumn("maybe", F.lit(True)), "sha256", "left")
    return marked.select("sha256", "prefix", F.coalesce("maybe", F.lit(False)).alias("maybe"))


def stored(asked: DataFrame, blobs: str) -> DataFrame:
    """The stored hashes in the prefix folders of ``asked`` (prefix); no more than 256 prefixes exist."""
    wanted = sorted(r[0] for r in asked.select("prefix").distinct().collect())
    return asked.sparkSession.read.parquet(blobs).where(F.col("prefix").isin(wanted)).select("sha256")


def had(hashes: DataFrame, blobs: str) -> DataFrame:
    """Rows (sha256) of those ``hashes`` that the store has, written once. Nothing where there is no store. A store
    without filters, as older ones are, gets them from its blobs first."""
    spark = hashes.sparkSession
    if not _there(spark, blobs):
        return spark.createDataFrame([], "sha256 string")
    filters = filters_of(blobs)
    if not _there(spark, filters):
        add(spark.read.parquet(blobs).select("sha256"), filters)
    found = rounds.written(maybe(hashes, filters).where("maybe").select("sha256", "prefix"))
    return rounds.written(found.join(stored(found, blobs), "sha256", "left_semi").select("sha256"), found)
