"""Places, joins and graph helpers that several operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
#: Rows of one key that a task of spread_join() or of a stream takes at least, and how many keys can have more.
ROWS, MOST_HOT = 250, 100_000
#: The same for the pairs of a vertex, whose tables are small.
FEW = 100


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary folder;
    a cluster's executors have no folder in common then, so it is refused there."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="attestry-"))
    return _own[0]


def materialise(df: DataFrame, *used: DataFrame) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: the lineage is cut, and a lost executor costs no more
    than a reread. ``used`` are tables of earlier calls that nothing reads after this; their files go at once, the
    others' when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/attestry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attestry_path = path
    discard(*used)
    return out


def materialise_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As materialise(), the rows dealt into ``buckets`` by ``key``: what groups or joins by it needs no shuffle of them."""
    spark = df.sparkSession
    name = f"attestry_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    atexit.register(_drop, spark, name)
    out = spark.table(name)
    out._attestry_path = f"{shared_dir(spark).rstrip('/')}/{name}"
    return out


def discard(*used: DataFrame) -> None:
    """Deletes the files of tables that materialise() wrote and nothing will read any more."""
    for df in used:
        if path := getattr(df, "_attestry_path", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is None:
            return
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; then the folder's owner clears it
        return


def _drop(spark: SparkSession, name: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            spark.sql(f"drop table if exists {name}")
            _delete(spark, f"{shared_dir(spark).rstrip('/')}/{name}")
    except Exception:  # noqa: BLE001  as in _delete
        return


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's values: rows with equal values share it, whatever repeats of an id there are. A null is
    told from a value that isn't there: (null, x) and (x, null) differ."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def hot_keys(rows: DataFrame, keys: list[str], least: int = ROWS, total: int | None = None) -> tuple[DataFrame, int]:
    """(keys, salts) of the keys that have more than ``most`` of the rows, and ``most``: over how many tasks to spread
    each. ``most`` grows with the table so that fewer than MOST_HOT keys can have more, which bounds their broadcast.
    ``rows`` is read more than once: give a written table."""
    total = rows.count() if total is None else total
    most = max(least, -(-total // MOST_HOT))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return counted.select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_salts")), most


def spread_join(many: DataFrame, one: DataFrame, key: str, spread: Column, how: str = "inner", least: int = ROWS) -> DataFrame:
    """``many`` joined on ``key`` with ``one``, which has at most one row for each key. The rows of a key that a large
    part of ``many`` has are dealt over as many tasks as their number asks for, by the hash of ``spread``; the row of
    ``one`` goes to each. ``many`` is read more than once: give a written table. Null keys meet nothing."""
    hot, _ = hot_keys(many.where(F.col(key).isNotNull()), [key], least)
    hot = F.broadcast(hot.withColumnRenamed("_salts", "_of"))
    left = many.join(hot, key, "left").withColumn("_salt", F.when(F.col("_of").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_of"))).otherwise(F.lit(0)).cast("int")).drop("_of")
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_of"), F.lit(1)) - 1))).drop("_of")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _least_first(rows: DataFrame, least: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` (key, other) with ``first``, the least ``other`` of the key in ``rows`` and ``least`` (at most a row for
    each key), once for each pair and stream; ``origin`` marks the pairs of ``rows``. One shuffle, streamed in order by a window; the
    rows of a key in ``hot`` (key, _salts) take several streams, and its row of ``least`` goes to each."""
    hot = F.broadcast(hot)
    # by place in the written table, as equal pairs of a hot key have one hash
    one = F.when(F.col("_salts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    dealt = rows.join(hot, "key", "left").select("key", "other", one.alias("salt"), F.lit(True).alias("origin"))
    dealt = dealt.unionByName(least.join(hot, "key", "left").select("key", "other", every.alias("salt"), F.lit(False).alias("origin")))
    stream = Window.partitionBy("key", "salt").orderBy("other", F.desc("origin"))
    marked = dealt.withColumns({"first": F.first("other").over(stream), "prior": F.lag("other").over(stream)})
    return marked.where(F.col("origin") & (F.col("prior").isNull() | (F.col("prior") != F.col("other"))))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): each vertex with its component's least vertex, as (v, root).

    Alternates the large-star and small-star steps, each a shuffle whose sorted rows are streamed; a vertex with very many
    neighbours on either side takes as many streams as their number asks for. Every step is written, which bounds the
    plan, and the one before is deleted. Vertices without an edge to another vertex don't appear.
    """
    now = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    state = None
    for _ in range(rounds):
        # the same edges as before the round: each vertex has one parent, which is a root
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(v, u))")).first())
        if found == state:
            break
        state = found
        # every larger neighbour of a vertex goes to the least one of it, or to itself
        larger = now.select(F.col("v").alias("key"), F.col("u").alias("other"))
        least = now.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("other"))
        large = _least_first(larger, least, hot_keys(larger, ["key"], FEW, found[0])[0])
        large = materialise(large.select(F.col("other").alias("key"), F.least("first", "key").alias("other")), now)
        # a vertex goes to its least neighbour, and so do its other neighbours
        least = large.groupBy("key").agg(F.min("other").alias("other"))
        small = _least_first(large, least, hot_keys(large, ["key"], FEW)[0])
        now = materialise(small.select(F.when(F.col("other") == F.col("first"), F.col("key")).otherwise(F.col("other")).alias("u"), F.col("first").alias("v")), large)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select("v").distinct().select("v", F.col("v").alias("root")))
