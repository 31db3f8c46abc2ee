"""Blobs that a store has: told by filters, proved in the folders of their own prefixes; none lost and none twice."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attestry.sources import known, sinks


def blobs(spark, numbers):
    rows = spark.range(0).select("id") if not numbers else spark.createDataFrame([(n,) for n in numbers], "id long")
    content = F.concat(F.lit("blob "), F.col("id").cast("string")).cast("binary")
    return rows.select(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"), content.alias("content"))


def name(n):
    return hashlib.sha256(f"blob {n}".encode()).hexdigest()


def stored(spark, place):
    return sorted(r[0] for r in spark.read.parquet(place).select("sha256").collect())


def test_filters_set_the_bits_of_their_hashes(spark, tmp_path):
    known.add(blobs(spark, range(300)).select("sha256"), f"{tmp_path}/f")
    made = {r["prefix"]: bytes(r["bits"]) for r in spark.read.schema(known.SCHEMA).parquet(f"{tmp_path}/f").collect()}
    want: dict[str, set] = {}
    for n in range(300):
        want.setdefault(name(n)[:2], set()).update(int(name(n)[9 + 4 * i : 13 + 4 * i], 16) % known.BLOCK for i in range(known.ASKED))
    assert {p: {i for i in range(known.BLOCK) if b[i // 8] >> (i % 8) & 1} for p, b in made.items()} == want
    told = {r["sha256"]: r["maybe"] for r in known.maybe(blobs(spark, range(600)).select("sha256"), f"{tmp_path}/f").collect()}
    assert all(told[name(n)] for n in range(300)) and sum(told[name(n)] for n in range(300, 600)) < 30


@pytest.mark.parametrize(("asked", "per_block"), [(known.ASKED, known.PER_BLOCK), (0, known.PER_BLOCK), (known.ASKED, 1)])
def test_no_blob_is_lost_or_repeated(spark, tmp_path, monkeypatch, asked, per_block):
    """Also where every hash is a false positive (no bits asked), and where filters have blocks of several sizes."""
    monkeypatch.setattr(known, "PER_BLOCK", per_block)
    if not asked:
        monkeypatch.setattr(known, "positions", lambda sha="sha256": F.array(F.lit(0)))
    place = f"{tmp_path}/blobs"
    assert sinks.append_blobs(blobs(spark, range(10)), place) == 10
    assert sinks.append_blobs(blobs(spark, [*range(5, 700), 7, 7]), place) == 690
    assert sinks.append_blobs(blobs(spark, range(700)), place) == 0
    assert sinks.append_blobs(blobs(spark, []), place) == 0
    assert stored(spark, place) == sorted(name(n) for n in range(700))
    if per_block == 1:
        digits = [r[0] for r in spark.read.schema(known.SCHEMA).parquet(known.filters_of(place)).select("digits").distinct().collect()]
        assert sorted(digits) == [0, 1]


def test_an_interruption_between_filter_and_blobs(spark, tmp_path):
    place = f"{tmp_path}/blobs"
    sinks.append_blobs(blobs(spark, range(3)), place)
    known.add(blobs(spark, range(3, 9)).select("sha256"), known.filters_of(place))
    assert sinks.append_blobs(blobs(spark, range(9)), place) == 6
    assert stored(spark, place) == sorted(name(n) for n in range(9))


def test_a_store_without_filters_gets_them(spark, tmp_path):
    place = f"{tmp_path}/blobs"
    blobs(spark, range(20)).withColumn("prefix", known.prefix()).write.partitionBy("prefix").parquet(place)
    assert sinks.append_blobs(blobs(spark, range(25)), place) == 5
    assert stored(spark, place) == sorted(name(n) for n in range(25))


def test_few_blobs_read_few_folders(spark, tmp_path):
    place = f"{tmp_path}/blobs"
    sinks.append_blobs(blobs(spark, range(600)), place)
    asked = known.maybe(blobs(spark, [1, 2]).select("sha256"), known.filters_of(place)).where("maybe")
    found = known.stored(asked, place)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan
    scanned = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert {f.split("prefix=")[1][:2] for f in scanned} == {name(1)[:2], name(2)[:2]}
