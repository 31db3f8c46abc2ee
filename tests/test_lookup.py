"""Single records out of sorted tables: by id and by line, out of one row group."""

from pyspark.sql import functions as F

from attestry.sources import lookup, sinks


def records(spark, n):
    """Two sources; the second conversation index as text sorts before the ninth."""
    at = spark.range(n).withColumn("source", F.when(F.col("id") < n // 3, "s1").otherwise("s2")).withColumn("conversation", F.floor(F.col("id") / 5))
    pointer = F.concat(F.lit("/"), F.col("conversation"), F.lit("/mapping/"), F.col("id"), F.lit("/message"))
    provenance = F.struct(F.col("source").alias("source_id"), pointer.alias("json_pointer"))
    return at.select(F.concat(F.lit("message:"), F.sha2(F.col("id").cast("string"), 256)).alias("record_id"), provenance.alias("provenance"), "id", (F.col("id") % 5).alias("position"))


def scanned(df):
    """Rows that the plan's file scans gave, once it has run."""
    df._jdf.collectToPython()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        rows += leaves.apply(i).metrics().apply("numOutputRows").value()
    return rows


def test_lines_are_the_exports_order(spark, tmp_path):
    place = f"{tmp_path}/out/messages"
    sinks.publish_tables({"messages": records(spark, 300).orderBy(F.rand(3))}, f"{tmp_path}/out")
    got = {r["line"]: r["record_id"] for r in spark.read.parquet(f"{place}.lines").collect()}
    want = {r["id"] + 1: r["record_id"] for r in records(spark, 300).collect()}
    assert got == want
    for line in (1, 2, 100, 101, 300):
        assert [r["id"] for r in lookup.record(spark, place, line=line).collect()] == [line - 1]
        assert [r["id"] for r in lookup.record(spark, place, want[line]).collect()] == [line - 1]
    for absent in ({"line": 0}, {"line": 301}, {"record_id": "message:0"}, {"record_id": "zzz"}, {"record_id": ""}):
        assert lookup.record(spark, place, **absent).collect() == []
    assert not [p for p in (tmp_path / "out").iterdir() if "unsorted" in p.name]


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    place, rows = f"{tmp_path}/t", records(spark, 20_000)
    lookup.write(rows, place, "record_id", {"parquet.block.row.count.limit": "500"})
    wanted = rows.where("id = 12345").first()["record_id"]
    found = lookup.find(spark, place, "record_id", wanted)
    assert len(found.inputFiles()) == 1 and "PushedFilters: [IsNotNull(record_id), EqualTo(record_id" in found._jdf.queryExecution().executedPlan().toString()
    assert 1 <= scanned(found) <= 500
    assert [r["id"] for r in found.collect()] == [12345]


def test_repeated_and_missing_keys(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    lookup.write(rows, f"{tmp_path}/t", "k")
    assert sorted(r["v"] for r in lookup.find(spark, f"{tmp_path}/t", "k", "a").collect()) == [1, 2]
    assert lookup.find(spark, f"{tmp_path}/t", "k", "c").collect() == []
    lookup.write(rows.limit(0), f"{tmp_path}/e", "k")
    assert lookup.find(spark, f"{tmp_path}/e", "k", "a").collect() == []
