"""Rules compiled into one pass, and all findings of a dataset against those of its groups."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestry.operators import validate
from attestry.plans import validation as plans

SF = "/root/testdata/sf0.001"


def test_broken_gives_each_rule_that_a_record_breaks(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 5), ("c", None), ("b", 5)], "record_id string, n int")
    rules = [("small", F.col("n") < 3, F.col("n")), ("odd", F.col("n") % 2 == 1, F.lit("x")), ("none", F.col("n").isNull(), F.lit(None))]
    got = Counter(map(tuple, validate.broken(rows, rules).collect()))
    assert got == Counter([("small", "a", "1"), ("odd", "a", "x"), ("odd", "b", "x"), ("odd", "b", "x"), ("none", "c", None)])
    assert validate.broken(rows.limit(0), rules).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_findings_are_those_of_all_groups(spark):
    def change(t):
        m = t["messages"]
        lost = F.col("record_id").startswith("message:0")
        return {
            "messages": m.withColumn("role", F.when(lost, "nobody").otherwise(F.col("role"))).withColumn("conversation_record_id", F.when(F.col("record_id").endswith("1"), "gone").otherwise(F.col("conversation_record_id"))).withColumn("schema_version", F.lit("0")),
            "conversations": t["conversations"].withColumn("title", F.lit("other")).withColumn("created_at_raw", F.lit("never")),
        }

    d = plans.dataset(spark, SF, change)
    groups = (d.identity, d.uniqueness, d.integrity, d.coverage, d.conversations, d.messages, d.attachments, d.timestamps, d.graph, d.warnings, d.refused)
    apart = sum((Counter(map(tuple, g().collect())) for g in groups), Counter())
    assert Counter(map(tuple, d.findings().collect())) == apart
    assert {"record_version", "title_fidelity", "invalid_timestamp", "conversation_reference", "timestamp_fidelity"} <= {code for code, _, _ in apart}
