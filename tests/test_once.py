"""What several steps of a query read is made once; texts in Python are bounded by bytes."""

import os

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from attestry.functions.batches import slices
from attestry.operators import normalize, packets, runs, writer
from attestry.operators.ranges import range_of
from attestry.operators.rounds import written
from attestry.plans import reviewing, validation

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def counted(spark, df):
    """``df`` and a counter of the rows that any job makes of it."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), made


def made_by(spark, monkeypatch, module, name):
    """Conversations of the export, and how many a query makes of it until it is collected."""
    raw, made = counted(spark, module.raw_chatgpt(spark, SF))
    monkeypatch.setattr(module, "raw_chatgpt", lambda *_: raw)
    getattr(module, name)(spark, SF).collect()
    return made.value


@needs_tables
@pytest.mark.parametrize("name", ["packet_view", "packet_requests", "first_pending"])
def test_a_run_makes_its_export_once(spark, monkeypatch, name):
    assert made_by(spark, monkeypatch, reviewing, name) == 20


@needs_tables
@pytest.mark.parametrize("name", ["validation_files", "validation_messages", "import_statistics"])
def test_a_validation_makes_its_export_once(spark, monkeypatch, name):
    assert made_by(spark, monkeypatch, validation, name) == 20


READ = ("conversations", "nodes", "messages", "segments", "attachments", "warnings")


@needs_tables
def test_all_tables_come_of_one_parse(spark):
    raw, made = counted(spark, reviewing.raw_chatgpt(spark, SF))
    rows = lambda t: {k: sorted(map(str, getattr(t, k).collect())) for k in READ}
    got = rows(normalize.chatgpt(raw, written))
    assert made.value == 20
    assert got == rows(normalize.chatgpt(raw)) and made.value > 40
    talks = reviewing.raw_claude(spark, SF)
    assert rows(normalize.claude(talks, written)) == rows(normalize.claude(talks))


@needs_tables
def test_a_runs_texts_are_dealt_out_once_before_they_are_cut(spark, monkeypatch):
    """What the units have of their conversation and message comes with them; no join deals their texts out again."""
    seen, split = [], packets.split_spans
    monkeypatch.setattr(packets, "split_spans", lambda own, *a: seen.append(own) or split(own, *a))
    t = validation.tables(reviewing.raw_chatgpt(spark, SF), written)
    runs.prepare(t, t["conversations"], 400)
    above = seen[0]._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Join" not in above


@pytest.mark.parametrize("parts", [3, 4, 5, 10, 17, 64, 400])
def test_a_range_is_the_number_of_bounds_passed(spark, parts):
    """So few rows that all are in the sample, so the bounds are known."""
    rows = written(spark.createDataFrame([(f"g{i % 7}", i // 2) for i in range(120)] + [(None, 3)], "g string, i int").select(F.struct("g", "i").alias("k")))
    got = sorted(rows.select("k", range_of(rows, "k", parts).alias("r")).collect(), key=lambda r: ((r.k.g is not None, r.k.g or ""), r.k.i))
    keys = sorted([r.k for r in got], key=lambda k: ((k.g is not None, k.g or ""), k.i))
    bounds = list(dict.fromkeys(keys[len(keys) * i // parts] for i in range(1, parts)))
    assert [r.r for r in got] == [sum(keys.index(b) <= keys.index(r.k) for b in bounds) for r in got]


def test_documents_are_scanned_once(spark):
    docs, seen = counted(spark, spark.createDataFrame([(str(i), f"# T\n## E{i:04d} x\n[l](#nowhere)\n") for i in range(7)], "document string, text string"))
    before, seen_before = counted(spark, spark.createDataFrame([("3", "## E0009 gone\n```\nb\n```\n")], "document string, text string"))
    got = writer.problems(writer.parts(docs), writer.parts(before)).collect()
    assert {"broken_internal_link", "removed_entries", "protected_material_changed"} == {r["code"] for r in got}
    assert (seen.value, seen_before.value) == (7, 1)


def test_slices_bound_the_bytes_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) * 1000 for i in range(5000)]), pa.array(range(5000))], names=["text", "n"])
    got = list(slices([batch, batch.slice(0, 0), batch.slice(10, 1)], 100_000))
    assert len(got) > 100 and [n for b in got for n in b.column(1).to_pylist()] == [*range(5000), 10]
    assert max(sum(map(len, b.column(0).to_pylist())) for b in got) < 200_000
    # a row over the bound is still one slice
    assert [b.num_rows for b in slices([pa.RecordBatch.from_arrays([pa.array(["x" * 500, "y" * 500])], names=["t"])], 10)] == [1, 1]
