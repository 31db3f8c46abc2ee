import json
import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import identity as I
from attestry.functions import text as T
from attestry.operators import delta, documents, graph, packets, proposals, review, validate
from attestry.sources import raw_store, sinks


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_identity_functions(spark):
    df = spark.createDataFrame([("a~/b", '{"b":1,"a":[{"x~/y":"é"}]}', "/a/0/x~0~1y"), ("", "[1e999]", "/0"), (None, None, None)], "k string, j string, p string")
    got = df.select(
        I.pointer_token(F.col("k")).alias("t"), I.pointer_key(I.pointer_token(F.col("k"))).alias("b"),
        I.resolve_pointer("j", "p").alias("v"), I.canonical_fingerprint()("j").alias("c"), I.canonical_fingerprint(ascii_only=True)("j").alias("d"),
    ).collect()
    assert (got[0]["t"], got[0]["b"], got[0]["v"]) == ("a~0~1b", "a~/b", '"é"')
    assert got[0]["c"] != got[0]["d"]
    assert got[1]["v"] is None and got[1]["c"] is None and got[2]["t"] is None
    one = spark.range(1).select(I.struct_fingerprint(b=F.lit(1), a=F.lit(None).cast("string")).alias("x"), I.sha256(F.lit('{"a":null,"b":1}')).alias("y")).first()
    assert one["x"] == one["y"]


def test_text_functions(spark):
    df = spark.createDataFrame([("# A <b>B</b> [c](x), ü!", "a `` b ```` c", "see [x](#src-1%20b+c) [y](#e1)")], "h string, f string, l string")
    got = df.select(T.slug(F.col("h")), T.fence(F.col("f")), T.link_targets(F.col("l")), T.occurrences(F.col("f"), F.lit("``")), T.replace_once(F.col("f"), F.lit("a "), F.lit("z ")), T.replace_once(F.col("f"), F.lit("``"), F.lit("")), T.long_words(F.lit("Ab abc ABC über x1"))).first()
    assert tuple(got) == ("-a-b-c-ü", "`````", ["src-1 b+c", "e1"], 3, "z `` b ```` c", None, ["abc", "über"])
    times = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("1.5",), ("2024-01-01T00:00:00",), ("true",), (None,)], "t string")
    assert [r[0] for r in times.select(T.timestamp_state(F.col("t"))).collect()] == ["valid", "valid", "invalid", "invalid", "missing"]


def test_graph_random_trees(spark):
    rng = random.Random(3)
    data = []
    for c in range(30):
        n = rng.randint(1, 12)
        ids = list(range(n))
        rng.shuffle(ids)
        for i, x in enumerate(ids):
            data.append((c, x, ids[rng.randrange(i)] if i and rng.random() < 0.9 else None, rng.randrange(100) * 100 + x))
    got = {(r["conversation"], r["node"]): r["order"] for r in graph.tree_order(spark.createDataFrame(data, "conversation int, node int, parent int, position int")).collect()}
    for c in range(30):
        own = [d for d in data if d[0] == c]

        def walk(p):
            for d in sorted((d for d in own if d[2] == p), key=lambda d: d[3]):
                yield d[1]
                yield from walk(d[1])

        assert [got[c, x] for x in walk(None)] == list(range(len(own)))


def test_cycles_and_strict_order(spark):
    n = spark.createDataFrame([(1, "a", "b", 0), (1, "b", "a", 1), (1, "c", "a", 2), (2, "d", None, 0)], "conversation int, node string, parent string, position int")
    assert rows(graph.cycle_members(n), "node") == [("a",), ("b",)]
    assert rows(graph.tree_order(n, strict=False).where("order is null"), "node") == [("a",), ("b",), ("c",)]
    with pytest.raises(Exception, match="cycle"):
        graph.tree_order(n).collect()


def test_packets_against_a_loop(spark):
    rng = random.Random(1)
    data = [(g, i, rng.choice([0, 1, 5, 9, 10])) for g in range(20) for i in range(rng.randint(1, 15))]
    got = {(r["g"], r["i"]): r["packet"] for r in packets.fill_packets(spark.createDataFrame(data, "g int, i int, size int"), "g", ["i"], "size", 10).collect()}
    for g in range(20):
        packet, used = 1, 0
        for _, i, n in (d for d in data if d[0] == g):
            if used + n > 10:
                packet, used = packet + (i > 0), 0
            used += n
            assert got[g, i] == packet
    text = "ab🌱d" * 7
    s = packets.split_spans(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string"), 5)
    assert "".join(r["piece"] for r in s.where("k = 1").orderBy("start").collect()) == text
    assert rows(s.where("k > 1"), "k", "start", "end") == [(2, 0, 0)]


def test_delta_statuses(spark):
    schema = "conversation string, node string, parent string, message_sha string, context_sha string"
    a = spark.createDataFrame([("c", "r", None, None, "0"), ("c", "m", "r", "1", "1"), ("c", "n", "m", "2", "2"), ("c", "o", "r", "3", "3"), ("d", "x", None, "9", "9")], schema)
    b = spark.createDataFrame([("c", "r", None, None, "0"), ("c", "m", "r", "1b", "1"), ("c", "n", "m", "2", "2"), ("c", "o", "r", "3", "3"), ("c", "p", "o", "4", "4")], schema)
    assert rows(delta.node_changes(a, b), "node", "status") == [("m", "changed_messages"), ("n", "context_changed_messages"), ("o", "unchanged_messages"), ("p", "new_messages"), ("x", "not_present_messages")]
    c = spark.createDataFrame([(None, "a"), ("k", "a"), ("k", "a"), ("l", "a")], "conversation string, metadata_sha string")
    good, bad = delta.usable(c)
    assert rows(good, "conversation") == [("l",)] and rows(bad, "issue") == [("duplicate_conversation_id",), ("missing_conversation_id",)]
    empty = spark.createDataFrame([], schema)
    assert {r["n"] for r in delta.counts(delta.node_changes(empty, empty)).collect()} == {0}


def test_review_ambiguity_and_validation(spark):
    j = spark.createDataFrame([("f", "2024-01-01", "a"), ("f", "2024-01-02", "b"), ("g", "2024-01-01", "a"), ("g", "2024-01-01", "b")], "finding string, completed_at string, outcome string")
    assert rows(review.latest_dispositions(j), "finding", "outcome", "ambiguous")[0] == ("f", "b", False)
    assert rows(review.latest_dispositions(j), "finding", "ambiguous")[1] == ("g", True)
    n = spark.createDataFrame([("c", "a", None, ["b", "b"]), ("c", "b", "a", None), ("c", "z", "gone", [])], "conversation string, node string, parent string, children_ids array<string>")
    assert rows(validate.histogram(validate.graph_rules(n)), "code") == [("dangling_parent",), ("duplicate_child",)]


DOC = """# Subject

| [E0001](#e0001) | Old title | x |

<a id="e0001"></a>
## E0001 — First thing
**Source references:** [S](#src-001)

Body [S](#src-002) and [gone](#src-9) text.

```text
## E0009 — hidden
[no](#src-7)
```

<a id="e0002"></a>
### E0002 — Second
More.

# Sources

<a id="src-001"></a>
quoted

<a id="src-002"></a>
<!-- ARCHIVED_TEXT_BEGIN k -->
## E0003 — archived
<!-- ARCHIVED_TEXT_END k -->
"""


def test_documents(spark):
    docs = spark.createDataFrame([("d", DOC), ("open", "```\nx"), ("empty", ""), ("null", None)], "document string, text string")
    scanned = documents.lines(docs).cache()
    e = {r["entry_id"]: r for r in documents.entries(docs, scanned).collect()}
    assert set(e) == {"E0001", "E0002"}
    assert e["E0001"]["title"] == "First thing" and e["E0001"]["text"].endswith("```\n") and e["E0002"]["text"] == "### E0002 — Second\nMore.\n"
    assert DOC[e["E0001"]["start"] :].startswith("## E0001")
    b = {r["source_id"]: r["text"] for r in documents.source_blocks(docs, scanned).collect()}
    assert b["src-001"] == "\nquoted\n\n" or b["src-001"] == "quoted\n\n"
    codes = rows(documents.audit(docs), "document", "code", "detail")
    assert codes == [
        ("d", "body_sources_missing_from_header", "src-002"),
        ("d", "body_sources_missing_from_header", "src-9"),
        ("d", "external_or_missing_target", "src-9"),
        ("d", "stale_index_title", "Old title"),
        ("open", "unclosed_block", None),
    ]
    assert ("d", "e0001") in rows(documents.anchors(scanned), "document", "target")


def test_raw_store_restores_bytes(spark):
    tree = [{"id": "c", "mapping": {"a": {"message": {"t": "ü\\ud800"}, "children": []}, "b": {"message": None}}}, {"id": "d", "mapping": {"a": {"message": {"t": "ü\\ud800"}}}}]
    payloads = [("﻿" + json.dumps(tree, ensure_ascii=False).replace("\\\\u", "\\u") + "\r\n").encode(), json.dumps(tree, indent=2).encode(), b"not json", b"[]"]
    df = spark.createDataFrame([(bytearray(p),) for p in payloads], "content binary").withColumn("payload_sha256", F.sha2("content", 256))
    parts = raw_store.segment(df).cache()
    blobs = raw_store.new_blobs(parts).cache()
    back = raw_store.restore(raw_store.recipe(parts), blobs).collect()
    assert sorted(bytes(r["content"]) for r in back) == sorted(payloads) and all(r["intact"] for r in back)
    assert blobs.count() < parts.count()
    report = raw_store.ingest_report(parts, blobs).first()
    assert report["new_blobs"] == 0 and report["reused_blobs"] == blobs.count()


def test_proposals(spark):
    pieces = spark.createDataFrame([("p", "1", "hello there", "user", "text", 0, False), ("p", "2", "as I said", "assistant", "text", 0, False), ("p", "3", "old", "user", "text", 0, True)], "packet string, piece_id string, text string, role string, kind string, segment_index int, already_covered boolean")
    coverage = spark.createDataFrame([("p", "1", "candidate", "why", ["a"]), ("p", "2", "none", "why", [])], "packet string, piece_id string, disposition string, reason string, candidate_ids array<string>")
    candidates = spark.createDataFrame([("p", "a", "owner_statement", "says hello")], "packet string, candidate_id string, attribution string, statement string")
    evidence = spark.createDataFrame([("p", "a", "1", 0, 5, "hello")], "packet string, candidate_id string, piece_id string, start int, end int, quote string")
    assert proposals.problems(pieces, coverage, candidates, evidence).count() == 0
    wrong = evidence.withColumn("quote", F.lit("hallo")).withColumn("piece_id", F.lit("2"))
    assert rows(proposals.problems(pieces, coverage, candidates, wrong), "code") == [("assistant_as_owner",), ("links_differ",), ("links_differ",), ("owner_without_user_text",), ("quote_mismatch",)]


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    sinks.publish_tables({"t": df}, f"{tmp_path}/out", lambda t: t["t"].where("id > 9"))
    assert spark.read.parquet(f"{tmp_path}/out/t").count() == 5
    with pytest.raises(sinks.PublishError):
        sinks.publish_tables({"t": df}, f"{tmp_path}/out")
    with pytest.raises(sinks.PublishError):
        sinks.publish_tables({"t": df}, f"{tmp_path}/two", lambda t: t["t"].where("id > 3"))
    assert not (tmp_path / "two").exists() and not (tmp_path / "two.staging").exists()
    blobs = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),)], "content binary").select(F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"), "content")
    assert [sinks.append_blobs(blobs, f"{tmp_path}/blobs") for _ in range(2)] == [2, 0]
    j = sinks.Journal(spark, f"{tmp_path}/j")
    assert [j.install("b1", df), j.install("b1", df)] == ["installed", "already_installed"]
    with pytest.raises(sinks.PublishError):
        j.install("b1", spark.range(6))
    j._note("b2", "x", "installing")
    with pytest.raises(sinks.PublishError):
        j.install("b3", df)
