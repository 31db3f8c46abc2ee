"""Empty tables, null keys and repeated rows: every operator gives a defined result."""

import pytest

from attestry.operators import decisions, delta, documents, graph, packets, proposals, ranges, review, runs, units, writer
from attestry.sources import exports, raw_store

NODES = "conversation long, node long, parent long, position long, children_ids array<long>"
SIDE = "conversation string, node string, parent string, message_sha string, context_sha string"


@pytest.fixture(scope="module")
def empty(spark):
    return lambda schema: spark.createDataFrame([], schema)


def test_graphs(empty):
    n = empty(NODES)
    for df in (graph.tree_order(n), graph.selected_path(n, empty("conversation long, current long")), graph.cycle_members(n), graph.children(n), graph.branch_points(n), graph.branch_structure(n), graph.dangling_parents(n), graph.link_mismatches(n),
               graph.conversation_rank(empty("created_at long, original_id string, record_id string")), ranges.numbered(empty("a int"), ["a"], "n")):
        assert df.count() == 0


def test_graphs_with_nulls(spark):
    """Rows without a conversation are a conversation like others; ranks put what has no time first."""
    n = spark.createDataFrame([(None, 1, None, 0, []), (None, 2, 1, 1, []), (5, 1, None, 0, None)], NODES)
    assert sorted(((r["conversation"] or 0), r["node"], r["order"]) for r in graph.tree_order(n).collect()) == [(0, 1, 0), (0, 2, 1), (5, 1, 0)]
    c = spark.createDataFrame([(None if i % 7 == 0 else i % 10, f"{i:03d}", "r") for i in range(200)], "created_at long, original_id string, record_id string")
    want = sorted(((t is not None, t or 0, o) for t, o, _ in (tuple(r) for r in c.collect())))
    got = sorted((r["rank"], r["created_at"] is not None, r["created_at"] or 0, r["original_id"]) for r in graph.conversation_rank(c).collect())
    assert [g[0] for g in got] == list(range(1, 201)) and [g[1:] for g in got] == want


def test_reviews(empty):
    q = empty("message string, segment int, start int, end int, quote string")
    s = empty("message string, segment int, text string")
    p = empty("piece_id string, message string, segment int, start int, end int, conversation long, packet long")
    c = empty("piece_id string, decision_id string")
    j = empty("finding string, completed_at timestamp, outcome string")
    ids = empty("decision_id string, supersedes string")
    gaps = empty("gap string, decision_id string, message_record_id string, message_id string, json_pointer string")
    covered = empty("decision_id string, message string, original_id string, pointer string")
    for df in (review.quote_problems(q, s), review.uncovered_quotes(q, p, c), review.decisions_in_force(ids), review.coverage_overlaps(c), review.pending_packets(p, c), review.latest_dispositions(j), review.review_status(p, c, ids, ids), review.media_gaps(gaps, covered),
               review.missing_members(empty("original_id string"), empty("original_id string")), review.usage_totals(empty("w string, input_tokens long, output_tokens long"), "w"), review.find_quotes(empty("item_id long, quote string"), empty("doc_id long, text string")),
               review.latest_by_decision(empty("batch_id string, completed_at timestamp, decision_ids array<string>")), review.completed(empty("status string, completed_at string"))):
        assert df.count() == 0
    assert review.first_pending(p, c) is None and not review.is_complete({}, []) and review.is_complete({"integrated": 2}, [])
    none = {k: empty(v) for k, v in decisions.SCHEMAS.items()}
    spans = p.select("piece_id", "message", "segment", "start", "end")
    assert decisions.problems(none, spans, s, ids.select("decision_id"), c.select("decision_id", "piece_id"), ids.select("decision_id")).count() == 0


def test_packets(spark, empty):
    pieces = empty("g string, at int, size int")
    for df in (packets.fill_packets(pieces, "g", ["at"], "size", 5), packets.budgeted(pieces, "g", ["at"], "size", 5), packets.started_within(pieces, "g", ["at"], "size", 5), packets.split_spans(empty("text string"), 3), units.units(
        empty("record_id string, provider string, role string, content_kind string, raw string, provenance struct<json_pointer string>"), empty("message_record_id string, segment_index int, json_pointer string, text string, kind string"))):
        assert df.count() == 0
    rows = spark.createDataFrame([(None, 1, 3), (None, 2, 3), ("a", 1, None), ("a", 2, 9), ("a", 3, 1), ("a", 3, 1)], "g string, at int, size int")
    assert sorted((r["g"] or "", r["at"], r["packet"]) for r in packets.fill_packets(rows, "g", ["at"], "size", 5).collect()) == [("", 1, 1), ("", 2, 2), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 3, 3)]
    assert sorted((r["g"] or "", r["at"], r["included"]) for r in packets.budgeted(rows, "g", ["at"], "size", 5).collect()) == [("", 1, True), ("", 2, False), ("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 3, True)]


def test_documents(spark, empty):
    docs = empty("document string, text string")
    scanned = documents.lines(docs)
    found = documents.entries(docs, scanned)
    for df in (scanned, found, documents.source_blocks(docs, scanned), documents.entry_references(found), documents.anchors(scanned), documents.additions(found), documents.audit(docs), writer.parts(docs), writer.problems(writer.parts(docs), writer.parts(docs)),
               writer.report_problems(empty("document string, detailed string, simple string")), documents.misplaced_additions(empty("document string, entry_id string, start int, end int, text string"), empty("document string, entry_id string, title string"))):
        assert df.count() == 0
    nulls = spark.createDataFrame([(None, None), ("d", None), ("d", "")], "document string, text string")
    assert documents.audit(nulls).count() == 0 and writer.problems(writer.parts(nulls)).count() == 0


def test_exports_and_deltas(empty):
    assert exports.payload_groups(empty("provider string, path string, content binary")).count() == 0
    assert exports.duplicate_locations(exports.payload_groups(empty("provider string, path string, content binary"))).first().asDict() == {"duplicate_locations": 0, "payloads": 0}
    side = empty(SIDE)
    assert delta.node_changes(side, side).count() == 0 and {r["n"] for r in delta.counts(delta.node_changes(side, side)).collect()} == {0}
    payloads = empty("payload_sha256 string, content binary")
    found = raw_store.occurrences(raw_store.descriptions(payloads))
    assert found.count() == 0 and raw_store.segment(payloads).count() == 0
    same = delta.compare(found, found, "n")
    assert same.changes.count() == same.ambiguities.count() == 0
    assert proposals.misshapen({}) == ["/: other keys"]
    assert runs.in_scope(empty("provider string, raw_metadata string, original_id string"), "chatgpt", "p").count() == 0
    with pytest.raises(runs.ReviewError):
        runs.in_scope(empty("provider string, raw_metadata string, original_id string"), "chatgpt")


def test_delta_of_one_side(spark):
    side = spark.createDataFrame([("c", "1", None, "a", "x"), ("c", "2", "1", "b", "x"), (None, "1", None, "a", "x")], SIDE)
    none = side.limit(0)
    assert sorted(tuple(r) for r in delta.node_changes(side, none).collect()) == [("c", "1", "not_present_messages"), ("c", "2", "not_present_messages")]
    assert {r["status"] for r in delta.node_changes(none, side).collect()} == {"new_messages"}
