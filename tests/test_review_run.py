"""A review from a dataset to an applied batch, with its refusals; report and document checks."""

import json

import pytest

from attestry.operators import decisions, runs, writer
from attestry.operators.census import census
from attestry.operators.normalize import normalize
from attestry.operators.validate import Dataset, table_print
from attestry.sources import exports, files, sinks
from tests.test_import import TALK, TREE

TABLES = ("conversations", "nodes", "messages", "segments", "attachments", "warnings")


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    tree = {**TREE, "conversation_template_id": "p", "mapping": {k: {**v, "message": v["message"]} for k, v in TREE["mapping"].items()}}
    (at / "conversations.json").write_text(json.dumps([tree, {"id": "empty", "conversation_template_id": "p", "mapping": {}, "create_time": 5}], ensure_ascii=False), "utf-8")
    (at / "claude.json").write_text(json.dumps([TALK]), "utf-8")
    sources = [{"provider": "chatgpt", "path": str(at / "conversations.json"), "attachment_root": None}, {"provider": "claude", "path": str(at / "claude.json"), "attachment_root": None}]
    found = exports.inventory(exports.scan(spark, sources)).cache()
    raw = exports.conversations(found).cache()
    own = normalize(raw)
    sinks.publish_tables({t: getattr(own, t) for t in TABLES}, f"{at}/dataset")
    return at, raw, found


def test_a_faithful_dataset_has_no_errors(spark, dataset):
    at, raw, sources = dataset
    tables = {t: spark.read.parquet(f"{at}/dataset/{t}") for t in TABLES}
    frozen = {t: {"records": tables[t].count(), "print": table_print(tables[t])} for t in TABLES}
    d = Dataset(tables, raw, sources, census(raw), {"chatgpt_conversations": 2, "claude_messages": 2}, frozen)
    assert d.errors().collect() == []
    warned = {(r["code"], r["detail"]) for r in d.findings().collect()}
    assert {c for c, _ in warned} == {"unknown_role", "unknown_content", "unknown_part", "attachment_gaps", "missing_creation_times"}
    none = Dataset({t: df.limit(0) for t, df in tables.items()}, raw.limit(0), sources.limit(0), census(raw.limit(0)))
    assert none.findings().count() == 0


def write_document(at):
    runs.init_document(at / "book.md")
    with pytest.raises(files.FileError):
        runs.init_document(at / "book.md")
    return at / "book.md"


def test_run(spark, dataset, tmp_path):
    at, _, _ = dataset
    book = write_document(tmp_path)
    with pytest.raises(runs.ReviewError):
        runs.Run.prepare(spark, at / "dataset", book, tmp_path / "run")
    with pytest.raises(runs.ReviewError, match="no conversations"):
        runs.Run.prepare(spark, at / "dataset", book, tmp_path / "run", project="none")
    run = runs.Run.prepare(spark, at / "dataset", book, tmp_path / "run", project="p", max_chars=12)
    pieces = [r.asDict() for r in run.pieces.orderBy("rank", "packet", "place").collect()]
    # the empty conversation is older and so first
    assert [p["kind"] for p in pieces][0] == "empty_conversation" and {p["rank"] for p in pieces} == {1, 2}
    text = "".join(p["text"] for p in pieces if p["segment_index"] == 0 and p["json_pointer"].endswith("x~1~0y/message/content/parts/0"))
    assert text == "Grüße 🌱\nzwei"
    by_packet: dict = {}
    for p in pieces:
        by_packet.setdefault(p["packet_id"], []).append(p["end"] - p["start"])
    assert all(sum(v) <= 12 for v in by_packet.values())
    assert {p["segment_index"] for p in pieces} >= {-1, 0, 1, -3, -4}
    assert run.pending() == pieces[0]["packet_id"] and run.plan()[0] == pieces[0]["packet_id"]
    shown = run.render(pieces[1]["packet_id"])
    assert "Branch point `x/~y`: `b`, `a`" in shown and "on the selected path" in shown
    load = run.loader()
    request = load(pieces[1]["packet_id"])
    assert request["original_conversation_id"] == "c1" and "provenance" not in json.dumps(request) and "PACKET" in runs.prompt(json.dumps(request))
    # decisions
    first = next(p for p in pieces if p["segment_index"] == 0 and p["start"] == 0)
    quote = {"message_record_id": first["message_record_id"], "segment_index": 0, "start": 0, "end": 5, "text": "Grüße"}
    cover = [{"piece_id": p["piece_id"], "outcome": "distinct_episode" if p is first else "excluded", "reason": "r", "finding_ids": ["F1"] if p is first else []} for p in pieces]
    good = {"decision_id": "D1", "reviewer": "me", "reviewed_at": "2024-01-01", "coverage": cover, "findings": [{"finding_id": "F1", "outcome": "distinct_episode", "attribution": "owner", "reason": "r", "quotes": [quote]}]}
    for change, code in (({"reviewer": ""}, "no_reviewer"), ({"coverage": []}, "no_coverage"), ({"coverage": cover[:1] * 2}, "repeated_piece"), ({"findings": []}, "unknown_finding"), ({"supersedes": "D0"}, "superseded_not_in_force"),
                         ({"findings": [{**good["findings"][0], "quotes": [{**quote, "text": "Gruss"}]}]}, "quote_mismatch"), ({"findings": [{**good["findings"][0], "quotes": [{**quote, "segment_index": -3}]}]}, "quote_of_placeholder"),
                         ({"coverage": [c for c in cover if c["outcome"] == "excluded"]}, "finding_without_piece"), ({"findings": [{**good["findings"][0], "quotes": [{**quote, "message_record_id": "message:?"}]}]}, "quote_mismatch")):
        with pytest.raises(runs.ReviewError, match=code):
            run.record({**good, **change})
    with pytest.raises(runs.ReviewError):
        run.record({**good, "decision_id": "../x"})
    assert run.record(good) == "recorded" and run.record(good) == "already_recorded"
    with pytest.raises(runs.ReviewError):
        run.record({**good, "reviewer": "you"})
    with pytest.raises(runs.ReviewError, match="already_reviewed"):
        run.record({**good, "decision_id": "D2"})
    assert run.pending() is None and {r["state"] for r in run.status().collect()} == {"reviewed_not_integrated"}
    with pytest.raises(runs.ReviewError, match="changed"):
        load(pieces[0]["packet_id"])
    # a batch
    message = run.dataset["messages"].where(f"record_id = '{first['message_record_id']}'").first()
    proof = f"{message['original_id']} {message['provenance']['sha256']} {message['provenance']['json_pointer']}"
    entry = f'## Key information\n\n<a id="e0001"></a>\n\n## E0001 — Greeting\n\n"Grüße" ({proof})\n'
    patches = [{"before": "## Key information\n", "after": entry}]
    settled = {"D1/F1": {"outcome": "integrated", "reason": "r", "entry_ids": ["E0001"]}}
    edits = {"batch_id": "B1", "document_sha256": writer.sha(files.read_text(book)), "decision_ids": ["D1"], "finding_dispositions": settled, "patches": patches}
    for change, why in (({"document_sha256": "0"}, "changed"), ({"finding_dispositions": {}}, "no_disposition"), ({"decision_ids": ["D9"]}, "in force"), ({"patches": [{"before": "## Key information\n", "after": "## Key information\nnothing\n"}]}, "quote_not_in_document"),
                        ({"finding_dispositions": {"D1/F1": {"outcome": "integrated", "reason": "r", "entry_ids": ["E0009"]}}}, "unknown_entry")):
        with pytest.raises(runs.ReviewError, match=why):
            run.draft({**edits, **change}, tmp_path / "bad.json")
    batch = run.draft(edits, tmp_path / "batch.json")
    assert files.read_json(tmp_path / "batch.json") == batch and "+## E0001" in run.preview(batch)
    before = files.read_text(book)
    assert run.apply(batch) == "applied" and run.apply(batch) == "already_applied"
    assert "E0001" in files.read_text(book) and run.summary()["counts"] == {"integrated": 2} and run.summary()["complete"]
    with pytest.raises(runs.ReviewError, match="installed"):
        run.apply({**batch, "batch_id": "B2"})
    # a crash between journal and document is finished by the same batch and blocks others
    journal = tmp_path / "run" / "changes" / "B1.json"
    state = files.read_json(journal)
    files.replace_json(journal, {k: v for k, v in {**state, "status": "installing"}.items() if k != "completed_at"})
    files.replace(book, before)
    with pytest.raises(runs.ReviewError, match="isn't complete"):
        run.apply({**batch, "batch_id": "B3"})
    assert run.apply(batch) == "applied"
    with pytest.raises(runs.ReviewError, match="superseded_installed"):
        run.record({**good, "decision_id": "D2", "supersedes": "D1"})
    files.replace(book, files.read_text(book) + "by hand\n")
    with pytest.raises(runs.ReviewError, match="neither"):
        run.check(batch)


def test_reuse_of_decisions():
    open_ = {"outcome": "unresolved", "reason": "r"}
    done = {"outcome": "excluded", "reason": "r"}
    batch = {"batch_id": "B2", "decision_ids": ["D1"], "finding_dispositions": {"D1/F1": done, "D1/F2": done}}
    prior = {"batch_id": "B1", "batch": {}, "status": "complete", "completed_at": "2024-01-01T00:00:00Z", "decision_ids": ["D1"], "finding_dispositions": {"D1/F1": open_, "D1/F2": done}}
    revision = {"prior_batch_id": "B1", "finding_ids": ["D1/F1"], "reason": "r"}
    check = lambda b, j: decisions.reuse_problems(b, j, {"D1": ["F1", "F2"]})
    assert check(batch, []) == [] and check({**batch, "resolution_revision": revision}, [prior]) == []
    for b, j in (
        (batch, [prior]), ({**batch, "resolution_revision": revision}, []), ({**batch, "resolution_revision": {**revision, "prior_batch_id": "B0"}}, [prior]), ({**batch, "resolution_revision": {**revision, "finding_ids": ["D1/F2"]}}, [prior]),
        ({**batch, "resolution_revision": {**revision, "finding_ids": ["D1/F1", "D1/F1"]}}, [prior]), ({**batch, "resolution_revision": {**revision, "reason": " "}}, [prior]), ({**batch, "resolution_revision": {**revision, "finding_ids": ["D1/F1", "D2/F1"]}}, [prior]),
        ({**batch, "finding_dispositions": {"D1/F1": done, "D1/F2": open_}, "resolution_revision": revision}, [prior]), (batch, [{**prior, "completed_at": "2024-01-01T00:00:00"}]), (batch, [{**prior, "batch_id": "B2"}]),
        ({**batch, "resolution_revision": revision}, [prior, {**prior, "batch_id": "B0", "completed_at": "2024-01-01T01:00:00+01:00"}]),
    ):
        assert check(b, j), (b, j)
    # the latest by moment counts, not by spelling
    later = {**prior, "batch_id": "B0", "completed_at": "2024-01-01T00:30:00+01:00"}
    assert check({**batch, "resolution_revision": revision}, [prior, later]) == []


BOOK = """# Book

Preface.

## E0001 — Garden
**Event period:** spring
Seeds [S](#src-0001) and [gone](#src-0009).

## E0002 — Gate
See [E1](#e0001).

# Recorded decisions

Kept as said.

# Sources

<a id="src-0001"></a>
The exact words of the letter.
"""


def test_writer_keeps_data_and_confirmations(spark):
    before = 'x data:a/b;base64,QUJD y\n<a id="src-027"></a>\nowner said\n\n<a id="src-028"></a>\nagain\n<a id="coverage"></a>\n'
    parts = lambda t: writer.parts(spark.createDataFrame([("d", t)], "document string, text string"))
    codes = lambda after: {(r["code"], r["detail"]) for r in writer.problems(parts(after), parts(before)).collect()}
    assert codes(before) == set() and codes(before.replace("owner said\n\n", "owner said\n")) == set()
    assert codes(before.replace("QUJD", "QUJE")) == codes(before.replace("again", "not")) == {("protected_material_changed", "1")}
    assert ("unclosed_protected_block", None) in codes("```\nopen")
