"""Queries and operators do the whole job where the driver's tables don't show it."""

import random

from attestry.operators import documents
from attestry.plans.queries import QUERIES


def test_documents_with_ids_over_9999(spark, tmp_path):
    ids = [0, 7, 9998, 9999, 10000, 12346, 123456]
    docs = spark.createDataFrame([(i, "t", "en", "web", 1) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    number = {str(i): f"{i:04d}" for i in ids}
    assert {r["document"]: r["entry_id"] for r in run("document_entries")} == {d: f"E{n}" for d, n in number.items()}
    assert {r["document"]: r["source_id"] for r in run("document_sources")} == {d: f"src-{n}" for d, n in number.items()}
    assert {(r["document"], r["entry_id"]) for r in run("document_audit")} == {(d, f"E{n}") for d, n in number.items()}
    even = {d: n for d, n in number.items() if int(d) % 2 == 0}
    assert {(r["document"], r["detail"]) for r in run("writer_problems")} >= {(d, f"src-{n}") for d, n in even.items()}


ADDED = """# Book

## E0001 — Garden gate repair
The original letter is not available.

### Later addition
Seeds were sown in the kitchen window boxes 🌱.

### Notes
Nothing.

### Complement from an original message
Straße of the garden.

## E0002 — Seeds sown kitchen window

### Plain heading
Underlying text
unavailable

## E0003 — Kitchen window boxes with seeds sown early
"""


def test_audit_reads_later_additions(spark):
    bundle = "<!-- BEGIN PRESERVED x_master.md -->\n## E0001 — A b\n"
    df = spark.createDataFrame([("d", ADDED), ("b", bundle)], "document string, text string")
    got = sorted((r["document"], r["code"], r["entry_id"], r["detail"]) for r in documents.audit(df).collect())
    entry = ADDED[ADDED.index("## E0001") :]
    start, end = entry.index("### Later"), entry.index("\n### Notes")
    assert got == [
        ("b", "preserved_bundle", None, None),
        ("d", "possible_misplaced_addition", "E0001", f'{{"candidate_entries":["E0002","E0003"],"start":{start},"end":{end}}}'),
        ("d", "possibly_stale_source_limit", "E0001", None),
        ("d", "whole_entry_reconciliation", "E0001", None),
    ]
    found = documents.entries(df, documents.lines(df))
    text = {(r["document"], r["entry_id"]): r["text"] for r in found.collect()}
    placed = documents.additions(found).collect()
    assert len(placed) == 2 and all(text[r["document"], r["entry_id"]][r["start"] : r["end"]] == r["text"] for r in placed)


def test_section_ends_over_gaps(spark, tmp_path):
    rng = random.Random(2)
    ids = sorted(rng.sample(range(0, 3_000_000, 10), 400)) + [9_000_000, 9_000_030]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    want = {i: next((j for j in ids if j > i and j % 3 <= i % 3), i + 50) for i in ids}
    assert {r["start"]: r["end"] for r in QUERIES["section_ends"](spark, str(tmp_path)).collect()} == want


def test_short_quotes(spark, tmp_path):
    text = "one two three four five six seven eight nine ten"
    docs = [(1, text), (2, "five six seven"), (3, "un" + text + "th"), (4, None), (5, "other words")]
    words = text.split(" ")
    quotes = [" ".join(words[i : i + n]) for n in range(1, 11) for i in range(11 - n)] + ["ive six", "s", "absent", " two ", "ne two three four five six sev"]
    items = list(enumerate(quotes))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((i, d, t.index(q), t.index(q) + len(q), "exact") for i, q in items for d, t in docs if t and q in t)
    got = QUERIES["exact_quotes"](spark, str(tmp_path)).select("item_id", "doc_id", "start", "end", "check").collect()
    assert sorted(map(tuple, got)) == want
