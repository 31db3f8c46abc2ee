"""Checks of review decisions and of the batches that carry them into a document, over all decisions at once.

Decisions come as four tables: decisions (decision_id, reviewer, reviewed_at, supersedes), coverage (decision_id, piece_id,
outcome, reason, finding_ids), findings (decision_id, finding_id, outcome, attribution, reason) and quotes (decision_id,
finding_id, message, segment, start, end, text). Every check gives rows (decision_id, code, item); an empty table gives
none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import intervals, needles
from attestry.operators.review import quote_problems, uncovered_quotes

#: Outcomes of review, those that need a finding, and those of a finding's place in a document.
OUTCOMES = ("already_represented", "complementary_detail", "distinct_episode", "uncertain_overlap", "excluded")
MATERIAL = ("complementary_detail", "distinct_episode", "uncertain_overlap")
DISPOSITIONS = ("integrated", "already_represented", "excluded", "unresolved")

SCHEMAS = {
    "decisions": "decision_id string, reviewer string, reviewed_at string, supersedes string",
    "coverage": "decision_id string, piece_id string, outcome string, reason string, finding_ids array<string>",
    "findings": "decision_id string, finding_id string, outcome string, attribution string, reason string",
    "quotes": "decision_id string, finding_id string, message string, segment int, start int, end int, text string",
}


def as_tables(spark: SparkSession, documents: list[dict]) -> dict[str, DataFrame]:
    """The four tables of decision documents (JSON objects)."""
    rows: dict[str, list] = {k: [] for k in SCHEMAS}
    for d in documents:
        did = d.get("decision_id")
        rows["decisions"].append((did, d.get("reviewer"), d.get("reviewed_at"), d.get("supersedes")))
        rows["coverage"] += [(did, c.get("piece_id"), c.get("outcome"), c.get("reason"), c.get("finding_ids") or []) for c in d.get("coverage") or []]
        for f in d.get("findings") or []:
            rows["findings"].append((did, f.get("finding_id"), f.get("outcome"), f.get("attribution"), f.get("reason")))
            rows["quotes"] += [(did, f.get("finding_id"), q.get("message_record_id"), q.get("segment_index"), q.get("start"), q.get("end"), q.get("text")) for q in f.get("quotes") or []]
    return {k: spark.createDataFrame(rows[k], s) for k, s in SCHEMAS.items()}


def _rows(df: DataFrame, code: str, item: str) -> DataFrame:
    return df.select("decision_id", F.lit(code).alias("code"), F.col(item).cast("string").alias("item"))


def _blank(name: str):
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def problems(new: dict[str, DataFrame], pieces: DataFrame, segments: DataFrame, in_force: DataFrame, covered: DataFrame, installed: DataFrame) -> DataFrame:
    """What keeps decisions from being recorded.

    ``pieces``: piece_id, message, segment, start, end of the run; ``segments``: message, segment, text; ``in_force``:
    decision_id of recorded decisions that none supersedes; ``covered``: decision_id, piece_id of these; ``installed``:
    decision_id of those that a batch has begun to install or has.
    """
    d, c, f, q = (new[k] for k in SCHEMAS)
    ids = d.select("decision_id", "supersedes")
    twice = lambda df, *keys: df.groupBy(*keys).count().where("count > 1")
    named = c.select("decision_id", F.explode("finding_ids").alias("finding_id")).distinct()
    known = f.select("decision_id", "finding_id")
    # what the decision's predecessor covered is free again
    others = c.join(covered.withColumnRenamed("decision_id", "_by"), "piece_id").join(ids, "decision_id").where(~F.col("_by").eqNullSafe(F.col("supersedes")))
    spans = q.withColumnRenamed("text", "quote")
    exact = spans.where("segment >= 0")
    # pieces that a quote touches must be covered by its own decision or by one in force
    touched = uncovered_quotes(spans.drop("quote"), pieces, covered.select("piece_id"))
    open_ = touched.join(c.select("decision_id", "piece_id"), ["decision_id", "piece_id"], "left_anti")
    places = pieces.select("message", "segment", F.col("start").alias("_s"), F.col("end").alias("_e"))
    key = ["decision_id", "finding_id", "message", "segment", "start", "end"]
    apart = intervals.overlapping(spans.select(key), places, ["message", "segment"], ("start", "end"), ("_s", "_e")).select(key)
    parts = [
        _rows(d.where(~F.coalesce(F.col("decision_id").rlike("^[A-Za-z0-9_-]+$"), F.lit(False))), "unsafe_id", "decision_id"),
        _rows(d.where(_blank("reviewer") | _blank("reviewed_at")), "no_reviewer", "decision_id"),
        _rows(d.join(c, "decision_id", "left_anti"), "no_coverage", "decision_id"),
        _rows(ids.where("supersedes is not null").join(in_force.select(F.col("decision_id").alias("supersedes")), "supersedes", "left_anti"), "superseded_not_in_force", "supersedes"),
        _rows(ids.join(installed.select(F.col("decision_id").alias("supersedes")).distinct(), "supersedes", "left_semi"), "superseded_installed", "supersedes"),
        _rows(twice(f, "decision_id", "finding_id"), "repeated_finding", "finding_id"),
        _rows(c.join(pieces.select("piece_id"), "piece_id", "left_anti"), "unknown_piece", "piece_id"),
        _rows(twice(c, "decision_id", "piece_id"), "repeated_piece", "piece_id"),
        _rows(others, "already_reviewed", "piece_id"),
        _rows(c.where(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)) | _blank("reason")), "coverage_unexplained", "piece_id"),
        _rows(named.join(known, ["decision_id", "finding_id"], "left_anti"), "unknown_finding", "finding_id"),
        _rows(c.where(F.col("outcome").isin(*MATERIAL) & (F.size("finding_ids") == 0)), "material_without_finding", "piece_id"),
        _rows(known.join(named, ["decision_id", "finding_id"], "left_anti"), "finding_without_piece", "finding_id"),
        _rows(f.where(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)) | _blank("reason")), "finding_unexplained", "finding_id"),
        _rows(f.where(_blank("attribution")), "no_attribution", "finding_id"),
        _rows(f.where(F.col("outcome").isin(*MATERIAL)).join(q, ["decision_id", "finding_id"], "left_anti"), "material_without_quote", "finding_id"),
        _rows(spans.where("segment < 0"), "quote_of_placeholder", "finding_id"),
        _rows(quote_problems(exact, segments), "quote_mismatch", "finding_id"),
        _rows(spans.join(apart, ["decision_id", "finding_id", "message", "segment", "start", "end"], "left_anti").unionByName(open_.select(*spans.drop("quote").columns).withColumn("quote", F.lit(None).cast("string"))), "quote_not_covered", "finding_id"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def linked(findings: DataFrame, coverage: DataFrame) -> DataFrame:
    """Findings (decision_id, finding_id) that no covered piece names."""
    named = coverage.select("decision_id", F.explode("finding_ids").alias("finding_id")).distinct()
    return findings.select("decision_id", "finding_id").join(named, ["decision_id", "finding_id"], "left_anti")


def disposition_problems(findings: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Rows (decision_id, code, item) for the findings of a batch's decisions: no_disposition (none, of an unknown
    outcome, or without a reason), integrated_without_entry. ``dispositions``: key (decision/finding), outcome, reason,
    entry_ids."""
    keyed = findings.select("decision_id", "finding_id", F.concat_ws("/", "decision_id", "finding_id").alias("key")).join(dispositions, "key", "left")
    none = ~F.coalesce(F.col("outcome").isin(*DISPOSITIONS), F.lit(False)) | _blank("reason")
    bare = (F.col("outcome") == "integrated") & (F.coalesce(F.size("entry_ids"), F.lit(0)) <= 0)
    return _rows(keyed.where(none), "no_disposition", "finding_id").unionByName(_rows(keyed.where(~none & bare), "integrated_without_entry", "finding_id"))


def text_problems(document: DataFrame, integrated: DataFrame, dispositions: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (decision_id, code, item): quotes and provenance of integrated findings that the document doesn't have, and
    entries it lacks. ``integrated``: decision_id, finding_id, text, original_id, sha256, json_pointer; nulls aren't
    looked for. ``document``: text, the rows that it is made of; ``entries``: entry, in any case."""
    provenance = ["original_id", "sha256", "json_pointer"]
    witnesses = integrated.select("decision_id", F.explode(F.array(*provenance)).alias("needle")).where("needle is not null")
    quotes = integrated.where("text is not null").select("decision_id", "finding_id", F.col("text").alias("needle"))
    there = needles.found(quotes.select("needle").unionByName(witnesses.select("needle")), document)
    known = entries.select(F.lower("entry").alias("entry"))
    linked_ = dispositions.select(F.split_part("key", F.lit("/"), F.lit(1)).alias("decision_id"), F.explode("entry_ids").alias("entry")).withColumn("entry", F.lower("entry"))
    return reduce(DataFrame.unionByName, [
        _rows(quotes.join(there, "needle", "left_anti"), "quote_not_in_document", "finding_id"),
        _rows(witnesses.join(there, "needle", "left_anti"), "provenance_not_in_document", "needle"),
        _rows(linked_.join(known, "entry", "left_anti"), "unknown_entry", "entry"),
    ]).distinct()


def reuse_problems(batch: dict, journals: list[dict], findings: dict[str, list[str]]) -> list[str]:
    """Why a batch may not use its decisions (driver code on a run's journals, which are few).

    A decision that a completed batch installed is used up, unless a resolution_revision names the latest such batch and
    the findings, unresolved there, that it resolves; every other finding of it keeps its disposition. ``findings``: ids
    by decision.
    """
    from attestry.functions.identity import zoned_instant

    out = []
    own = [j for j in journals if j["batch_id"] == batch["batch_id"]]
    if any(j["batch"] != batch for j in own):
        return ["the batch's id belongs to other changes"]
    done = [(zoned_instant(j.get("completed_at")), j) for j in journals if j.get("status") == "complete" and j["batch_id"] != batch["batch_id"]]
    if any(when is None for when, _ in done):
        return ["a completed batch has no clear time"]
    latest: dict[str, dict] = {}
    for decision in batch["decision_ids"]:
        times = sorted((when, j["batch_id"]) for when, j in done if decision in j["decision_ids"])
        if len({when for when, _ in times}) < len(times):
            out.append(f"{decision}: two batches were completed at one time")
        if times:
            latest[decision] = next(j for _, j in done if j["batch_id"] == times[-1][1])
    revision = batch.get("resolution_revision")
    if not latest:
        return out + ["a resolution revision without an installed decision"] * (revision is not None)
    if not isinstance(revision, dict):
        return [*out, "an installed decision is used again without a resolution revision"]
    prior, reason, named = (revision.get(k) for k in ("prior_batch_id", "reason", "finding_ids"))
    if not (isinstance(prior, str) and isinstance(reason, str) and reason.strip() and isinstance(named, list) and named and all(isinstance(x, str) for x in named) and len(set(named)) == len(named)):
        return [*out, "a resolution revision needs a prior batch, distinct findings and a reason"]
    resolved: set[str] = set()
    for decision, journal in latest.items():
        if journal["batch_id"] != prior:
            out.append(f"{decision}: the revision doesn't name its latest batch")
        keys = {f"{decision}/{f}" for f in findings.get(decision, [])}
        before, after = journal.get("finding_dispositions", {}), batch.get("finding_dispositions", {})
        for key in keys - set(named):
            if before.get(key) != after.get(key):
                out.append(f"{key}: changed without being named")
        for key in keys & set(named):
            if (before.get(key) or {}).get("outcome") != "unresolved" or (after.get(key) or {}).get("outcome") not in ("integrated", "already_represented", "excluded"):
                out.append(f"{key}: only an unresolved finding can be resolved")
        if not keys & set(named):
            out.append(f"{decision}: the revision resolves none of its findings")
        resolved |= keys & set(named)
    return out + ["the revision names findings that it doesn't use"] * bool(set(named) - resolved)
