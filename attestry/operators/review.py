"""Review of pieces: quotes against sources, coverage, decisions in force, latest outcomes, status, media gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import span
from attestry.operators import intervals


def quote_problems(quotes: DataFrame, segments: DataFrame) -> DataFrame:
    """Quotes (message, segment, start, end, quote) that aren't the exact span of their segment's text, with a code:
    unknown_segment, bad_span or text_mismatch."""
    joined = quotes.join(segments.select("message", "segment", "text"), ["message", "segment"], "left")
    code = (
        F.when(F.col("text").isNull(), "unknown_segment")
        .when((F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.length("text")), "bad_span")
        .when(span(F.col("text"), F.col("start"), F.col("end")) != F.col("quote"), "text_mismatch")
    )
    return joined.withColumn("code", code).where("code is not null").drop("text")


def find_quotes(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (item_id, doc_id, start, end): the first place of each item's text in each document that has it. ``items``:
    item_id, quote, a stated set of bounded size; ``docs``: doc_id, text, streamed against it. Null texts have no place.

    A quote of eight words or more is met by five words at its start, which are whole words wherever it stands; only the
    words' hashes are dealt out, and the texts of what met are looked at. Shorter quotes are searched in every text.
    """
    words = lambda c: F.split(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", ""), r"\s+")
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(2), F.greatest(F.size(w) - 6, F.lit(2))), lambda i: F.xxhash64(F.slice(w, i, 5))))
    # a generator of one row computes the words once
    split = lambda df, c: df.withColumn("words", F.explode(F.array(words(F.col(c)))))
    own = split(items.where("quote is not null"), "quote")
    keys = own.where("size(words) >= 8").select("item_id", F.element_at(grams(F.col("words")), 1).alias("gram"))
    met = split(docs.where("text is not null"), "text").select("doc_id", F.explode(grams(F.col("words"))).alias("gram")).join(F.broadcast(keys), "gram").select("doc_id", "item_id").distinct()
    quotes = own.select("item_id", "quote")
    long = docs.join(met, "doc_id").join(F.broadcast(quotes), "item_id").where(F.contains("text", "quote"))
    short = docs.join(F.broadcast(own.where("size(words) < 8").select("item_id", "quote")), F.contains("text", "quote"))
    found = long.select("item_id", "doc_id", "text", "quote").unionByName(short.select("item_id", "doc_id", "text", "quote"))
    start = F.instr("text", F.col("quote")) - 1
    return found.select("item_id", "doc_id", start.alias("start"), (start + F.length("quote")).alias("end"), "text", "quote")


def uncovered_quotes(quotes: DataFrame, pieces: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rows of quotes joined with the pieces they overlap that no coverage row names. Quotes and pieces of a segment meet by
    the places they share (``intervals``), however many a segment has."""
    p = pieces.select("message", "segment", "piece_id", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    touching = intervals.overlapping(quotes, p, ["message", "segment"], ("start", "end"), ("p_start", "p_end"))
    return touching.join(coverage.select("piece_id"), "piece_id", "left_anti")


def decisions_in_force(decisions: DataFrame) -> DataFrame:
    """Decisions that no other supersedes."""
    gone = decisions.where("supersedes is not null").select(F.col("supersedes").alias("decision_id"))
    return decisions.join(gone, "decision_id", "left_anti")


def coverage_overlaps(coverage: DataFrame) -> DataFrame:
    """Rows (piece_id, decisions) of pieces that several decisions in force cover."""
    return coverage.groupBy("piece_id").agg(F.countDistinct("decision_id").alias("decisions")).where("decisions > 1")


def pending_packets(pieces: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rows (packet, pending): packets with pieces not covered; the first by packet is the next to review."""
    return pieces.join(coverage.select("piece_id"), "piece_id", "left_anti").groupBy("packet").agg(F.count("*").alias("pending"))


def first_pending(pieces: DataFrame, coverage: DataFrame):
    """The least ``packet`` with a piece that isn't covered, None if there is none."""
    return pending_packets(pieces, coverage).agg(F.min("packet").alias("packet")).first()["packet"]


def is_complete(counts: dict[str, int], missing: list) -> bool:
    """All conversations are integrated, and no member of the selection is missing."""
    return not missing and set(counts) <= {"integrated"} and sum(counts.values()) > 0


def latest_by_decision(journals: DataFrame) -> DataFrame:
    """Rows (decision_id, batch_id, completed_at, ambiguous): the latest completed batch of each decision. ``journals``:
    batch_id, completed_at, decision_ids."""
    each = journals.select("batch_id", "completed_at", F.explode("decision_ids").alias("decision_id"))
    at = each.groupBy("decision_id", "completed_at").agg(F.count("*").alias("n"), F.max("batch_id").alias("batch_id"))
    return at.groupBy("decision_id").agg(F.max_by("batch_id", "completed_at").alias("batch_id"), F.max("completed_at").alias("completed_at"), (F.max("n") > 1).alias("ambiguous"))


def completed(journals: DataFrame) -> DataFrame:
    """Journals whose installation is complete, with ``completed_at`` as a moment; a time without a zone is null."""
    from attestry.functions.text import zoned_timestamp

    return journals.where("status = 'complete'").withColumn("completed_at", zoned_timestamp(F.col("completed_at")))


def latest_dispositions(journals: DataFrame) -> DataFrame:
    """Rows (finding, completed_at, outcome, ambiguous): each finding's outcome at its latest completion.

    ``journals`` has finding, completed_at and outcome of completed journals. Several at one instant, the latest or not,
    have no order: the finding is ambiguous then.
    """
    at = journals.groupBy("finding", "completed_at").agg(F.count("*").alias("n"), F.max("outcome").alias("outcome"))
    return at.groupBy("finding").agg(F.max("completed_at").alias("completed_at"), F.max_by("outcome", "completed_at").alias("outcome"), (F.max("n") > 1).alias("ambiguous"))


def review_status(pieces: DataFrame, coverage: DataFrame, installed: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Rows (conversation, covered, total, state).

    ``pieces``: conversation, piece_id; ``coverage``: piece_id, decision_id; ``installed`` and ``unresolved``:
    decision_id. The first that holds: pending (none covered), partial, reviewed_with_gaps (a decision is unresolved),
    integrated (all decisions installed), reviewed_not_integrated.
    """
    marks = coverage.join(installed.select("decision_id").distinct().withColumn("is_in", F.lit(True)), "decision_id", "left").join(
        unresolved.select("decision_id").distinct().withColumn("is_open", F.lit(True)), "decision_id", "left"
    )
    by = pieces.join(marks, "piece_id", "left").groupBy("conversation").agg(
        F.count("decision_id").alias("covered"),
        F.count("*").alias("total"),
        F.bool_or(F.coalesce("is_open", F.lit(False))).alias("open"),
        F.bool_and(F.coalesce("is_in", F.lit(False))).alias("in"),
    )
    state = (
        F.when(F.col("covered") == 0, "pending")
        .when(F.col("covered") < F.col("total"), "partial")
        .when(F.col("open"), "reviewed_with_gaps")
        .when(F.col("in"), "integrated")
        .otherwise("reviewed_not_integrated")
    )
    return by.select("conversation", "covered", "total", state.alias("state"))


def media_gaps(gaps: DataFrame, covered: DataFrame) -> DataFrame:
    """Rows (gap, candidates, message): the covered message that each declared gap names by record id or original id,
    and whose pointer leads to the gap's pointer, if there is one. candidates other than 1 are errors.

    ``gaps``: gap, decision_id, message_record_id, message_id, json_pointer; ``covered``: decision_id, message,
    original_id, pointer. Two equi-joins, united, stand for the join on either id.
    """
    c = covered.select("decision_id", "message", "original_id", "pointer").distinct()
    g = gaps.select("gap", "decision_id", "message_record_id", "message_id", "json_pointer")
    by_record = g.join(c, (g["decision_id"] == c["decision_id"]) & (g["message_record_id"] == c["message"]))
    by_id = g.join(c, (g["decision_id"] == c["decision_id"]) & (g["message_id"] == c["original_id"]))
    either = by_record.select("gap", "json_pointer", "message", "pointer").unionByName(by_id.select("gap", "json_pointer", "message", "pointer")).distinct()
    fits = either.where("json_pointer is null or startswith(json_pointer, concat(pointer, '/'))")
    found = fits.groupBy("gap").agg(F.count("*").alias("candidates"), F.min("message").alias("message"))
    return g.select("gap").join(found, "gap", "left").select("gap", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(F.col("candidates") == 1, F.col("message")).alias("message"))


def missing_members(wanted: DataFrame, conversations: DataFrame) -> DataFrame:
    """Ids (original_id) of a membership list that no conversation has."""
    return wanted.select("original_id").distinct().join(conversations.select("original_id"), "original_id", "left_anti")


def usage_totals(attempts: DataFrame, group: str) -> DataFrame:
    """Input and output tokens by group; null where any attempt's are unknown. Cached tokens are part of the input."""
    known = lambda c: F.when(F.bool_or(F.col(c).isNull()), F.lit(None)).otherwise(F.sum(c)).alias(c)
    return attempts.groupBy(group).agg(F.count("*").alias("attempts"), known("input_tokens"), known("output_tokens"))
