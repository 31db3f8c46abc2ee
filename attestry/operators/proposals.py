"""Checks of extraction proposals against the packet they answer, as queries over all packets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import span

DISPOSITION = "candidate"


def problems(pieces: DataFrame, coverage: DataFrame, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows (packet, code, item) of what a proposal breaks.

    ``pieces``: packet, piece_id, text, role, kind, segment_index, already_covered; ``coverage``: packet, piece_id,
    disposition, reason, candidate_ids; ``candidates``: packet, candidate_id, attribution, statement; ``evidence``:
    packet, candidate_id, piece_id, start, end, quote.
    """
    row = lambda df, code, item: df.select("packet", F.lit(code).alias("code"), F.col(item).cast("string").alias("item"))
    pending = pieces.where("not already_covered").select("packet", "piece_id")
    twice = lambda df, item: df.groupBy("packet", item).count().where("count > 1")
    cited = evidence.join(pieces, ["packet", "piece_id"], "left").join(candidates.select("packet", "candidate_id", "attribution"), ["packet", "candidate_id"], "left")
    wrong_span = (F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.length("text")) | (span(F.col("text"), F.col("start"), F.col("end")) != F.col("quote"))
    there = cited.where("text is not null and segment_index >= 0")
    links = evidence.join(pending, ["packet", "piece_id"], "left_semi").groupBy("packet", "piece_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("linked"))
    listed = coverage.join(links, ["packet", "piece_id"], "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<string>")))
    parts = [
        row(twice(pieces, "piece_id"), "repeated_piece", "piece_id"),
        row(twice(coverage, "piece_id"), "repeated_coverage", "piece_id"),
        row(twice(candidates, "candidate_id"), "repeated_candidate", "candidate_id"),
        row(pending.join(coverage, ["packet", "piece_id"], "left_anti"), "uncovered_piece", "piece_id"),
        row(coverage.join(pending, ["packet", "piece_id"], "left_anti"), "coverage_not_pending", "piece_id"),
        row(candidates.where("trim(candidate_id) = '' or trim(statement) = ''"), "empty_candidate", "candidate_id"),
        row(candidates.join(evidence, ["packet", "candidate_id"], "left_anti"), "no_evidence", "candidate_id"),
        row(candidates.join(evidence.join(pending, ["packet", "piece_id"], "left_semi"), ["packet", "candidate_id"], "left_anti"), "no_pending_evidence", "candidate_id"),
        row(cited.where("text is null or segment_index < 0"), "evidence_without_text", "candidate_id"),
        row(there.where(wrong_span), "quote_mismatch", "candidate_id"),
        row(there.where("role = 'assistant' and attribution not in ('assistant_content', 'unknown')"), "assistant_as_owner", "candidate_id"),
        row(there.where("attribution = 'owner_statement' and (role <> 'user' or kind <> 'text')"), "owner_without_user_text", "candidate_id"),
        row(coverage.where("trim(reason) = ''"), "empty_reason", "piece_id"),
        row(listed.where((F.size("candidate_ids") != F.size(F.array_distinct("candidate_ids"))) | (F.array_sort(F.array_distinct("candidate_ids")) != F.col("linked"))), "links_differ", "piece_id"),
        row(coverage.where((F.col("disposition") == DISPOSITION) != (F.size("candidate_ids") > 0)), "disposition_differs", "piece_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


#: The form of a proposal. A list has one form for its items, a tuple the allowed strings.
FORM = {
    "packet_id": str,
    "coverage": [{"piece_id": str, "disposition": ("candidate", "context_only", "no_extractable_content", "needs_context"), "reason": str, "candidate_ids": [str]}],
    "candidates": [
        {
            "candidate_id": str,
            "category": ("event", "preference", "plan", "reflection", "other"),
            "attribution": ("owner_statement", "reported_statement", "pasted_quote", "draft", "dream", "hypothesis", "assistant_content", "attachment_text", "unknown"),
            "statement": str,
            "uncertainty": str,
            "evidence": [{"piece_id": str, "start": int, "end": int, "quote": str}],
        }
    ],
}


def misshapen(value: object, form: object = FORM, at: str = "") -> list[str]:
    """Where a JSON value isn't of a form: other keys, other types (a boolean is no number), strings that aren't allowed."""
    if isinstance(form, dict):
        if not isinstance(value, dict) or set(value) != set(form):
            return [f"{at or '/'}: other keys"]
        return [x for k, f in form.items() for x in misshapen(value[k], f, f"{at}/{k}")]
    if isinstance(form, list):
        return [x for i, v in enumerate(value) for x in misshapen(v, form[0], f"{at}/{i}")] if isinstance(value, list) else [f"{at}: no list"]
    if isinstance(form, tuple):
        return [] if isinstance(value, str) and value in form else [f"{at}: not allowed"]
    return [] if type(value) is form else [f"{at}: no {form.__name__}"]


def check_proposal(request: dict, proposal: object) -> list[str]:
    """What is wrong with one proposal for one request; the same rules as problems(), after those of its form."""
    if wrong := misshapen(proposal):
        return wrong
    pieces = {p["piece_id"]: p for p in request["pieces"]}
    open_ = {k for k, p in pieces.items() if not p["already_covered"]}
    covered = [c["piece_id"] for c in proposal["coverage"]]
    names = [c["candidate_id"] for c in proposal["candidates"]]
    out = ["another packet"] * (proposal["packet_id"] != request["packet_id"])
    out += ["a piece stands twice"] * (len(pieces) < len(request["pieces"]))
    out += ["coverage isn't that of the open pieces"] * (sorted(covered) != sorted(open_))
    out += ["candidates need distinct names"] * (len(set(names)) < len(names) or not all(n.strip() for n in names))
    cited: dict[str, set[str]] = {k: set() for k in open_}
    for c in proposal["candidates"]:
        out += [f"{c['candidate_id']}: no statement"] * (not c["statement"].strip())
        out += [f"{c['candidate_id']}: no evidence from an open piece"] * (not any(e["piece_id"] in open_ for e in c["evidence"]))
        for e in c["evidence"]:
            p = pieces.get(e["piece_id"])
            if p is None or p["segment_index"] < 0:
                out.append(f"{c['candidate_id']}: cites no text")
                continue
            cited.get(e["piece_id"], set()).add(c["candidate_id"])
            exact = 0 <= e["start"] < e["end"] <= len(p["text"]) and p["text"][e["start"] : e["end"]] == e["quote"]
            out += [f"{c['candidate_id']}: quote isn't at its place"] * (not exact)
            out += [f"{c['candidate_id']}: the assistant's text as another's"] * (p["role"] == "assistant" and c["attribution"] not in ("assistant_content", "unknown"))
            out += [f"{c['candidate_id']}: the owner's statement from other text"] * (c["attribution"] == "owner_statement" and (p["role"] != "user" or p["kind"] != "text"))
    for c in proposal["coverage"]:
        ids = c["candidate_ids"]
        out += [f"{c['piece_id']}: no reason"] * (not c["reason"].strip())
        out += [f"{c['piece_id']}: other candidates than those that cite it"] * (len(set(ids)) < len(ids) or set(ids) != cited.get(c["piece_id"], set()))
        out += [f"{c['piece_id']}: disposition and candidates differ"] * ((c["disposition"] == DISPOSITION) != bool(ids))
    return out
