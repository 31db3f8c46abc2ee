"""Markdown documents: visible lines, tokens, entries, source blocks, references, audit.

Only the scan of one document's lines is Python (protected blocks are a state that lines carry on); everything after is
DataFrame operations over tokens, by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.blocks import READER, outside, protected
from attestry.functions.text import DATA_URI, link_targets, slug

#: Fixed values, the reader's grammar as Python has it: (?d) makes \n the only line end.
ENTRY = r"^(E\d{4,})\s+[—–-]\s+(.+?)\s*$"
ADDITION = r"(?idu)^### .*?(?:original.conversation|original claude|original.message|complement|later addition)"
UNAVAILABLE = r"(?idu)(?:original|underlying).{0,100}(?:unavailable|not (?:retrieved|available|recovered))"
PRESERVED = r"(?dm)^<!-- BEGIN PRESERVED [A-Za-z0-9_.-]+\.md -->\r?\n"
STOP = (
    "the and with from into after before about while their that this owner account record feeling reflection later original "
    "conversation source for was had not but has its are who his her she him out"
).split()
SOURCE_ANCHOR = r"(?i)^(?:src-|cor\d)[A-Za-z0-9_-]*$"
OUTSIDE = r"external reference `([A-Za-z0-9_-]+)`; not included"

_HEADING = re.compile(r"(#{1,6})[ \t]+(.+?)\s*#*\s*")
_ANCHOR = re.compile(r""" {0,3}<a\s+(?:id|name)=["']([^"']+)["']\s*></a>\s*""")


def scan_lines(text: str) -> tuple[list[tuple[int, int, int, str]], bool]:
    """(start, end, number, line) of the lines outside fences and archived blocks; and whether a block is left open.

    Offsets count code points. Lines end where Python's splitlines ends them.
    """
    spans = list(protected(text, READER))
    out, counted, number = [], 0, 1
    for a, b in outside(text, spans):
        number += len(text[counted:a].splitlines())
        at = counted = a
        for line in text[a:b].splitlines(keepends=True):
            out.append((at, at + len(line), number, line))
            at, number, counted = at + len(line), number + 1, at + len(line)
    return out, any(not closed for *_, closed in spans)


def token(line: str) -> tuple[str, int, str] | None:
    """(kind, level, title) of a heading or an anchor (level 0, its id); None for any other line."""
    body = line.rstrip("\r\n")
    if heading := _HEADING.fullmatch(body):
        return "heading", len(heading[1]), heading[2]
    if anchor := _ANCHOR.fullmatch(body):
        return "anchor", 0, anchor[1]
    return None


def lines(docs: DataFrame) -> DataFrame:
    """``docs``: document, text. Rows (document, start, end, number, line, kind, level, title, unclosed): the visible
    lines; kind is heading (level, title), anchor (title is its id) or null. An unclosed block is marked on a row of its
    own (start null). A document over the engine's bounds is the caller's to refuse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["document", "start", "end", "number", "line", "kind", "level", "title", "unclosed"]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_())
        for batch in batches:
            rows = []
            for document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, unclosed = scan_lines(text or "")
                for begin, end, number, line in found:
                    kind, level, title = token(line) or (None, None, None)
                    rows.append((document, begin, end, number, line, kind, level or None, title, False))
                if unclosed:
                    rows.append((document, None, None, None, None, None, None, None, True))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("document").cast("string"), "text").mapInArrow(run, "document string, start long, end long, number int, line string, kind string, level int, title string, unclosed boolean")


def entries(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows (document, entry_id, title, start, end, text, sha256): sections headed by an entry id at level 2 or 3.

    An entry ends at the next heading of its level or a higher one, or at the next entry's heading; an anchor right
    before that heading belongs to the following section.
    """
    heads = scanned.where("kind = 'heading'").withColumn("is_entry", F.col("level").isin(2, 3) & F.col("title").rlike(ENTRY))
    later = next_heading(heads, ["document"], "start", "level", 6)
    after = Window.partitionBy("document").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    ended = later.withColumn("next", F.least("next", F.min(F.when(F.col("is_entry"), F.col("start"))).over(after)))
    own = ended.where("is_entry").select("document", "start", "level", F.regexp_extract("title", ENTRY, 1).alias("entry_id"), F.regexp_extract("title", ENTRY, 2).alias("title"), "next")
    # the visible token before the end, if it's an anchor with nothing but blank lines between
    tokens = scanned.where("kind is not null or trim(line) <> ''").where("start is not null")
    before = tokens.withColumn("prior_kind", F.lag("kind").over(Window.partitionBy("document").orderBy("start"))).withColumn("prior_start", F.lag("start").over(Window.partitionBy("document").orderBy("start")))
    before = before.select("document", F.col("start").alias("next"), "prior_kind", "prior_start")
    bounded = own.join(before, ["document", "next"], "left").join(docs.select(F.col("document").cast("string"), F.col("text").alias("whole")), "document")
    end = F.when(F.col("next").isNull(), F.length("whole")).when((F.col("prior_kind") == "anchor") & (F.col("prior_start") > F.col("start")), F.col("prior_start")).otherwise(F.col("next"))
    body = F.concat(F.rtrim(F.regexp_replace(F.substring("whole", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), r"\s+$", "")), F.lit("\n"))
    return bounded.withColumn("end", end.cast("long")).withColumn("text", body).select("document", "entry_id", "title", "start", "end", "text", F.sha2("text", 256).alias("sha256"))


def next_heading(heads: DataFrame, group: list[str], start: str, level: str, levels: int, block: int | None = None) -> DataFrame:
    """Adds ``next``: where the next heading of the row's level or a higher one (a lower number) begins, null if none
    does. Levels are 1 to ``levels``. One window over a group's headings; with ``block`` (a number of places) a window over
    each block's, and one over the blocks' first headings, so a group of any length takes many tasks."""
    first = lambda k: F.min(F.when(F.col(level) <= k, F.col(start)))
    ks = range(1, levels + 1)
    held = heads if block is None else heads.withColumn("_block", F.floor(F.col(start) / block))
    within = [*group, *(["_block"] if block else [])]
    after = Window.partitionBy(*within).orderBy(F.desc(start)).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumns({f"_next{k}": first(k).over(after) for k in ks})
    own = lambda k: F.col(f"_next{k}")
    if block:
        tops = held.groupBy(*within).agg(*[first(k).alias(f"_first{k}") for k in ks])
        beyond = Window.partitionBy(*group).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
        later = tops.select(*within, *[F.min(f"_first{k}").over(beyond).alias(f"_later{k}") for k in ks])
        held = held.join(later, within)
        own = lambda k: F.coalesce(f"_next{k}", f"_later{k}")
    found = F.coalesce(*[F.when(F.col(level) == k, own(k)) for k in ks])
    return held.withColumn("next", found).drop("_block", *[f"_next{k}" for k in ks], *[f"_later{k}" for k in ks])


def source_blocks(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows (document, source_id, start, end, text, sha256): from a source's or correction's anchor to the next anchor."""
    w = Window.partitionBy("document").orderBy("start")
    anchors = scanned.where("kind = 'anchor'").withColumn("next", F.lead("start").over(w)).where(F.col("title").rlike(SOURCE_ANCHOR))
    joined = anchors.join(docs.select(F.col("document").cast("string"), F.col("text").alias("whole")), "document")
    stop = F.coalesce("next", F.length("whole"))
    body = F.substring("whole", (F.col("end") + 1).cast("int"), (stop - F.col("end")).cast("int"))
    return joined.select("document", F.col("title").alias("source_id"), F.col("end").alias("start"), stop.cast("long").alias("end"), body.alias("text")).withColumn("sha256", F.sha2("text", 256))


def entry_references(entry_rows: DataFrame) -> DataFrame:
    """Rows (document, entry_id, ref): the distinct places that an entry's visible lines link to, and the references that
    an earlier publication marked as not included."""
    inside = lines(entry_rows.select(F.concat_ws("\x1f", "document", "entry_id").alias("document"), "text")).where("line is not null")
    at = F.split("document", "\x1f")
    named = inside.select(at[0].alias("document"), at[1].alias("entry_id"), F.explode(link_targets(F.col("line"))).alias("ref"))
    marked = entry_rows.select("document", "entry_id", F.explode(F.regexp_extract_all("text", F.lit(OUTSIDE), F.lit(1))).alias("ref"))
    return named.unionByName(marked).distinct()


def entry_bases(entry_rows: DataFrame, refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (document, entry_id, sources): each reference but those to entries, with its block's hash or unavailable."""
    own = refs.where(~F.col("ref").rlike(r"^e\d{4,}$"))
    joined = own.join(blocks.select("document", F.col("source_id").alias("ref"), F.col("sha256").alias("block")), ["document", "ref"], "left")
    grouped = joined.groupBy("document", "entry_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ref", F.coalesce("block", F.lit("unavailable")))))).alias("sources"))
    return entry_rows.select("document", "entry_id").join(grouped, ["document", "entry_id"], "left")


def anchors(scanned: DataFrame) -> DataFrame:
    """Rows (document, target): anchors, and headings' slugs with -1, -2 … for those that repeat."""
    s = scanned.where("kind = 'heading'").withColumn("slug", slug(F.col("title")))
    n = F.row_number().over(Window.partitionBy("document", "slug").orderBy("start")) - 1
    named = s.withColumn("n", n).select("document", F.when(F.col("n") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("n").cast("string"))).alias("target"))
    return named.unionByName(scanned.where("kind = 'anchor'").select("document", F.col("title").alias("target")))


def _sections(text: str) -> Column:
    """A text's parts that each begin at a line with ### (an entry's own heading too)."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), "\n### ", -1)
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.concat(F.lit("### "), x))


def additions(entry_rows: DataFrame) -> DataFrame:
    """Rows (document, entry_id, start, end, text): later additions, from their heading to the entry's next ### line.
    Offsets are code points of the entry's text."""
    # a section's place: the text before the first, and the sections before it with the line end that follows each
    first = F.length("whole") - F.aggregate("sections", F.lit(-1), lambda n, x: n + F.length(x) + 1)
    before = F.aggregate(F.slice("sections", F.lit(1), F.col("pos")), F.lit(0), lambda n, x: n + F.length(x) + 1)
    at = entry_rows.select("document", "entry_id", F.col("text").alias("whole"), _sections("text").alias("sections"))
    each = at.select("*", F.posexplode("sections").alias("pos", "text")).where(F.col("text").rlike(ADDITION))
    placed = each.withColumn("start", first + before)
    return placed.select("document", "entry_id", "start", (F.col("start") + F.length("text")).alias("end"), "text")


def _terms(text: str) -> Column:
    """The distinct words of three letters or more, case-folded, without the stop words."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{Nl}\p{No}]{3,})"), F.lit(1))
    folded = F.transform(words, lambda w: F.replace(F.translate(F.lower(w), "ςſ", "σs"), F.lit("ß"), F.lit("ss")))
    return F.array_except(folded, F.array(*map(F.lit, STOP)))


def misplaced_additions(added: DataFrame, titles: DataFrame, top: int = 3) -> DataFrame:
    """Rows (document, entry_id, start, end, other, shared, k): other entries whose title words an addition shares: three
    or more, and three more than with its own entry; the best ``top`` by share of the title, then by number, then by id.
    ``added``: document, entry_id, start, end, text; ``titles``: document, entry_id, title.

    Titles with the same words are one, and so are additions with the same words under such titles; only these meet, by
    their words, and each set of titles needs no more than its last ``top`` + 1 ids. Nothing is paired entry by entry.
    """
    named = titles.select("document", F.col("entry_id").alias("other"), F.array_sort(_terms("title")).alias("title_words"))
    last = F.slice(F.sort_array(F.collect_set("other"), asc=False), 1, top + 1)
    sets = _largest(named, ["document", "title_words"], "other", top + 1).groupBy("document", "title_words").agg(last.alias("others")).where("size(title_words) > 0")
    own = named.select("document", F.col("other").alias("entry_id"), "title_words").dropDuplicates(["document", "entry_id"])
    kinds = added.select("document", "entry_id", "start", "end", F.array_sort(_terms("text")).alias("words")).join(own, ["document", "entry_id"], "left")
    kinds = kinds.withColumn("least", F.greatest(F.lit(3), F.size(F.array_intersect("words", F.coalesce("title_words", F.array().cast("array<string>")))) + 3)).drop("title_words")
    distinct = kinds.where("size(words) >= least").select("document", "words", "least").distinct()
    met = distinct.select("document", "words", "least", F.explode("words").alias("word")).join(sets.select("document", "title_words", "others", F.explode("title_words").alias("word")), ["document", "word"])
    shared = met.groupBy("document", "words", "least", "title_words").agg(F.count("*").alias("shared"), F.first("others").alias("others")).where("shared >= least")
    best = ["document", "words", "least"]
    order = [(F.col("shared") / F.size("title_words")).desc(), F.desc("shared"), F.desc("other")]
    each = shared.select(*best, "shared", "title_words", F.explode("others").alias("other"))
    few = each.withColumn("k", F.row_number().over(Window.partitionBy(*best).orderBy(*order))).where(F.col("k") <= top + 1)
    fit = kinds.join(few.drop("k"), best).where("other <> entry_id")
    w = Window.partitionBy("document", "entry_id", "start", "end").orderBy(*order)
    return fit.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).select("document", "entry_id", "start", "end", "other", "shared", "k")


def _largest(rows: DataFrame, group: list[str], value: str, n: int) -> DataFrame:
    """The ``n`` largest distinct values of each group. A group of many rows is thinned by hash first, so it meets in one
    task as a few rows of each part."""
    parts = rows.select(*group, value).distinct().withColumn("_part", F.pmod(F.xxhash64(value), F.lit(64)))
    for keys in ([*group, "_part"], group):
        w = Window.partitionBy(*keys).orderBy(F.desc(value))
        parts = parts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
    return parts.drop("_part")


def audit(docs: DataFrame) -> DataFrame:
    """Rows (document, code, entry_id, detail): unclosed_block, duplicate_entry, duplicate_source,
    encoded_attachment_excluded, preserved_bundle, external_or_missing_target, body_sources_missing_from_header,
    stale_index_title, possible_misplaced_addition (detail: candidate entries and the addition's place, as JSON),
    whole_entry_reconciliation, possibly_stale_source_limit. A bundle is named, not unwrapped."""
    scanned = lines(docs)
    found, blocks = entries(docs, scanned), source_blocks(docs, scanned)
    refs = entry_references(found)
    none = F.lit(None).cast("string")
    row = lambda df, code, entry=none, detail=none: df.select("document", (F.lit(code) if isinstance(code, str) else code).alias("code"), entry.alias("entry_id"), detail.alias("detail"))
    known = blocks.select("document", F.col("source_id").alias("ref")).unionByName(found.select("document", F.lower("entry_id").alias("ref")))
    header = found.select("document", "entry_id", F.explode(link_targets(F.regexp_extract("text", r"(?m)^(\*\*Source references:\*\*[^\n]*)", 1))).alias("ref")).distinct()
    index = scanned.select("document", F.regexp_extract("line", r"^\| \[(E\d{4,})\]\(#[^)]+\) \| ([^|]+) \|", 1).alias("entry_id"), F.trim(F.regexp_extract("line", r"^\| \[(E\d{4,})\]\(#[^)]+\) \| ([^|]+) \|", 2)).alias("shown")).where("entry_id <> ''")
    added = additions(found)
    ranked = misplaced_additions(added, found.select("document", "entry_id", "title")).groupBy("document", "entry_id", "start", "end")
    places = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "other"))), lambda x: x["other"]).alias("candidate_entries"))
    codes = F.array(F.lit("whole_entry_reconciliation"), F.when(F.col("text").rlike(UNAVAILABLE), F.lit("possibly_stale_source_limit")))
    to_read = found.where(F.exists(_sections("text"), lambda x: x.rlike(ADDITION))).select("document", "entry_id", F.explode(codes).alias("code")).where("code is not null")
    parts = [
        row(scanned.where("unclosed"), "unclosed_block"),
        row(found.groupBy("document", "entry_id").count().where("count > 1"), "duplicate_entry", F.col("entry_id")),
        row(blocks.groupBy("document", "source_id").count().where("count > 1"), "duplicate_source", none, F.col("source_id")),
        row(docs.select(F.col("document").cast("string"), "text").where(F.col("text").rlike(DATA_URI)), "encoded_attachment_excluded"),
        row(docs.select(F.col("document").cast("string"), "text").where(F.col("text").rlike(PRESERVED)), "preserved_bundle"),
        row(refs.join(known, ["document", "ref"], "left_anti"), "external_or_missing_target", F.col("entry_id"), F.col("ref")),
        row(refs.where("lower(ref) like 'src-%'").join(header, ["document", "entry_id", "ref"], "left_anti"), "body_sources_missing_from_header", F.col("entry_id"), F.col("ref")),
        row(index.join(found.select("document", "entry_id", "title"), ["document", "entry_id"]).where("shown <> title"), "stale_index_title", F.col("entry_id"), F.col("shown")),
        row(places, "possible_misplaced_addition", F.col("entry_id"), F.to_json(F.struct("candidate_entries", "start", "end"))),
        row(to_read, F.col("code"), F.col("entry_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def witness_problems(witnesses: DataFrame, blocks: DataFrame) -> DataFrame:
    """Witnesses (source_id, source_sha256, start, end, quote) with a code: unknown_source, stale_source, text_mismatch."""
    joined = witnesses.join(blocks.select("source_id", F.col("sha256").alias("_sha"), F.col("text").alias("_text")), "source_id", "left")
    found = F.substring("_text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    code = (
        F.when(F.col("_sha").isNull(), "unknown_source")
        .when(F.col("_sha") != F.col("source_sha256"), "stale_source")
        .when((F.col("start") < 0) | (F.col("start") >= F.col("end")) | (found != F.col("quote")), "text_mismatch")
    )
    return joined.withColumn("code", code).where("code is not null").drop("_sha", "_text")
