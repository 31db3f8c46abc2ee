"""Queries of review runs, decisions, documents after a change, and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.functions.identity import sha256
from attestry.operators import decisions, documents, normalize, packets, review, runs, writer
from attestry.operators.rounds import written
from attestry.operators.units import units
from attestry.plans.bridge import messages, raw_chatgpt, raw_claude, table
from attestry.plans.registry import MESSAGES, ORDERED, query
from attestry.plans.validation import tables

#: Event ids whose headings one window orders.
SECTION_BLOCK = 1 << 16


@query("""select conv_id as conversation, turn as node, case role when 'user' then 'unknown' when 'assistant' then 'assistant' else 'unknown' end as claude_role,
    case when role in ('user', 'assistant', 'system', 'tool') then role else 'unknown' end as chatgpt_role from conversations""")
def role_classes(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("conversation", "node", normalize.role_of("claude", F.col("role")).alias("claude_role"), normalize.role_of("chatgpt", F.col("role")).alias("chatgpt_role"))


@query(f"""with m as ({MESSAGES}), e as (select *, node % 4 = 1 as image from m)
    select record_id as message_record_id, 0::int as segment_index, 'text' as kind, pointer || '/content/parts/0' as json_pointer, text from e
    union all select record_id, -3::int, 'multimodal_or_unrecognized_content', pointer || '/content/parts/1', '{{"content_type": "image_asset_pointer", "name": "p.png"}}' from e where image""")
def review_units(spark, sf_dir):
    t = {k: written(v) for k, v in tables(written(raw_chatgpt(spark, sf_dir))).items()}
    return units(t["messages"], t["segments"]).select("message_record_id", "segment_index", "kind", "json_pointer", "text")


@query(f"""with m as ({MESSAGES}), x as (select *, '/' || conversation || '/chat_messages/' || node as jp from m), y as (select *, 'message:' || sha256('claude:driver' || chr(10) || jp) as rid from x)
    select rid as message_record_id, k::int as segment_index, kind from (
        select rid, 0 as k, 'text' as kind from y union all select rid, 1, 'text' from y union all select rid, 2, 'attachment_text' from y where node % 3 = 0
        union all select rid, -3, 'internal_assistant_content' from y where node % 4 = 1)""")
def claude_units(spark, sf_dir):
    t = tables(raw_claude(spark, sf_dir))
    return units(t["messages"], t["segments"]).select("message_record_id", "segment_index", "kind")


@query(f"""with m as ({MESSAGES}), c as (select distinct conversation from m) select 'c' || conversation as original_id from c where conversation % 3 = 1""")
def project_scope(spark, sf_dir):
    return runs.in_scope(tables(raw_chatgpt(spark, sf_dir))["conversations"], "chatgpt", project="p1").select("original_id")


@query(f"""with m as ({MESSAGES}), c as (select distinct conversation from m), w as (select 'c' || (conversation * 2) as id from c)
    select id as original_id, case when id in (select 'c' || conversation from c) then 'chosen' else 'missing' end as state from w""")
def membership_scope(spark, sf_dir):
    c = tables(raw_chatgpt(spark, sf_dir))["conversations"]
    wanted = messages(spark, sf_dir).select(F.concat(F.lit("c"), F.col("conversation") * 2).alias("original_id")).distinct()
    chosen = runs.in_scope(c, "chatgpt", members=wanted)
    return chosen.select("original_id", F.lit("chosen").alias("state")).unionByName(review.missing_members(wanted, chosen).withColumn("state", F.lit("missing")))


#: The run over all conversations in SQL: ranked, in preorder, cut at 400 code points, packed to 400.
RUN = f"""{ORDERED},
    u as (select conversation, node, 0 as unit, 0 as seg, 'text' as kind, pointer || '/content/parts/0' as jp, text as t, record_id from m
        union all select conversation, node, 1, -3, 'multimodal_or_unrecognized_content', pointer || '/content/parts/1', '{{"content_type": "image_asset_pointer", "name": "p.png"}}', record_id from m where node % 4 = 1),
    k as (select conversation, row_number() over (order by case when conversation % 9 = 0 then null else 1700000000 + conversation end nulls first, 'c' || conversation) as rank from (select distinct conversation from m)),
    p as (select u.conversation, rank, ord, unit, seg, kind, jp, record_id, s as p_start, least(s + 400, length(t)) as p_end, substr(t, s + 1, 400) as piece, row_number() over (partition by u.conversation order by ord, unit, s) as n
        from u join ordered using (conversation, node) join k using (conversation), unnest(range(0, greatest(length(t), 1), 400)) as z(s)),
    f as (select conversation, n, 1 as packet, p_end - p_start as used from p where n = 1
        union all select p.conversation, p.n, case when used + p_end - p_start > 400 then packet + 1 else packet end, case when used + p_end - p_start > 400 then p_end - p_start else used + p_end - p_start end
        from f join p on p.conversation = f.conversation and p.n = f.n + 1),
    r as (select *, 'P' || lpad(rank::varchar, greatest(4, length(rank::varchar))::int, '0') || '-' || lpad(packet::varchar, greatest(4, length(packet::varchar))::int, '0') as packet_id,
        'piece:' || sha256('{{"end":' || p_end || ',"json_pointer":"' || jp || '","kind":"' || kind || '","message_record_id":"' || record_id || '","segment_index":' || seg || ',"start":' || p_start || ',"text_sha256":"' || sha256(piece) || '"}}') as piece_id
        from p join f using (conversation, n))"""


def _run(spark, sf_dir) -> tuple[runs.Prepared, dict]:
    # nodes, messages, segments and attachments are projections of the parsed nodes, each read once; conversations aren't
    t = tables(written(raw_chatgpt(spark, sf_dir)), written)
    t["conversations"] = written(t["conversations"])
    return runs.prepare(t, t["conversations"], 400), t


@query(f"""with recursive {RUN} select packet_id, piece_id, record_id as message_record_id, seg::int as segment_index, kind, p_start::int as start, p_end::int as "end", sha256(piece) as text_sha256 from r""")
def run_pieces(spark, sf_dir):
    return _run(spark, sf_dir)[0].pieces.select("packet_id", "piece_id", "message_record_id", "segment_index", "kind", "start", "end", "text_sha256")


@query(f"""with recursive {RUN} select r.piece_id, r.packet_id, 'm' || node as original_message_id, m.role, ((node % 3 = 0)::int + (node % 4 = 1)::int)::int as attachments, rank % 5 = 0 as already_covered from r join m on m.record_id = r.record_id""")
def packet_view(spark, sf_dir):
    """Pieces as a reader sees them; those of every fifth conversation are covered."""
    found, t = _run(spark, sf_dir)
    covered = found.pieces.where("rank % 5 = 0").select("piece_id")
    view = runs.packet_view(found.pieces, t["messages"], t["attachments"], covered)
    return view.select("piece_id", "packet_id", "original_message_id", "role", F.size("attachments").alias("attachments"), "already_covered")


@query(f"""with recursive {RUN} select packet_id, count(*)::bigint as pieces, sum(length(piece))::bigint as chars, 'c' || any_value(conversation) as original_conversation_id, (max((node % 3 = 0)::int + (node % 4 = 1)::int))::bigint as attachment_references
    from (select r.*, m.node from r join m on m.record_id = r.record_id) group by packet_id""")
def packet_requests(spark, sf_dir):
    """What a worker gets of each packet, read back from its JSON."""
    found, t = _run(spark, sf_dir)
    view = runs.packet_view(found.pieces, t["messages"], t["attachments"], found.pieces.select("piece_id").limit(0))
    sent = runs.requests(view, found.conversations).select("packet_id", F.from_json("request", "original_conversation_id string, pieces array<struct<text string, attachment_references bigint>>").alias("r"))
    return sent.select("packet_id", F.size("r.pieces").cast("long").alias("pieces"), F.aggregate("r.pieces", F.lit(0).cast("long"), lambda a, p: a + F.length(p["text"])).alias("chars"), F.col("r.original_conversation_id").alias("original_conversation_id"), F.array_max("r.pieces.attachment_references").alias("attachment_references"))


@query(f"""with recursive {RUN} select min(packet_id) as packet_id from r where rank > 3""")
def first_pending(spark, sf_dir):
    """The first packet with something left, where the first three conversations are covered."""
    pieces = written(_run(spark, sf_dir)[0].pieces.select(F.struct("rank", "packet", "packet_id").alias("packet"), "piece_id"))
    covered = pieces.where("packet.rank <= 3").select("piece_id")
    left = review.pending_packets(pieces, covered)
    return left.agg(F.min("packet").alias("p")).select("p.packet_id")


@query("""select conv_id as conversation, turn as node from conversations where turn % 5 = 2 or contains(lower(text), 'extraction cutoff') or contains(lower(text), 'extract the emotionally')
    or contains(lower(text), 'master entry ids') or contains(lower(text), 'downloadable markdown') or contains(lower(text), 'source conversation')""")
def keyword_flags(spark, sf_dir):
    text = F.when(F.col("node") % 5 == 2, F.concat("text", F.lit(" Extraction CUTOFF"))).otherwise(F.col("text"))
    return messages(spark, sf_dir).where(runs.administrative(text)).select("conversation", "node")


def _decisions(spark, sf_dir) -> tuple[dict, object, object]:
    """A decision for each conversation over its messages, whole: even nodes are material with a quote of ten code points
    (from the sixth on; of a shorter text from the first), odd ones excluded. Every seventh conversation's has some fault,
    by its number."""
    m = messages(spark, sf_dir).select("conversation", "node", "record_id", F.coalesce("text", F.lit("")).alias("text"))
    did = F.concat(F.lit("D"), F.col("conversation"))
    fault = F.when(F.col("conversation") % 7 == 0, (F.col("conversation") / 7).cast("int") % 7).otherwise(-1)
    m = m.withColumn("decision_id", did).withColumn("fault", fault).withColumn("fid", F.concat(F.lit("F"), F.col("node")))
    heads = m.groupBy("decision_id").agg(F.max("fault").alias("fault")).select("decision_id", F.when(F.col("fault") != 0, "r").alias("reviewer"), F.lit("2024-01-01").alias("reviewed_at"), F.when(F.col("fault") == 1, "D?").alias("supersedes"))
    even = F.col("node") % 2 == 0
    coverage = m.select("decision_id", F.when(F.col("fault") == 2, F.concat("record_id", F.lit("?"))).otherwise(F.col("record_id")).alias("piece_id"), F.when(even, "distinct_episode").otherwise("excluded").alias("outcome"), F.when(F.col("fault") != 3, "why").alias("reason"), F.when(even, F.array("fid")).otherwise(F.array().cast("array<string>")).alias("finding_ids"))
    own = m.where(even)
    first = F.when(F.length("text") < 16, 0).otherwise(5)
    last = F.least(first + 10, F.length("text"))
    findings = own.select("decision_id", F.col("fid").alias("finding_id"), F.lit("distinct_episode").alias("outcome"), F.when(F.col("fault") != 4, "owner").alias("attribution"), F.lit("why").alias("reason"))
    quotes = own.where("fault <> 5").select("decision_id", F.col("fid").alias("finding_id"), F.col("record_id").alias("message"), F.lit(0).alias("segment"), first.alias("start"), last.alias("end"), F.when(F.col("fault") == 6, "wrong").otherwise(T.span(F.col("text"), first, last)).alias("text"))
    pieces = m.select(F.col("record_id").alias("piece_id"), F.col("record_id").alias("message"), F.lit(0).alias("segment"), F.lit(0).alias("start"), F.length("text").alias("end"))
    return {"decisions": heads, "coverage": coverage, "findings": findings, "quotes": quotes}, pieces, m.select(F.col("record_id").alias("message"), F.lit(0).alias("segment"), "text")


DECIDED = f"""m as ({MESSAGES}), d as (select *, 'D' || conversation as decision_id, case when conversation % 7 = 0 then (conversation // 7) % 7 else -1 end as fault,
    case when length(text) < 16 then substr(text, 1, 10) else substr(text, 6, 10) end as quote from (select * replace (coalesce(text, '') as text) from m))"""


@query(f"""with {DECIDED} select distinct decision_id, code, item from (
        select decision_id, 'no_reviewer' as code, decision_id as item from d where fault = 0 union all select decision_id, 'superseded_not_in_force', 'D?' from d where fault = 1
        union all select decision_id, 'unknown_piece', record_id || '?' from d where fault = 2 union all select decision_id, 'quote_not_covered', 'F' || node from d where fault = 2 and node % 2 = 0
        union all select decision_id, 'coverage_unexplained', record_id from d where fault = 3 union all select decision_id, 'no_attribution', 'F' || node from d where fault = 4 and node % 2 = 0
        union all select decision_id, 'material_without_quote', 'F' || node from d where fault = 5 and node % 2 = 0 union all select decision_id, 'quote_mismatch', 'F' || node from d where (fault = 6 or quote = '' and fault <> 5) and node % 2 = 0)""")
def decision_problems(spark, sf_dir):
    new, pieces, segments = _decisions(spark, sf_dir)
    none = spark.createDataFrame([], "decision_id string")
    return decisions.problems(new, pieces, segments, none, none.withColumn("piece_id", F.lit("")), none)


@query(f"""with {DECIDED} select decision_id, 'F' || node as finding_id from d where node % 2 = 0 and node % 3 = 0""")
def findings_without_piece(spark, sf_dir):
    new, _, _ = _decisions(spark, sf_dir)
    fewer = new["coverage"].withColumn("finding_ids", F.filter("finding_ids", lambda f: F.substring(f, 2, 9).cast("int") % 3 != 0))
    return decisions.linked(new["findings"], fewer)


@query(f"""with {DECIDED} select decision_id, case node % 8 when 0 then 'no_disposition' else 'integrated_without_entry' end as code, 'F' || node as item from d where node % 2 = 0 and node % 8 in (0, 2)""")
def disposition_problems(spark, sf_dir):
    """Findings of nodes that 8 divides have no disposition, those of remainder 2 are integrated without an entry."""
    new, _, _ = _decisions(spark, sf_dir)
    f = new["findings"].withColumn("n", F.substring("finding_id", 2, 9).cast("int"))
    entry = F.when(F.col("n") % 8 == 4, F.array(F.lit("E0001"))).otherwise(F.array().cast("array<string>"))
    settled = f.where("n % 8 <> 0").select(F.concat_ws("/", "decision_id", "finding_id").alias("key"), F.when(F.col("n") % 8 == 6, "excluded").otherwise("integrated").alias("outcome"), F.lit("why").alias("reason"), entry.alias("entry_ids"))
    return decisions.disposition_problems(new["findings"], settled)


@query(f"""with {DECIDED}, q as (select decision_id, 'F' || node as fid, quote, 'm' || node as oid, pointer from d where node % 2 = 0 and fault not in (5, 6)),
    doc as (select string_agg(case when conv_id % 3 = 0 then replace(text, 'e', '_') else text end, chr(1)) as t from conversations)
    select distinct decision_id, code, item from (
        select decision_id, 'quote_not_in_document' as code, fid as item from q, doc where not contains(t, quote) union all select decision_id, 'provenance_not_in_document', w from (select decision_id, unnest([oid, pointer]) as w from q), doc where not contains(t, w)
        union all select decision_id, 'unknown_entry', 'e0002' from q)""")
def integrated_text(spark, sf_dir):
    """Quotes and provenance looked for in a document made of all conversations; in every third one it reads otherwise."""
    new, _, _ = _decisions(spark, sf_dir)
    m = messages(spark, sf_dir)
    document = m.select(F.when(F.col("conversation") % 3 == 0, F.replace("text", F.lit("e"), F.lit("_"))).otherwise(F.col("text")).alias("text"))
    place = m.select(F.col("record_id").alias("message"), F.concat(F.lit("m"), "node").alias("original_id"), F.lit("").alias("sha256"), F.col("pointer").alias("json_pointer"))
    own = new["quotes"].join(new["decisions"].select("decision_id"), "decision_id").where("text <> 'wrong'").join(place, "message")
    keys = own.select(F.concat_ws("/", "decision_id", "finding_id").alias("key"), F.array(F.lit("E0002")).alias("entry_ids")).distinct()
    return decisions.text_problems(document, own, keys, spark.createDataFrame([("e0001",)], "entry string"))


@query("""select item_id, doc_id, (instr(d.text, b.text) - 1)::int as start, (instr(d.text, b.text) - 1 + length(b.text))::int as "end", 'exact' as check
    from benchmark b join documents d on contains(d.text, b.text)""")
def exact_quotes(spark, sf_dir):
    """Spans of benchmark items in documents, each proved on the text."""
    found = review.find_quotes(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote")), table(spark, sf_dir, "documents").select("doc_id", "text"))
    check = F.when(T.span(F.col("text"), F.col("start"), F.col("end")) == F.col("quote"), "exact").otherwise("text_mismatch")
    return found.select("item_id", "doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), check.alias("check"))


@query("""with a as (select user_id as decision_id, event_id as batch_id, ts from events), w as (select decision_id, max(ts) as t from a group by 1)
    select a.decision_id, max(batch_id)::bigint as batch_id, (select count(*) > 0 from (select ts from a b where b.decision_id = a.decision_id group by ts having count(*) > 1)) as ambiguous from a join w on a.decision_id = w.decision_id and a.ts = w.t group by a.decision_id""")
def latest_batches(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_id"), F.col("ts").alias("completed_at"), F.array("user_id").alias("decision_ids"))
    return review.latest_by_decision(e).select("decision_id", "batch_id", "ambiguous")


@query("""select event_id as batch_id, case when event_id % 5 = 0 then null else strftime(ts, '%Y-%m-%d %H:%M:%S') end as completed_on from events where event_id % 3 = 0""")
def completed_journals(spark, sf_dir):
    """Only journals that are complete; a time without a zone is no moment."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 5 != 0, "Z").otherwise(""))
    j = table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_id"), F.when(F.col("event_id") % 3 == 0, "complete").otherwise("installing").alias("status"), iso.alias("completed_at"))
    return review.completed(j).select("batch_id", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_on"))


@query("""with e as (select user_id, event_id, coalesce(sum(event_id % 50) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as before from events)
    select user_id, event_id, before::bigint as used_before from e where before < 200""")
def budgeted_jobs(spark, sf_dir):
    """Jobs of each queue that start before its budget of 200 is used up."""
    e = table(spark, sf_dir, "events").withColumn("cost", F.col("event_id") % 50)
    return packets.started_within(e, "user_id", ["event_id"], "cost", 200).select("user_id", "event_id", "used_before")


# documents


@query("""with e as (select event_id as start, 1 + event_id % 3 as level from events), w as (select start, level,
        min(case when level <= 1 then start end) over o as a, min(case when level <= 2 then start end) over o as b, min(start) over o as c
        from e window o as (order by start desc rows between unbounded preceding and 1 preceding))
    select start, coalesce(case level when 1 then a when 2 then b else c end, start + 50)::bigint as "end" from w""")
def section_ends(spark, sf_dir):
    """Sections end at the next heading of their level or a higher one, however far on; the last ones after 50 places."""
    h = table(spark, sf_dir, "events").select(F.col("event_id").alias("start"), (1 + F.col("event_id") % 3).alias("level"))
    return documents.next_heading(h, [], "start", "level", 3, SECTION_BLOCK).select("start", F.coalesce("next", F.col("start") + 50).alias("end"))


@query("""with s as (select page_id, page_id % 20 as document, regexp_replace(regexp_replace(lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))), '[^\\p{L}\\p{N} _-]', '', 'g'), ' ', '-', 'g') as slug from pages)
    select document, case when n = 0 then slug else slug || '-' || n end as target from (select document, slug, row_number() over (partition by document, slug order by page_id) - 1 as n from s)""")
def heading_anchors(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    heads = p.select((F.col("page_id") % 20).alias("document"), F.col("page_id").alias("start"), F.lit("heading").alias("kind"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return documents.anchors(heads).select("document", "target")


def _book(spark, sf_dir):
    """Documents of one entry and one source each; the entry cites the source, and one that isn't there."""
    d = table(spark, sf_dir, "documents")
    number = F.format_string("%04d", F.col("doc_id"))
    text = F.concat(F.lit("# Book\n## E"), number, F.lit(" — "), "source", F.lit("\nBody [S](#src-"), number, F.lit(") [T](#src-x"), (F.col("doc_id") % 5).cast("string"), F.lit(")\n\n# Sources\n<a id=\"src-"), number, F.lit("\"></a>\nsource of "), "lang", F.lit("\n"))
    return d.select(F.col("doc_id").cast("string").alias("document"), text.alias("text"))


@query("""with d as (select doc_id::varchar as document, 'E' || printf('%04d', doc_id) as entry_id, printf('%04d', doc_id) as n, doc_id, lang from documents)
    select document, entry_id, unnest(['src-' || n, 'src-x' || (doc_id % 5)]) as ref, unnest([sha256('source of ' || lang || chr(10)), 'unavailable']) as basis from d""")
def entry_basis(spark, sf_dir):
    docs = _book(spark, sf_dir)
    scanned = documents.lines(docs)
    found = documents.entries(docs, scanned)
    bases = documents.entry_bases(found, documents.entry_references(found), documents.source_blocks(docs, scanned))
    return bases.select("document", "entry_id", F.explode("sources").alias("ref", "basis"))


@query("""with d as (select doc_id, lang, source, printf('%04d', doc_id) as n from documents), b as (select n, doc_id % 3 as k, 'source of ' || lang || chr(10) as text from d)
    select 'src-' || n as source_id, case k when 0 then 'unknown_source' when 1 then 'stale_source' else 'text_mismatch' end as code from b where k < 2 or n::bigint % 2 = 0""")
def witness_problems(spark, sf_dir):
    """Witnesses of sources that aren't there, that changed, whose quote isn't at its place; every second of remainder 2 is
    right."""
    docs = _book(spark, sf_dir)
    blocks = documents.source_blocks(docs, documents.lines(docs))
    k = F.substring("source_id", 5, 99).cast("long")
    w = blocks.select("source_id", F.when(k % 3 == 1, "old").otherwise(F.col("sha256")).alias("source_sha256"), F.lit(0).alias("start"), F.lit(6).alias("end"), F.when(k % 2 == 0, "Source").otherwise("source").alias("quote"))
    return documents.witness_problems(w, blocks.where(k % 3 != 0)).select("source_id", "code")


@query("""with p as (select p_partkey as id, list_filter(list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}]{3,}')), lambda x: x not in ('the', 'and', 'with', 'from', 'into', 'after', 'before', 'about', 'while', 'their', 'that', 'this',
        'owner', 'account', 'record', 'feeling', 'reflection', 'later', 'original', 'conversation', 'source', 'for', 'was', 'had', 'not', 'but', 'has', 'its', 'are', 'who', 'his', 'her', 'she', 'him', 'out')) as w from part),
    c as (select max(id) as n from p), a as (select p.id, q.w as terms, len(list_intersect(q.w, p.w)) as own from p, c join p q on q.id = (p.id * 7) % c.n + 1),
    s as (select a.id, o.id as other, len(list_intersect(a.terms, o.w)) as shared, len(o.w) as n, own from a join p o on o.id <> a.id and len(list_intersect(a.terms, o.w)) >= greatest(3, a.own + 3)),
    r as (select *, row_number() over (partition by id order by shared / n desc, shared desc, other::varchar desc) as k from s)
    select id::varchar as entry_id, other::varchar as other, shared::bigint as shared, k::int as k from r where k <= 3""")
def similar_titles(spark, sf_dir):
    """Additions whose words are another part's name: the three titles that they fit best; a top-3 is the feature."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = p.agg(F.max("p_partkey")).first()[0] or 1
    at = (F.col("p_partkey") * 7) % n + 1
    added = p.select(F.lit("d").alias("document"), F.col("p_partkey").cast("string").alias("entry_id"), F.lit(0).alias("start"), F.lit(1).alias("end"), at.alias("at")).join(p.select(F.col("p_partkey").alias("at"), F.col("p_name").alias("text")), "at").drop("at")
    titles = p.select(F.lit("d").alias("document"), F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_name").alias("title"))
    return documents.misplaced_additions(added, titles).select("entry_id", "other", "shared", "k")


@query("""select code, count(*)::bigint as n from (select unnest(['external_or_missing_target', 'body_sources_missing_from_header', 'body_sources_missing_from_header']) as code from documents) group by 1""")
def audit_counts(spark, sf_dir):
    from attestry.operators.validate import histogram

    return histogram(documents.audit(_book(spark, sf_dir)))


@query("""select doc_id::varchar as document, 'broken_internal_link' as code, unnest(['src-' || printf('%04d', doc_id), 'src-x' || (doc_id % 5)]) as detail from documents""")
def writer_problems(spark, sf_dir):
    docs = _book(spark, sf_dir).withColumn("text", F.regexp_replace("text", '<a id=[^>]*></a>', ""))
    return writer.problems(writer.parts(docs))


def _kept(spark, sf_dir, later: bool):
    """Documents of front matter, numbered entries and sources, two protected blocks and encoded data; ``later`` ones lost
    a block (13 divides their number), changed one (7), lost an entry (5), repeat an anchor (3), or count wrong (2)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    gone = lambda k, part, other="": F.when(F.col("doc_id") % k == 0, F.lit(other)).otherwise(part) if later else part
    lit = F.lit
    own = F.concat(
        lit("---\nentry_count: "), gone(2, lit("2"), "9"), lit("\nnext_entry_id: "), gone(2, lit("E0003"), "E0002"), lit("\ndistinct_retained_sources: 1\n---\n## E0001 One\n"), gone(5, lit("## E0002 Two\n")),
        lit('<a id="src-001"></a>\n'), (F.when(F.col("doc_id") % 3 == 0, lit('<a id="src-001"></a>\n')).otherwise(lit("")) if later else lit("")),
        gone(13, F.concat(lit("```\n"), sha256(F.coalesce("text", lit(""))), lit("\n```\n"))), lit("~~~\n"), gone(7, F.coalesce("lang", lit("")), "x"), lit("\n~~~\ndata:x;base64,AA "), lit("\n"),
    )
    return d.select(F.col("doc_id").cast("string").alias("document"), own.alias("text"))


@query("""with d as (select doc_id, coalesce(lang, '') as lang from documents) select doc_id::varchar as document, code, detail from (
        select doc_id, 'protected_material_changed' as code, ((doc_id % 13 = 0)::int + (doc_id % 7 = 0 and lang <> 'x')::int)::varchar as detail from d where doc_id % 13 = 0 or (doc_id % 7 = 0 and lang <> 'x')
        union all select doc_id, 'removed_entries', 'E0002' from d where doc_id % 5 = 0
        union all select doc_id, unnest(['duplicate_anchors', 'duplicate_sources']), unnest(['src-001', 'SRC-001']) from d where doc_id % 3 = 0
        union all select doc_id, 'counter_mismatch', 'distinct_retained_sources' from d where doc_id % 3 = 0
        union all select doc_id, 'counter_mismatch', 'entry_count' from d where doc_id % 2 = 0 or doc_id % 5 = 0
        union all select doc_id, 'next_id_collision', 'next_entry_id' from d where doc_id % 2 = 0 and doc_id % 5 <> 0
        union all select doc_id, 'next_id_gap', 'next_entry_id' from d where doc_id % 2 = 1 and doc_id % 5 = 0)""")
def protected_blocks_lost(spark, sf_dir):
    """All checks of a document against the one before a change, protected blocks as a difference of multisets."""
    return writer.problems(writer.parts(_kept(spark, sf_dir, True)), writer.parts(_kept(spark, sf_dir, False)))


@query("""with d as (select doc_id from documents) select doc_id::varchar as document, code, detail from (
        select doc_id, 'report_id_mismatch' as code, 'R0002' as detail from d where doc_id % 3 = 0 union all select doc_id, 'duplicate_report_id', 'detailed' from d where doc_id % 5 = 0
        union all select doc_id, 'report_history_changed', 'simple' from d where doc_id % 7 = 0 union all select doc_id, 'simple_comparison_missing', 'R0001' from d where doc_id % 11 = 0)""")
def report_problems(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    when = lambda k, x: F.when(F.col("doc_id") % k == 0, F.lit(x)).otherwise(F.lit(""))
    unless = lambda k, x: F.when(F.col("doc_id") % k != 0, F.lit(x)).otherwise(F.lit(""))
    detailed = F.concat(F.lit("# Changes\n## R0001 one\nwhy\n"), when(5, "## R0001 again\n"), F.lit("## R0002 two\n```\n## R0009 quoted\n```\n"))
    simple = F.concat(unless(7, "# Changes\n"), F.lit("## R0001 one\n"), unless(11, "| Before | After |\n"), unless(3, "## R0002 two\n### Before\na\n### After\nb\n"))
    now = d.select(F.col("doc_id").alias("document"), detailed.alias("detailed"), simple.alias("simple"))
    return writer.report_problems(now, d.select(F.col("doc_id").alias("document"), F.lit("# Changes\n").alias("detailed"), F.lit("# Changes\n").alias("simple")))


@query("""select doc_id::varchar as ref, case when doc_id % 4 = 0 then 'selected_exact_excerpt' when doc_id % 4 = 1 then 'not_available_in_input' when length(text) <= 1600 and not regexp_matches(text, '(?i)data:[^\\s)]*;base64,') then 'complete_available_block'
    else 'external_not_included' end as access from documents""")
def evidence_access(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ref"), "doc_id", "text")
    blocks = d.where("doc_id % 4 <> 1").select(F.col("ref").alias("source_id"), "text")
    return writer.evidence_access(d, blocks, d.where("doc_id % 4 = 0").select(F.col("ref").alias("source_id")))
