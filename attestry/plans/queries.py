"""Queries of records, trees, packets, comparisons, reviews and documents over the driver's tables, and their SQL. Those of
imports and their validation, of stores and of decisions are in the modules imported at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.functions.identity import pointer_key, pointer_token, record_id, sha256, source_id, struct_fingerprint
from attestry.operators import delta, documents, graph, normalize, packets, proposals, review, validate
from attestry.plans.bridge import SOURCE, export_sides, messages, table
from attestry.plans.registry import MESSAGES, ORACLE_SQL, ORDERED, QUERIES, query

PACKET_CHARS = 1000


@query(f"""select record_id, conversation, node, pointer, sha256(text) as text_sha256,
           sha256('{{"node":' || node || ',"role":"' || role || '"}}') as fingerprint from ({MESSAGES})""")
def record_identities(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("record_id", "conversation", "node", "pointer", sha256(F.col("text")).alias("text_sha256"), struct_fingerprint(role=F.col("role"), node=F.col("node")).alias("fingerprint"))


@query("""select doc_id, replace(replace(source || '/~' || lang, '~', '~0'), '/', '~1') as token, source || '/~' || lang as back,
          'document:' || sha256('claude:' || sha256(text) || chr(10) || '/' || doc_id) as record_id from documents""")
def pointer_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("key", F.concat("source", F.lit("/~"), "lang"))
    rid = record_id("document", source_id(F.lit("claude"), sha256(F.col("text"))), F.concat(F.lit("/"), F.col("doc_id").cast("string")))
    return d.select("doc_id", pointer_token(F.col("key")).alias("token"), pointer_key(pointer_token(F.col("key"))).alias("back"), rid.alias("record_id"))


@query(f"""with m as ({MESSAGES}) select conversation, parent as node, count(*)::bigint as fan_out from m where parent is not null
    group by 1, 2 having count(*) > 1""")
def branch_points(spark, sf_dir):
    return graph.branch_points(messages(spark, sf_dir))


@query(f"""with m as ({MESSAGES}) select conversation, parent as node, string_agg(node::varchar, ',' order by position) as children
    from m where parent is not null group by 1, 2""")
def child_lists(spark, sf_dir):
    return graph.children(messages(spark, sf_dir)).select("conversation", "node", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


@query(f"with recursive {ORDERED} select conversation, node, ord::int as \"order\" from ordered")
def reading_order(spark, sf_dir):
    return graph.tree_order(messages(spark, sf_dir)).select("conversation", "node", "order")


@query(f"""with recursive m as ({MESSAGES}),
    up as (
        select conversation, node, parent, 0 as depth from m where (conversation, node) in (select conversation, max(node) from m group by 1)
        union all
        select m.conversation, m.node, m.parent, up.depth + 1 from m join up on m.conversation = up.conversation and m.node = up.parent
    ) select conversation, node, depth::int as depth from up""")
def selected_path(spark, sf_dir):
    m = messages(spark, sf_dir)
    return graph.selected_path(m.select("conversation", "node", "parent"), m.groupBy("conversation").agg(F.max("node").alias("current")))


@query(f"""with m as ({MESSAGES}), bad as (select conversation, node, case when node % 5 = 3 then node + 1000 else parent end as parent from m)
    select conversation, node, parent from bad b where parent is not null
    and not exists (select 1 from bad c where c.conversation = b.conversation and c.node = b.parent)""")
def dangling_parents(spark, sf_dir):
    bad = messages(spark, sf_dir).select("conversation", "node", F.when(F.col("node") % 5 == 3, F.col("node") + 1000).otherwise(F.col("parent")).alias("parent"))
    return graph.dangling_parents(bad).select("conversation", "node", "parent")


@query(f"""with recursive m as ({MESSAGES}),
    g as (select conversation, node, case when conversation % 6 = 0 and node = 0 and (select max(node) from m x where x.conversation = m.conversation) >= 2 then 2 else parent end as parent from m),
    walk as (
        select conversation, node as origin, parent as here from g where parent is not null
        union
        select w.conversation, w.origin, g.parent from walk w join g on g.conversation = w.conversation and g.node = w.here where g.parent is not null
    ) select distinct conversation, origin as node from walk where origin = here""")
def graph_cycles(spark, sf_dir):
    m = messages(spark, sf_dir)
    size = m.groupBy("conversation").agg(F.max("node").alias("last"))
    g = m.join(size, "conversation")
    g = g.withColumn("parent", F.when((F.col("conversation") % 6 == 0) & (F.col("node") == 0) & (F.col("last") >= 2), F.lit(2)).otherwise(F.col("parent")).cast("long"))
    return graph.cycle_members(g)


def _broken_lists(spark, sf_dir):
    m = messages(spark, sf_dir)
    kids = graph.children(m)
    full = m.select("conversation", "node", "parent").join(kids, ["conversation", "node"], "left")
    empty = F.array().cast("array<bigint>")
    listed = F.when(F.col("conversation") % 4 == 1, F.array_remove(F.coalesce("children", empty), F.lit(2).cast("long"))).when(F.col("conversation") % 4 == 2, F.concat(F.coalesce("children", empty), F.array(F.col("node")))).otherwise(F.coalesce("children", empty))
    return full.select("conversation", "node", "parent", listed.alias("children_ids"))


@query(f"""with m as ({MESSAGES}),
    listed as (
        select conversation, parent, node as child from m where parent is not null and not (conversation % 4 = 1 and node = 2)
        union all select conversation, node, node from m where conversation % 4 = 2
    ), named as (select conversation, parent, node as child from m where parent is not null)
    select conversation, parent, child, 'child_link' as code from (select * from listed except select * from named)
    union all select conversation, parent, child, 'parent_link' from (select * from named except select * from listed)""")
def link_mismatches(spark, sf_dir):
    return graph.link_mismatches(_broken_lists(spark, sf_dir))


@query(f"""with m as ({MESSAGES}), c as (select conversation, min(case when conversation % 9 = 0 then null else length(text) end) as created_at from m group by 1)
    select conversation, (row_number() over (order by created_at nulls first, conversation))::int as rank from c""")
def conversation_rank(spark, sf_dir):
    m = messages(spark, sf_dir)
    c = m.groupBy("conversation").agg(F.min(F.when(F.col("conversation") % 9 != 0, F.length("text"))).alias("created_at"))
    ranked = graph.conversation_rank(c.select("conversation", "created_at", F.col("conversation").alias("original_id"), F.col("conversation").cast("string").alias("record_id")))
    return ranked.select("conversation", "rank")


@query("""select conv_id as conversation, turn as node, s as start, least(s + 400, length(text))::int as "end", substr(text, s + 1, 400) as piece
    from (select conv_id, turn, text, unnest(range(0, greatest(length(text), 1), 400))::int as s from conversations)""")
def review_pieces(spark, sf_dir):
    m = messages(spark, sf_dir).select("conversation", "node", "text")
    return packets.split_spans(m, 400).select("conversation", "node", "start", "end", "piece")


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces in reading order with their packets."""
    m = messages(spark, sf_dir)
    ordered = graph.tree_order(m).select("conversation", "node", "order", "role", "text")
    pieces = packets.split_spans(ordered, PACKET_CHARS).withColumn("size", F.col("end") - F.col("start"))
    return packets.fill_packets(pieces.drop("text", "piece"), "conversation", ["order", "start"], "size", PACKET_CHARS)


@query(f"""with recursive {ORDERED},
    p as (select o.conversation, o.ord, s as start, least(s + {PACKET_CHARS}, length(t.text)) - s as size
          from ordered o join m t using (conversation, node), unnest(range(0, greatest(length(t.text), 1), {PACKET_CHARS})) as u(s)),
    n as (select *, row_number() over (partition by conversation order by ord, start) as k from p),
    f as (
        select conversation, k, size, 1 as packet, size as used from n where k = 1
        union all
        select n.conversation, n.k, n.size, case when f.used + n.size > {PACKET_CHARS} then f.packet + 1 else f.packet end,
               case when f.used + n.size > {PACKET_CHARS} then n.size else f.used + n.size end
        from f join n on n.conversation = f.conversation and n.k = f.k + 1
    ) select conversation, packet::int as packet, count(*)::bigint as pieces, sum(size)::bigint as chars from f group by 1, 2""")
def review_packets(spark, sf_dir):
    return packets.packet_summary(packed_pieces(spark, sf_dir), "conversation", "size")


@query("""with recursive n as (select source, doc_id, n_chars as size, row_number() over (partition by source order by doc_id) as k from documents),
    f as (
        select source, doc_id, k, size <= 30000 as included, case when size <= 30000 then 30000 - size else 30000 end as room from n where k = 1
        union all
        select n.source, n.doc_id, n.k, n.size <= f.room, case when n.size <= f.room then f.room - n.size else f.room end
        from f join n on n.source = f.source and n.k = f.k + 1
    ) select source, doc_id, included from f""")
def source_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return packets.budgeted(d, "source", ["doc_id"], "n_chars", 30_000).select("source", "doc_id", "included")


#: The later export in SQL, and the statuses of the delta.
SIDES = f"""m as ({MESSAGES}), last as (select conversation, max(node) as last from m group by 1),
    b as (select conversation, node, parent, sha256(text) as sha, coalesce(parent::varchar, '-') as ctx from m),
    a as (
        select conversation, node, parent, sha256(case when (conversation * 31 + node) % 17 = 0 then text || '!' else text end) as sha, coalesce(parent::varchar, '-') as ctx
        from m join last using (conversation) where not (conversation % 10 = 0 and node = last)
        union all select conversation, last + 1, last, sha256('a new turn'), last::varchar from last where conversation % 7 = 0
    ),
    j as (
        select coalesce(b.conversation, a.conversation) as conversation, coalesce(b.node, a.node) as node, b.sha as x, a.sha as y, b.ctx as cx, a.ctx as cy
        from b full join a on a.conversation = b.conversation and a.node = b.node
    ),
    links as (select conversation, parent, node from b where parent is not null union select conversation, parent, node from a where parent is not null),
    below as (
        select l.conversation, l.node from links l join j on j.conversation = l.conversation and j.node = l.parent where x is distinct from y or cx is distinct from cy
        union
        select l.conversation, l.node from links l join below w on l.conversation = w.conversation and l.parent = w.node
    ),
    s as (
        select conversation, node, case when x is null then 'new_messages' when y is null then 'not_present_messages' when x <> y then 'changed_messages'
            when cx is distinct from cy or (conversation, node) in (select (conversation, node) from below) then 'context_changed_messages'
            else 'unchanged_messages' end as status from j
    )"""


@query(f"with recursive {SIDES} select conversation, node, status from s")
def export_delta(spark, sf_dir):
    return delta.node_changes(*export_sides(spark, sf_dir))


@query(f"""with recursive {SIDES}, k as (select unnest(['{"','".join(delta.KINDS)}']) as kind)
    select kind, coalesce(n, 0)::bigint as n from k left join (select status as kind, count(*) as n from s group by 1) using (kind)""")
def export_delta_counts(spark, sf_dir):
    before, after = export_sides(spark, sf_dir)
    side = lambda d: d.groupBy("conversation").agg(F.lit("same").alias("metadata_sha"))
    return delta.counts(delta.node_changes(before, after), delta.conversation_changes(side(before), side(after)))


def _quotes(spark, sf_dir):
    m = messages(spark, sf_dir)
    wrong = F.when(F.col("node") % 3 == 0, F.substring("text", 11, 20)).otherwise(F.substring("text", 12, 20))
    quotes = m.select(F.col("record_id").alias("message"), F.lit(0).alias("segment"), F.lit(10).alias("start"), F.lit(30).alias("end"), wrong.alias("quote"))
    return quotes, m.select(F.col("record_id").alias("message"), F.lit(0).alias("segment"), "text")


@query(f"""with m as ({MESSAGES}), q as (select record_id as message, case when text is null then 'unknown_segment' when length(text) < 30 then 'bad_span'
        when substr(text, 11, 20) <> case when node % 3 = 0 then substr(text, 11, 20) else substr(text, 12, 20) end then 'text_mismatch' end as code from m)
    select message, code from q where code is not null""")
def quote_problems(spark, sf_dir):
    return review.quote_problems(*_quotes(spark, sf_dir)).select("message", "code")


#: Pieces of 400 code points; those of turns that 3 divides are covered, by the decision conversation % 5.
REVIEWED = f"""m as ({MESSAGES}),
    p as (select conversation, node, record_id as message, s as p_start, least(s + 400, length(text)) as p_end, record_id || ':' || s as piece_id
          from (select *, unnest(range(0, greatest(length(text), 1), 400)) as s from m)),
    c as (select piece_id, 'D' || (conversation % 5) as decision_id from p where node % 3 = 0 or conversation % 3 = 0)"""


def _reviewed(spark, sf_dir):
    m = messages(spark, sf_dir).select("conversation", "node", F.col("record_id").alias("message"), F.lit(0).alias("segment"), "text")
    pieces = packets.split_spans(m, 400).drop("text", "piece").withColumn("piece_id", F.concat("message", F.lit(":"), F.col("start").cast("string")))
    coverage = pieces.where("node % 3 = 0 or conversation % 3 = 0").select("piece_id", F.concat(F.lit("D"), (F.col("conversation") % 5).cast("string")).alias("decision_id"))
    return pieces, coverage


@query(f"""with {REVIEWED} select p.message, p.piece_id from m join p on p.message = m.record_id
    where p_start < 430 and p_end > 390 and piece_id not in (select piece_id from c)""")
def uncovered_quotes(spark, sf_dir):
    pieces, coverage = _reviewed(spark, sf_dir)
    quotes = messages(spark, sf_dir).select(F.col("record_id").alias("message"), F.lit(0).alias("segment"), F.lit(390).alias("start"), F.lit(430).alias("end"))
    return review.uncovered_quotes(quotes, pieces, coverage).select("message", "piece_id")


@query(f"""with {REVIEWED}, x as (select conversation, count(c.piece_id) as covered, count(*) as total,
        bool_or(coalesce(decision_id = 'D3', false)) as open, bool_and(coalesce(decision_id in ('D0', 'D1'), false)) as ins
        from p left join c using (piece_id) group by 1)
    select conversation, covered::bigint as covered, total::bigint as total, case when covered = 0 then 'pending' when covered < total then 'partial'
        when open then 'reviewed_with_gaps' when ins then 'integrated' else 'reviewed_not_integrated' end as state from x""")
def review_status(spark, sf_dir):
    pieces, coverage = _reviewed(spark, sf_dir)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "decision_id string")
    return review.review_status(pieces, coverage, ids("D0", "D1"), ids("D3"))


@query(f"with {REVIEWED} select conversation as packet, count(*)::bigint as pending from p where piece_id not in (select piece_id from c) group by 1")
def pending_packets(spark, sf_dir):
    pieces, coverage = _reviewed(spark, sf_dir)
    return review.pending_packets(pieces.withColumn("packet", F.col("conversation")), coverage)


@query("""with e as (select event_id as decision_id, case when event_id % 3 = 0 and event_id > 2 then event_id - 2 end as supersedes from events)
    select decision_id, supersedes from e where decision_id not in (select supersedes from e where supersedes is not null)""")
def decisions_in_force(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return review.decisions_in_force(e.select(F.col("event_id").alias("decision_id"), F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") > 2), F.col("event_id") - 2).alias("supersedes")))


@query("""with d as (select doc_id as piece_id, unnest([doc_id % 7, doc_id % 11]) as decision_id from documents)
    select piece_id, count(distinct decision_id)::bigint as decisions from d group by 1 having count(distinct decision_id) > 1""")
def coverage_overlaps(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("piece_id"), F.explode(F.array(F.col("doc_id") % 7, F.col("doc_id") % 11)).alias("decision_id"))
    return review.coverage_overlaps(d)


@query("""with a as (select user_id as finding, date_trunc('day', ts) as completed_at, count(*) as n, max(event_type) as outcome from events group by 1, 2)
    select finding, strftime(max(completed_at), '%Y-%m-%d') as completed_on, arg_max(outcome, completed_at) as outcome, max(n) > 1 as ambiguous from a group by 1""")
def latest_dispositions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("finding"), F.date_trunc("day", "ts").alias("completed_at"), F.col("event_type").alias("outcome"))
    return review.latest_dispositions(e).select("finding", F.date_format("completed_at", "yyyy-MM-dd").alias("completed_on"), "outcome", "ambiguous")


@query(f"""with m as ({MESSAGES}),
    g as (select conversation % 4 as decision_id, conversation, node, case when node % 2 = 0 then record_id end as rid, case when node % 2 = 1 then 'm' || node end as mid, pointer || '/content/parts/0' as jp from m),
    f as (select g.conversation, g.node, m.record_id from g join m on m.conversation % 4 = g.decision_id
          and (m.record_id = g.rid or 'm' || m.node = g.mid) and starts_with(g.jp, m.pointer || '/'))
    select g.conversation || '-' || g.node as gap, count(f.record_id)::bigint as candidates, case when count(f.record_id) = 1 then min(f.record_id) end as message
    from g left join f on f.conversation = g.conversation and f.node = g.node group by 1""")
def media_gaps(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("decision_id", F.col("conversation") % 4).withColumn("original_id", F.concat(F.lit("m"), F.col("node").cast("string")))
    gaps = m.select(
        F.concat(F.col("conversation").cast("string"), F.lit("-"), F.col("node").cast("string")).alias("gap"), "decision_id",
        F.when(F.col("node") % 2 == 0, F.col("record_id")).alias("message_record_id"), F.when(F.col("node") % 2 == 1, F.col("original_id")).alias("message_id"),
        F.concat("pointer", F.lit("/content/parts/0")).alias("json_pointer"),
    )
    return review.media_gaps(gaps, m.select("decision_id", F.col("record_id").alias("message"), "original_id", "pointer"))


@query("""select user_id as worker, count(*)::bigint as attempts, case when bool_or(value > 95) then null else sum(event_id) end::bigint as input_tokens,
    sum(event_id % 100)::bigint as output_tokens from events group by 1""")
def usage_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return review.usage_totals(e.select(F.col("user_id").alias("worker"), F.when(F.coalesce(F.col("value") > 95, F.lit(False)), F.lit(None)).otherwise(F.col("event_id")).alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens")), "worker")


@query("""with d as (select doc_id, '[S](#src-' || ((doc_id * 7) % 1100) || ') and [T](#e%C3%A9' || (doc_id % 3) || ')' as text from documents),
    l as (select doc_id, unnest(['src-' || ((doc_id * 7) % 1100), 'eé' || (doc_id % 3)]) as target from d)
    select doc_id, target from l where target not in (select 'src-' || doc_id from documents)""")
def broken_links(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    body = F.concat(F.lit("[S](#src-"), ((F.col("doc_id") * 7) % 1100).cast("string"), F.lit(") and [T](#e%C3%A9"), (F.col("doc_id") % 3).cast("string"), F.lit(")"))
    links = d.select("doc_id", F.explode(T.link_targets(body)).alias("target"))
    return links.join(d.select(F.concat(F.lit("src-"), F.col("doc_id").cast("string")).alias("target")), "target", "left_anti").select("doc_id", "target")


@query("""select event_id, case when s is null then 'missing' when regexp_matches(s, '^-?\\d+(\\.\\d+)?$') or regexp_matches(s, 'Z$') then 'valid' else 'invalid' end as state
    from (select event_id, case event_id % 4 when 0 then null when 1 then epoch(ts)::bigint::varchar when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') else strftime(ts, '%Y-%m-%dT%H:%M:%S') end as s from events)""")
def timestamp_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 4 == 1, F.unix_timestamp("ts").cast("string")).when(F.col("event_id") % 4 == 2, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 4 == 3, iso)
    return e.select("event_id", T.timestamp_state(raw).alias("state"))


@query(f"""with m as ({MESSAGES}), d as (select record_id from m where node % 6 <> 5 union all select record_id from m where node % 6 = 4)
    select record_id, case when x > y then 'not in the source' else 'not derived' end as detail
    from (select record_id, count(*) filter (where k = 0) as x, count(*) filter (where k = 1) as y from (select record_id, 0 as k from d union all select record_id, 1 from m) group by 1) where x <> y""")
def source_census(spark, sf_dir):
    m = messages(spark, sf_dir).select("record_id", "node")
    derived = m.where("node % 6 <> 5").unionByName(m.where("node % 6 = 4"))
    return validate.census_difference(derived, m, ["record_id"]).select("record_id", "detail")


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge's conversations as raw rows of the import: one JSON text for each, in the ChatGPT form."""
    m = messages(spark, sf_dir)
    kids = graph.children(m)
    j = lambda c: F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})) - 6)
    full = m.join(kids, ["conversation", "node"], "left")
    key = F.col("node").cast("string")
    message = F.concat(F.lit('{"id":"m'), key, F.lit('","author":{"role":"'), "role", F.lit('"},"create_time":null,"content":{"content_type":"text","parts":['), j(F.col("text")), F.lit("]}}"))
    parent = F.coalesce(F.concat(F.lit('"'), F.col("parent").cast("string"), F.lit('"')), F.lit("null"))
    children = F.to_json(F.coalesce(F.col("children").cast("array<string>"), F.array().cast("array<string>")))
    entry = F.concat(F.lit('"'), key, F.lit('":{"id":"'), key, F.lit('","parent":'), parent, F.lit(',"children":'), children, F.lit(',"message":'), message, F.lit("}"))
    listed = full.groupBy("conversation").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))), lambda x: x["e"]).alias("entries"))
    text = F.concat(F.lit('{"id":"c'), F.col("conversation").cast("string"), F.lit('","title":null,"mapping":{'), F.array_join("entries", ","), F.lit("}}"))
    return listed.select(F.lit(SOURCE).alias("source_id"), F.lit("chatgpt").alias("provider"), F.lit("driver").alias("sha256"), F.col("conversation").alias("index"), text.alias("conversation"), F.lit(None).cast("string").alias("error"))


@query(f"""with m as ({MESSAGES}) select record_id, 'c' || conversation as conversation, 'm' || node as original_id, node::varchar as node_id, parent::varchar as parent_id,
    position::int as position, role, text from m""")
def normalized_messages(spark, sf_dir):
    t = normalize.chatgpt(exported(spark, sf_dir))
    segments = t.segments.where("segment_index = 0").select(F.col("message_record_id").alias("record_id"), "text")
    return t.messages.join(segments, "record_id").select("record_id", F.col("conversation_original_id").alias("conversation"), "original_id", "node_id", "parent_id", "position", "role", "text")


@query(f"""with m as ({MESSAGES}) select 'c' || conversation as conversation, count(*)::bigint as message_count, 0::bigint as warnings from m group by 1""")
def normalized_conversations(spark, sf_dir):
    t = normalize.chatgpt(exported(spark, sf_dir))
    warned = t.warnings.agg(F.count("*").alias("warnings"))
    return t.conversations.select(F.col("original_id").alias("conversation"), "message_count").join(F.broadcast(warned)).select("conversation", "message_count", "warnings")


def _book(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    number = F.format_string("%04d", F.col("doc_id"))
    text = F.concat(F.lit("# Book\n## E"), number, F.lit(" — "), "source", F.lit("\n**Source references:** [S](#src-"), number, F.lit(")\nBody in "), "lang", F.lit(" [T](#src-x"), (F.col("doc_id") % 5).cast("string"), F.lit(")\n\n# Sources\n<a id=\"src-"), number, F.lit("\"></a>\nsource of "), "lang", F.lit("\n"))
    return d.select(F.col("doc_id").cast("string").alias("document"), text.alias("text"))


@query("""with d as (select doc_id, printf('%04d', doc_id) as n, source, lang from documents)
    select doc_id::varchar as document, 'E' || n as entry_id, source as title,
        sha256('## E' || n || ' — ' || source || chr(10) || '**Source references:** [S](#src-' || n || ')' || chr(10) || 'Body in ' || lang || ' [T](#src-x' || (doc_id % 5) || ')' || chr(10)) as sha256 from d""")
def document_entries(spark, sf_dir):
    docs = _book(spark, sf_dir)
    return documents.entries(docs, documents.lines(docs)).select("document", "entry_id", "title", "sha256")


@query("""select doc_id::varchar as document, 'src-' || printf('%04d', doc_id) as source_id, sha256('source of ' || lang || chr(10)) as sha256 from documents""")
def document_sources(spark, sf_dir):
    docs = _book(spark, sf_dir)
    return documents.source_blocks(docs, documents.lines(docs)).select("document", "source_id", "sha256")


@query("""with d as (select doc_id::varchar as document, 'E' || printf('%04d', doc_id) as entry_id, 'src-x' || (doc_id % 5) as detail from documents)
    select document, unnest(['external_or_missing_target', 'body_sources_missing_from_header']) as code, entry_id, detail from d""")
def document_audit(spark, sf_dir):
    return documents.audit(_book(spark, sf_dir))


@query(f"""with m as ({MESSAGES}), p as (select conversation, node, role, text, node % 4 = 3 as covered from m),
    e as (select *, substr(text, 3, 6) as span, case when node % 5 = 4 then 'wrong!' else substr(text, 3, 6) end as quote from p where length(text) >= 20)
    select conversation::varchar as packet, code, item from (
        select conversation, 'quote_mismatch' as code, 'k' || node as item from e where quote <> span
        union select conversation, 'assistant_as_owner', 'k' || node from e where role = 'assistant'
        union select conversation, 'owner_without_user_text', 'k' || node from e where role <> 'user'
        union select conversation, 'no_pending_evidence', 'k' || node from e where covered
        union select conversation, 'uncovered_piece', node::varchar from p where not covered and node % 7 = 6
        union select conversation, 'links_differ', p.node::varchar from p where not covered and node % 7 <> 6 and length(text) < 20
        union select conversation, 'coverage_not_pending', node::varchar from p where covered and node % 7 <> 6
        union select conversation, 'links_differ', node::varchar from p where covered and node % 7 <> 6)""")
def proposal_problems(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("packet", F.col("conversation").cast("string")).withColumn("piece_id", F.col("node").cast("string"))
    cid = F.concat(F.lit("k"), "piece_id")
    pieces = m.select("packet", "piece_id", "text", "role", F.lit("text").alias("kind"), F.lit(0).alias("segment_index"), (F.col("node") % 4 == 3).alias("already_covered"))
    coverage = m.where("node % 7 <> 6").select("packet", "piece_id", F.lit("candidate").alias("disposition"), F.lit("why").alias("reason"), F.array(cid).alias("candidate_ids"))
    some = m.where("length(text) >= 20")
    candidates = some.select("packet", cid.alias("candidate_id"), F.lit("owner_statement").alias("attribution"), F.lit("says").alias("statement"))
    quote = F.when(F.col("node") % 5 == 4, "wrong!").otherwise(F.substring("text", 3, 6))
    evidence = some.select("packet", cid.alias("candidate_id"), "piece_id", F.lit(2).alias("start"), F.lit(8).alias("end"), quote.alias("quote"))
    return proposals.problems(pieces, coverage, candidates, evidence)


# the rest of the registry
from attestry.plans import reviewing, storing, validation  # noqa: E402

__all__ = ["ORACLE_SQL", "QUERIES", "reviewing", "storing", "validation"]
