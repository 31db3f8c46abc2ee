"""Queries of imports and their validation: both providers' projections of the bridge's conversations, and each group of
rules over derived tables that were changed in stated places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import normalize, validate
from attestry.operators.census import census
from attestry.operators.rounds import Once, written
from attestry.plans.bridge import CLAUDE_ROOT, SOURCE, raw_chatgpt, raw_claude
from attestry.plans.registry import MESSAGES, query

#: The records' ids in SQL.
C_ID = "'conversation:' || sha256('chatgpt:driver' || chr(10) || '/' || conversation)"
M = f"m as ({MESSAGES}), cs as (select conversation, {C_ID} as c_id, max(node) as last, count(*) as n from m group by 1)"
A_ID = "'attachment:' || sha256('chatgpt:driver' || chr(10) || pointer || '/metadata/attachments/0')"
I_ID = "'attachment:' || sha256('chatgpt:driver' || chr(10) || pointer || '/content/parts/1')"
#: Attachments of every third node, images of every fourth from 1.
A = f"""a as (select conversation, node, {A_ID} as a_id, 'attachment' as kind, 'n' || node || '.txt' as name, 'f' || node as id from m where node % 3 = 0
    union all select conversation, node, {I_ID}, 'multimodal_reference', 'p.png', null from m where node % 4 = 1)"""


def tables(raw: DataFrame, keep: normalize.Keep = normalize.anew) -> dict[str, DataFrame]:
    t = normalize.normalize(raw, keep)
    return {k: getattr(t, k) for k in ("conversations", "nodes", "messages", "segments", "attachments", "warnings")}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(SOURCE, "chatgpt", "driver", [("f", None)])], "source_id string, provider string, sha256 string, locations array<struct<path string, member string>>")


def at(name: str):
    """A number out of a record's pointer: its conversation's or its node's."""
    place = {"conversation": r"^/(\d+)", "node": r"/mapping/(\d+)/"}[name]
    return F.regexp_extract("provenance.json_pointer", place, 1).cast("long")


def dataset(spark: SparkSession, sf_dir: str, change=None, raw=None, own=None, **more) -> validate.Dataset:
    """``raw``, ``own``: the export and its tables before ``change``, if the caller has them."""
    raw = written(raw_chatgpt(spark, sf_dir)) if raw is None else raw
    own = own or tables(raw)
    return validate.Dataset({**own, **(change(own) if change else {})}, raw, more.pop("sources", sources(spark)), census(raw), **more)


@query(f"""with {M}, {A} select a_id as record_id, kind as attachment_kind, name as filename, id as original_id, 'unverified_reference' as availability from a""")
def attachment_records(spark, sf_dir):
    return tables(raw_chatgpt(spark, sf_dir))["attachments"].select("record_id", "attachment_kind", "filename", "original_id", "availability")


@query(f"""with {M}, {A}, f as (select *, case when kind <> 'attachment' then 'unverified_reference' when node % 2 = 0 then 'local_filename_match' when node = 3 then 'ambiguous_candidates' else 'missing' end as state from a)
    select a_id as record_id, state as availability, case when state = 'local_filename_match' then '/r/' || name end as resolved_path, case when state = 'local_filename_match' then 'h' || name end as sha256 from f""")
def attachment_availability(spark, sf_dir):
    """Names found below two roots: even ones once, n3.txt in both, others nowhere."""
    t = tables(raw_chatgpt(spark, sf_dir))["attachments"]
    roots = spark.createDataFrame([(SOURCE, "/r"), (SOURCE, "/s")], "source_id string, root string")
    names = t.where("attachment_kind = 'attachment'").select(F.col("filename").alias("name")).distinct().withColumn("n", F.regexp_extract("name", r"\d+", 0).cast("int"))
    files = names.where("n % 2 = 0").select(F.lit("/r").alias("root"), "name").unionByName(names.where("n = 3").select(F.explode(F.array(F.lit("/r"), F.lit("/s"))).alias("root"), "name"))
    files = files.select("root", "name", F.concat("root", F.lit("/"), "name").alias("path"), F.concat(F.lit("h"), "name").alias("sha256"))
    return normalize.resolve_attachments(t, roots, files).select("record_id", "availability", "resolved_path", "sha256")


CLAUDE = f"""m as ({MESSAGES}), k as (select *, '/' || conversation || '/chat_messages/' || node as jp from m), x as (select *, 'message:' || sha256('claude:driver' || chr(10) || jp) as rid from k)"""


@query(f"""with {CLAUDE} select rid as record_id, 'k' || conversation as conversation, 'u' || node as node_id, coalesce('u' || parent, '{CLAUDE_ROOT}') as parent_id, node::int as position,
    case role when 'user' then 'user' when 'assistant' then 'assistant' else 'unknown' end as role, case role when 'user' then 'human' else role end as role_raw from x""")
def claude_messages(spark, sf_dir):
    m = tables(raw_claude(spark, sf_dir))["messages"]
    return m.select("record_id", F.col("conversation_original_id").alias("conversation"), "node_id", "parent_id", "position", "role", "role_raw")


@query(f"""with {CLAUDE}, s as (select rid, 0 as k, jp || '/text' as json_pointer, text, 'text' as kind from x union all select rid, 1, jp || '/content/0/text', text, 'text' from x
        union all select rid, 2, jp || '/attachments/0/extracted_content', 'inside ' || node, 'attachment_text' from x where node % 3 = 0)
    select rid as message_record_id, k::int as segment_index, json_pointer, text, kind from s""")
def claude_segments(spark, sf_dir):
    return tables(raw_claude(spark, sf_dir))["segments"].select("message_record_id", "segment_index", "json_pointer", "text", "kind")


@query(f"""with {CLAUDE}, c as (select conversation, parent, string_agg('u' || node, ',' order by node) as kids from m where parent is not null group by 1, 2)
    select rid as message_record_id, coalesce(kids, '') as children, case when x.parent is null then 1 else 0 end::int as rooted
    from x left join c on c.conversation = x.conversation and c.parent = x.node""")
def claude_nodes(spark, sf_dir):
    n = tables(raw_claude(spark, sf_dir))["nodes"]
    return n.select("message_record_id", F.array_join("children_ids", ",").alias("children"), (F.col("parent_id") == CLAUDE_ROOT).cast("int").alias("rooted"))


def _codes(found: DataFrame) -> DataFrame:
    return found.select("code", "record_id")


def change_identity(t):
    c = t["conversations"].withColumn("n", at("conversation"))
    c = c.withColumn("schema_version", F.when(F.col("n") % 10 == 1, "0.9").otherwise(F.col("schema_version"))).withColumn("provider", F.when(F.col("n") % 10 == 2, "claude").otherwise(F.col("provider")))
    m = t["messages"].withColumn("record_id", F.when(at("node") % 7 == 6, F.concat("record_id", F.lit("x"))).otherwise(F.col("record_id")))
    return {"conversations": c.drop("n"), "messages": m}


@query(f"""with {M} select 'record_version' as code, c_id as record_id from cs where conversation % 10 = 1 union all select 'provenance', c_id from cs where conversation % 10 = 2
    union all select 'record_identity', record_id || 'x' from m where node % 7 = 6 union all select 'importer_version', null union all select 'schema_version', null
    union all select 'source_identity', 'chatgpt:other' union all select 'source_collision', 'chatgpt:driver'""")
def validation_identity(spark, sf_dir):
    own = sources(spark)
    wrong = own.withColumn("source_id", F.lit("chatgpt:other"))
    return _codes(dataset(spark, sf_dir, change_identity, sources=own.unionByName(own).unionByName(wrong), manifest={"schema_version": "0", "importer_version": "0"}).identity())


def change_unique(t):
    c = t["conversations"]
    n = t["nodes"]
    number = F.col("node_id").cast("int")
    twice = n.where(number % 4 == 2).withColumn("children_ids", F.array(F.lit("9"), F.lit("9")))
    return {"conversations": c.unionByName(c.where(at("conversation") % 10 == 3)), "nodes": n.where(number % 4 != 2).unionByName(twice).unionByName(n.where("node_id = '1'"))}


@query(f"""with {M} select 'record_id_collision' as code, c_id as record_id from cs where conversation % 10 = 3 union all select 'source_pointer_collision', 'chatgpt:driver' from cs where conversation % 10 = 3
    union all select 'node_collision', c_id from cs where last >= 1 union all select 'duplicate_child', c_id from m join cs using (conversation) where node % 4 = 2
    union all select 'conversation_id_collision', 'chatgpt:driver' where (select count(*) from cs) > 0""")
def validation_unique(spark, sf_dir):
    d = dataset(spark, sf_dir, change_unique)
    # the source itself names one id twice
    first = d.source["conversation"].orderBy("at").limit(1)
    d.source["conversation"] = d.source["conversation"].unionByName(first)
    return _codes(d.uniqueness())


@query(f"""with {M} select 'source_coverage' as code, 'chatgpt:driver|' || pointer as record_id, 'not derived' as detail from m where node % 6 = 5
    union all select 'source_coverage', 'chatgpt:driver|/x' || pointer, 'not in the source' from m where node % 6 = 4
    union all select 'source_coverage', 'chatgpt:driver|' || pointer, 'not derived' from m where node % 6 = 4
    union all select 'provider_count', 'chatgpt_messages', count(*) filter (where node % 6 <> 5) || '/' || count(*) from m having count(*) filter (where node % 6 = 5) > 0
    union all select 'expected_count', 'chatgpt_conversations', count(*) || '/3' from cs having count(*) <> 3""")
def validation_coverage(spark, sf_dir):
    def change(t):
        m = t["messages"].where(at("node") % 6 != 5)
        moved = F.struct(F.col("provenance.source_id").alias("source_id"), F.col("provenance.sha256").alias("sha256"), F.concat(F.lit("/x"), "provenance.json_pointer").alias("json_pointer"))
        return {"messages": m.withColumn("provenance", F.when(at("node") % 6 == 4, moved).otherwise(F.col("provenance")))}

    return dataset(spark, sf_dir, change, expected={"chatgpt_conversations": 3}).coverage()


@query(f"""with {M} select code, c_id as record_id from cs, (select unnest(['metadata_fidelity', 'conversation_identity', 'title_fidelity', 'timestamp_fidelity', 'branch_selection', 'graph_fidelity']) as code, unnest(range(0, 6)) as k)
    where conversation % 8 = k""")
def validation_conversations(spark, sf_dir):
    def change(t):
        c = t["conversations"].withColumn("n", at("conversation") % 8)
        new = {"raw_metadata": F.lit('{"id":1}'), "original_id": F.lit("other"), "title": F.lit(None).cast("string"), "updated_at_raw": F.lit("1"), "current_node_id": F.lit("77")}
        c = c.withColumns({k: F.when(F.col("n") == i, v).otherwise(F.col(k)) for i, (k, v) in enumerate(new.items())})
        fifth = c.where("n = 5").select(F.col("record_id").alias("conversation_record_id"), F.lit(True).alias("fifth"))
        n = t["nodes"].join(fifth, "conversation_record_id", "left").withColumn("node_fields", F.when(F.col("fifth") & (F.col("node_id") == "0"), '{"id":"0"}').otherwise(F.col("node_fields"))).drop("fifth")
        return {"conversations": c.drop("n"), "nodes": n}

    return _codes(dataset(spark, sf_dir, change).conversations())


@query(f"""with {M} select code, record_id from m, (select unnest(['raw_fidelity', 'conversation_membership', 'role_fidelity', 'timestamp_fidelity', 'message_identity', 'content_kind']) as code, unnest(range(0, 6)) as k) where node % 8 = k
    union all select unnest(['text_fidelity', 'text_pointer']), record_id from m where node % 8 = 6 union all select 'conversation_reference', record_id from m where node % 8 = 7""")
def validation_messages(spark, sf_dir):
    def change(t):
        m = t["messages"].withColumn("n", at("node") % 8)
        new = {"raw": F.lit('{"id":"m0"}'), "conversation_original_id": F.lit("c?"), "role": F.lit("tool"), "created_at_raw": F.lit("5"), "original_id": F.lit("m?"), "content_kind": F.lit("code")}
        m = m.withColumns({k: F.when(F.col("n") == i, v).otherwise(F.col(k)) for i, (k, v) in enumerate(new.items())})
        m = m.withColumn("conversation_record_id", F.when(F.col("n") == 7, "conversation:?").otherwise(F.col("conversation_record_id")))
        sixth = m.where("n = 6").select(F.col("record_id").alias("message_record_id"), F.lit(True).alias("sixth"))
        s = t["segments"].join(sixth, "message_record_id", "left").withColumn("text", F.when(F.col("sixth"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).drop("sixth")
        return {"messages": m.drop("n"), "segments": s}

    return _codes(dataset(spark, sf_dir, change).messages())


@query(f"""with {M}, {A} select code, a_id as record_id from a, (select unnest(['attachment_fidelity', 'attachment_membership', 'attachment_kind', 'attachment_metadata']) as code, unnest(range(0, 4)) as k) where kind = 'attachment' and (node / 3) % 5 = k
    union all select unnest(['attachment_membership', 'attachment_source_membership']), a_id from a where kind = 'attachment' and (node / 3) % 5 = 4
    union all select 'attachment_availability', a_id from a where kind <> 'attachment'""")
def validation_attachments(spark, sf_dir):
    def change(t):
        roots = spark.createDataFrame([], "source_id string, root string")
        files = spark.createDataFrame([], "root string, name string, path string")
        a = normalize.resolve_attachments(t["attachments"], roots, files).withColumn("n", F.when(F.col("attachment_kind") == "attachment", (at("node") / 3).cast("int") % 5))
        new = {"raw": F.lit("{}"), "conversation_record_id": F.lit("conversation:?"), "attachment_kind": F.lit("file_reference"), "filename": F.lit("other")}
        a = a.withColumns({k: F.when(F.col("n") == i, v).otherwise(F.col(k)) for i, (k, v) in enumerate(new.items())})
        a = a.withColumn("message_record_id", F.when(F.col("n") == 4, "message:?").otherwise(F.col("message_record_id"))).withColumn("availability", F.when(F.col("n").isNull(), "missing").otherwise(F.col("availability")))
        return {"attachments": a.drop("n")}

    none = spark.createDataFrame([], "source_id string, root string"), spark.createDataFrame([], "root string, name string, path string")
    return _codes(dataset(spark, sf_dir, change, roots=none[0], files=none[1]).attachments())


@query(f"""with {M} select 'invalid_timestamp' as code, record_id, '2024-01-01T00:00:00' as detail from m where node % 5 = 2 union all select 'invalid_timestamp', c_id, 'true' from cs where conversation % 10 = 6""")
def validation_timestamps(spark, sf_dir):
    def change(t):
        return {
            "messages": t["messages"].withColumn("updated_at_raw", F.when(at("node") % 5 == 2, "2024-01-01T00:00:00").when(at("node") % 5 == 1, "2024-01-01T00:00:00+02:00")),
            "conversations": t["conversations"].withColumn("created_at_raw", F.when(at("conversation") % 10 == 6, "true").otherwise(F.col("created_at_raw"))),
        }

    return dataset(spark, sf_dir, change).timestamps()


@query(f"""with {M} select 'missing_current_node' as code, c_id as record_id from cs where conversation % 10 = 1 union all select 'conversation_message_count', c_id from cs where conversation % 10 = 2
    union all select unnest(['dangling_parent', 'child_link', 'node_message_link']), c_id from m join cs using (conversation) where node = 3 and conversation % 10 = 3
    union all select unnest(['graph_cycle', 'node_message_link']), c_id from m join cs using (conversation) where node = 4 and conversation % 10 = 4
    union all select unnest(['child_link', 'parent_link', 'graph_cycle']), c_id from m join cs using (conversation) where node = 4 and conversation % 10 = 4
    union all select 'parent_link', c_id from m join cs using (conversation) where node = 2 and conversation % 10 = 5
    union all select 'node_message_link', c_id from m join cs using (conversation) where node = 1 and conversation % 10 = 6""")
def validation_graph(spark, sf_dir):
    def change(t):
        c = t["conversations"].withColumn("n", at("conversation") % 10)
        c = c.withColumn("current_node_id", F.when(F.col("n") == 1, "77").otherwise(F.col("current_node_id"))).withColumn("message_count", F.col("message_count") + (F.col("n") == 2).cast("int"))
        n = t["nodes"].join(c.select(F.col("record_id").alias("conversation_record_id"), "n"), "conversation_record_id")
        at_ = lambda k, node: (F.col("n") == k) & (F.col("node_id") == node)
        # 3: a parent that isn't there; 4: nodes 2 and 4 point at each other; 5: a child that its parent doesn't list
        there = t["nodes"].where("node_id = '4'").select("conversation_record_id", F.lit(True).alias("has4"))
        n = n.join(there, "conversation_record_id", "left")
        n = n.withColumn("parent_id", F.when(at_(3, "3"), "99").when(at_(4, "2") & F.col("has4"), "4").otherwise(F.col("parent_id")))
        n = n.withColumn("children_ids", F.when(at_(5, "0"), F.array_remove("children_ids", F.lit("2"))).otherwise(F.col("children_ids")))
        n = n.withColumn("position", F.when(at_(6, "1"), F.lit(50)).otherwise(F.col("position")))
        return {"conversations": c.drop("n"), "nodes": n.drop("n", "has4")}

    return _codes(dataset(spark, sf_dir, change).graph())


@query(f"""with {M}, s as (select * from (values ('missing_child_lists', (select count(*) from m where node = 0)), ('attachment_gaps', (select count(*) from m where node % 3 = 0) + (select count(*) from m where node % 4 = 1)),
        ('repeated_message_ids', (select count(*) from (select node from m group by 1 having count(*) > 1))), ('missing_creation_times', (select count(*) from m where node % 4 = 3) + (select count(*) from cs where conversation % 9 = 0))) as t(code, n))
    select code, null as record_id, n::varchar as detail from s where n > 0 union all select 'unknown_role', record_id, null from m where role not in ('user', 'assistant', 'system', 'tool')""")
def validation_warnings(spark, sf_dir):
    def change(t):
        return {"nodes": t["nodes"].withColumn("children_ids", F.when(F.col("node_id") != "0", F.col("children_ids")))}

    return dataset(spark, sf_dir, change).warnings()


@query(f"""with {M} select 'clean_hash_mismatch' as code, 'messages' as record_id, null as detail union all select 'file_count', 'messages', (count(*) - count(*) filter (where node = 1)) || '/' || count(*) from m having count(*) filter (where node = 1) > 0""")
def validation_files(spark, sf_dir):
    """Frozen prints and counts against tables of which one lost rows afterwards."""
    raw = written(raw_chatgpt(spark, sf_dir))
    own = Once(tables(raw))
    frozen = {k: {"records": own[k].count(), "print": validate.table_print(own[k])} for k in ("conversations", "messages")}
    return dataset(spark, sf_dir, lambda t: {"messages": t["messages"].where(at("node") != 1)}, raw, own, frozen=frozen).integrity()


@query(f"""with {M}, r as (select 'validation_exception' as code, 'chatgpt:driver|/' || conversation as record_id, case conversation % 3 when 0 then 'missing_id' else 'mapping_missing' end as detail from cs where conversation % 3 <> 2) select * from r""")
def validation_refused(spark, sf_dir):
    """Conversations without an id, or whose mapping is a list, are named and not guessed at."""
    raw = raw_chatgpt(spark, sf_dir)
    broken = F.when(F.col("index") % 3 == 0, F.regexp_replace("conversation", '^\\{"id":"c[0-9]*"', '{"id":""')).when(F.col("index") % 3 == 1, F.lit('{"id":"x","mapping":[]}')).otherwise(F.col("conversation"))
    raw = written(raw.withColumn("conversation", broken))
    return validate.Dataset(tables(raw), raw, sources(spark), census(raw)).refused()


@query(f"""with {M}, {A}, s as (
        select 'role' as statistic, role as value, count(*) as n from m group by role union all select 'chatgpt_content', case when node % 4 = 1 then 'multimodal_text' else 'text' end, count(*) from m group by 2
        union all select 'segment', 'text', count(*) from m union all select 'attachment', 'unverified_reference', count(*) from a
        union all select 'missing_created_at_raw_conversations', 'all', count(*) from cs where conversation % 9 = 0 union all select 'missing_updated_at_raw_conversations', 'all', count(*) from cs
        union all select 'missing_created_at_raw_messages', 'all', count(*) from m where node % 4 = 3 union all select 'missing_updated_at_raw_messages', 'all', count(*) from m
        union all select 'text_differs_from_blocks', 'all', 0 union all select 'messages_without_text', 'all', count(*) from m where text = '' union all select 'empty_conversations', 'all', 0
        union all select 'branch_points', 'all', count(*) from (select conversation, parent from m where parent is not null group by 1, 2 having count(*) > 1)
        union all select 'graph_nodes', 'all', count(*) from m union all select 'nodes_without_child_lists', 'all', 0
        union all select 'repeated_message_ids', 'all', count(*) from (select node from m group by 1 having count(*) > 1)
        union all select unnest(['source_payloads', 'source_locations', 'duplicate_locations']), 'all', unnest([1, 1, 0]))
    select statistic, value, n::bigint as n from s""")
def import_statistics(spark, sf_dir):
    raw = written(raw_chatgpt(spark, sf_dir))
    return validate.statistics(Once(tables(raw)), written(census(raw)), sources(spark))


@query(f"""with {M} select record_id, 'chatgpt' as provider, '1.0' as schema_version, '0.1.1' as importer_version, 'chatgpt:driver' as source_id, pointer as json_pointer, case when node % 4 = 1 then 'multimodal_text' else 'text' end as content_kind,
    case when node % 4 <> 3 then (1700000000 + node)::varchar end as created_at_raw, 'm' || node as original_id, parent::varchar as parent_id, position::int as position from m""")
def message_records(spark, sf_dir):
    m = tables(raw_chatgpt(spark, sf_dir))["messages"]
    return m.select("record_id", "provider", "schema_version", "importer_version", F.col("provenance.source_id").alias("source_id"), F.col("provenance.json_pointer").alias("json_pointer"), "content_kind", "created_at_raw", "original_id", "parent_id", "position")


@query(f"""with {M} select c_id as record_id, 'c' || conversation as original_id, 'T' || conversation as title, case when conversation % 9 <> 0 then (1700000000 + conversation)::varchar end as created_at_raw, last::varchar as current_node_id,
    n::bigint as message_count, 'p' || (conversation % 3) as project from cs""")
def conversation_records(spark, sf_dir):
    c = tables(raw_chatgpt(spark, sf_dir))["conversations"]
    return c.select("record_id", "original_id", "title", "created_at_raw", "current_node_id", "message_count", F.get_json_object("raw_metadata", "$.conversation_template_id").alias("project"))


@query(f"""with {M}, k as (select conversation, parent as node, string_agg(node::varchar, ',' order by position) as kids from m where parent is not null group by 1, 2)
    select record_id as message_record_id, m.node::varchar as node_id, m.parent::varchar as parent_id, coalesce(kids, '') as children, position::int as position, '{{"id":"' || m.node || '"' || case when m.parent is null then '' else ',"parent":"' || m.parent || '"' end || ',"children":[' || coalesce('"' || replace(kids, ',', '","') || '"', '') || ']}}' as node_fields
    from m left join k on k.conversation = m.conversation and k.node = m.node""")
def node_records(spark, sf_dir):
    n = tables(raw_chatgpt(spark, sf_dir))["nodes"]
    return n.select("message_record_id", "node_id", "parent_id", F.array_join("children_ids", ",").alias("children"), "position", "node_fields")


@query("""select p as provider, count(*)::bigint as messages, count(distinct conv_id)::bigint as conversations, (case p when 'chatgpt' then count(*) else 2 * count(*) + count(*) filter (where turn % 3 = 0) end)::bigint as segments,
    (case p when 'chatgpt' then count(*) filter (where turn % 3 = 0) + count(*) filter (where turn % 4 = 1) else count(*) filter (where turn % 3 = 0) end)::bigint as attachments from conversations, (select unnest(['chatgpt', 'claude']) as p) group by 1""")
def provider_counts(spark, sf_dir):
    """Both providers' exports in one import."""
    t = tables(raw_chatgpt(spark, sf_dir).unionByName(raw_claude(spark, sf_dir)))
    count = lambda df, name: df.groupBy("provider").agg(F.count("*").alias(name))
    segments = t["segments"].join(t["messages"].select(F.col("record_id").alias("message_record_id"), "provider"), "message_record_id")
    return count(t["messages"], "messages").join(count(t["conversations"], "conversations"), "provider").join(count(segments, "segments"), "provider").join(count(t["attachments"], "attachments"), "provider")
