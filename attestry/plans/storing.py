"""Queries of payloads, blobs and comparisons of stored exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.functions.identity import canonical_fingerprint, resolve_pointer, sha256
from attestry.operators import delta, graph, rounds, validate
from attestry.plans.bridge import SOURCE, messages, raw_chatgpt, table
from attestry.plans.registry import MESSAGES, query
from attestry.plans.validation import tables
from attestry.sources import exports, known, lookup, raw_store, sinks


def _payloads(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit("claude").alias("provider"), F.col("doc_id").cast("string").alias("path"), F.lit(None).cast("string").alias("member"), F.lit(None).cast("string").alias("attachment_root"), F.col("text").cast("binary").alias("content"))


@query("""select sha256(text) as payload_sha256, count(*)::bigint as locations, min(doc_id::varchar) as first_path, max(strlen(text))::int as bytes from documents group by 1""")
def payload_dedup(spark, sf_dir):
    return exports.payload_groups(_payloads(spark, sf_dir)).select(F.col("sha256").alias("payload_sha256"), "locations", "first_path", "bytes")


@query("""select 'claude:' || sha256(text) as source_id, strlen(any_value(text))::int as bytes, string_agg(doc_id::varchar, ',' order by doc_id::varchar) as paths from documents group by sha256(text)""")
def payload_inventory(spark, sf_dir):
    found = exports.inventory(_payloads(spark, sf_dir))
    return found.select("source_id", "bytes", F.array_join("locations.path", ",").alias("paths"))


@query("""select (sum(n) - count(*))::bigint as duplicate_locations, count(*)::bigint as payloads from (select count(*) as n from documents group by text)""")
def duplicate_locations(spark, sf_dir):
    return exports.duplicate_locations(exports.payload_groups(_payloads(spark, sf_dir)))


@query("""select 'chatgpt' as provider, 'm' || turn as original_id, count(*)::bigint as memberships from conversations group by turn having count(*) > 1""")
def repeated_messages(spark, sf_dir):
    """Original ids that stand in several conversations."""
    return validate.repeated_ids(tables(raw_chatgpt(spark, sf_dir))["messages"])


@query("""with c as (select source as name, count(*) as n from documents group by 1) select name, n || '/' || (n + 1) as detail from c where length(name) % 2 = 0 union all select 'nothing', '0/7'""")
def expected_counts(spark, sf_dir):
    """Counts by source against expected ones: one too many where the name's length is even, and a name that has none."""
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    expected = counts.select("name", (F.col("n") + F.when(F.length("name") % 2 == 0, 1).otherwise(0)).alias("expected"))
    expected = expected.unionByName(spark.createDataFrame([("nothing", 7)], "name string, expected long"))
    return validate.expected_counts(counts, expected).select(F.col("record_id").alias("name"), "detail")


def _exports(spark, sf_dir):
    """One payload per conversation: its JSON in an array."""
    raw = raw_chatgpt(spark, sf_dir)
    content = F.concat(F.lit("["), "conversation", F.lit("]")).cast("binary")
    return raw.select(F.col("index").alias("conversation"), sha256(content).alias("payload_sha256"), content.alias("content"))


@query(f"""with m as ({MESSAGES}), k as (select conversation, parent, count(*) as n from m where parent is not null group by 1, 2)
    select 'c' || m.conversation as conversation_id, m.node::varchar as node_id, 'm' || m.node as message_id, m.parent::varchar as parent_id, '/0/mapping/' || m.node || '/message' as message_pointer,
        sha256('{{"children":[' || coalesce((select string_agg('"' || c.node || '"', ',' order by c.position) from m c where c.conversation = m.conversation and c.parent = m.node), '') || '],"id":"' || m.node || '"' || case when m.parent is null then '' else ',"parent":"' || m.parent || '"' end || '}}') as context_sha256
    from m""")
def export_index(spark, sf_dir):
    """Nodes of the described payloads, their context's hash among them."""
    found = raw_store.occurrences(raw_store.descriptions(_exports(spark, sf_dir)))
    return found.select("conversation_id", F.explode("nodes").alias("n")).select("conversation_id", "n.node_id", "n.message_id", "n.parent_id", "n.message_pointer", "n.context_sha256")


@query(f"""with m as ({MESSAGES}) select conversation, (4 * count(*) + 3)::bigint as parts, true as intact from m group by 1""")
def stored_parts(spark, sf_dir):
    """Payloads cut into parts and put together again: four for each node (before it, up to its message, the message, after
    it) and three around them."""
    own = _exports(spark, sf_dir)
    parts = raw_store.segment(own)
    n = parts.groupBy("payload_sha256").agg(F.count("*").alias("parts"))
    whole = raw_store.restore(raw_store.recipe(parts), raw_store.new_blobs(parts))
    return own.join(n, "payload_sha256").join(whole.select("payload_sha256", "intact"), "payload_sha256").select("conversation", "parts", "intact")


@query("""with b as (select sha256(text) as s, strlen(text) as n, count(*) as k from documents group by 1, 2), t as (select *, s in (select sha256(text) from documents where doc_id % 2 = 0) as had from b)
    select sum(k)::bigint as occurrences, (count(*) filter (where not had))::bigint as new_blobs, coalesce(sum(n) filter (where not had), 0)::bigint as new_bytes, (count(*) filter (where had))::bigint as reused_blobs, coalesce(sum(n) filter (where had), 0)::bigint as reused_bytes from t""")
def ingest_report(spark, sf_dir):
    """Texts as parts, into a store that has those of even numbers."""
    d = table(spark, sf_dir, "documents")
    parts = d.select("doc_id", sha256(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    return raw_store.ingest_report(parts, parts.where("doc_id % 2 = 0").select("sha256"))


@query("""select doc_id, sha256(text) in (select sha256(text) from documents where doc_id % 2 = 0) as had from documents""")
def known_blobs(spark, sf_dir):
    """Whether a store that holds the texts of even numbers has a document's text, by its filters and prefix folders."""
    texts = table(spark, sf_dir, "documents").select("doc_id", sha256(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.col("text").cast("binary").alias("content"))
    store = f"{rounds.new_place(spark)}/blobs"
    sinks.append_blobs(texts.where("doc_id % 2 = 0").select("sha256", "bytes", "content"), store)
    had = known.had(texts.select("sha256"), store).withColumn("had", F.lit(True))
    return texts.select("doc_id", "sha256").join(had, "sha256", "left").select("doc_id", F.coalesce("had", F.lit(False)).alias("had"))


@query("""select count(*)::bigint as blobs, sum(n)::bigint as bytes from (select distinct sha256(text), strlen(text) as n from documents)""")
def referenced_blobs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return raw_store.referenced(d.select(sha256(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("bytes")))


@query("""select source as payload_sha256, doc_id as ordinal, coalesce(sum(strlen(text)) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from documents""")
def store_recipe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = d.select(F.col("source").alias("payload_sha256"), F.col("doc_id").alias("ordinal"), sha256(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    return raw_store.recipe(parts).select("payload_sha256", "ordinal", "start")


def _sides(spark, sf_dir):
    """Two exports described: the later one has some texts changed, some titles, and lacks some conversations; every
    eleventh conversation stands in it twice."""
    before = _exports(spark, sf_dir)
    text = F.decode("content", "utf-8")
    changed = F.when(F.col("conversation") % 4 == 1, F.replace(text, F.lit('"id":"m0","author"'), F.lit('"id":"m0","edited":true,"author"'))).when(F.col("conversation") % 4 == 2, F.regexp_replace(text, '"title":"T', '"title":"t')).otherwise(text)
    after = before.where("conversation % 10 <> 0").withColumn("content", changed.cast("binary"))
    twice = after.where("conversation % 11 = 0").withColumn("content", F.concat(F.decode("content", "utf-8"), F.lit("\n")).cast("binary"))
    after = after.unionByName(twice).withColumn("payload_sha256", sha256(F.col("content")))
    return [raw_store.occurrences(raw_store.descriptions(x)) for x in (before, after)]


@query(f"""with m as ({MESSAGES}), c as (select conversation, conversation % 10 = 0 as gone, conversation % 11 = 0 and conversation % 10 <> 0 as twice, conversation % 4 as k, count(*) as n from m group by 1),
    x as (select case when twice then 'ambiguous_conversations' when gone then 'not_present_conversations' when k = 2 then 'conversation_metadata_changed' end as kind, 1 as n from c
        union all select 'not_present_messages', n from c where gone union all select 'changed_messages', 1 from c where not gone and not twice and k = 1 union all select 'context_changed_messages', n - 1 from c where not gone and not twice and k = 1
        union all select 'unchanged_messages', n from c where not gone and not twice and k <> 1)
    select kinds.kind, coalesce(sum(x.n), 0)::bigint as n from (select unnest(['{"','".join(delta.KINDS)}']) as kind) kinds left join x using (kind) group by 1""")
def stored_delta_counts(spark, sf_dir):
    return delta.compare(*_sides(spark, sf_dir), "driver").counts


@query(f"""with m as ({MESSAGES}), c as (select conversation, conversation % 10 = 0 as gone, conversation % 11 = 0 and conversation % 10 <> 0 as twice, conversation % 4 as k from m group by 1)
    select kind, 'c' || conversation as conversation_id, node::varchar as node_id, case when node is not null then sha256('["chatgpt","driver","c' || conversation || '","' || node || '"]') end as logical_key from (
        select 'conversation_not_present' as kind, conversation, null as node from c where gone union all select 'conversation_metadata_changed', conversation, null from c where not gone and not twice and k = 2
        union all select 'not_present_messages', conversation, node from m join c using (conversation) where gone
        union all select case when node = 0 then 'changed_messages' else 'context_changed_messages' end, conversation, node from m join c using (conversation) where not gone and not twice and k = 1)""")
def stored_delta(spark, sf_dir):
    return delta.compare(*_sides(spark, sf_dir), "driver").changes.select("kind", "conversation_id", "node_id", "logical_key")


@query(f"""with m as ({MESSAGES}), k as (select conversation, parent as node, string_agg(node::varchar, ',' order by position) as listed from m where parent is not null group by 1, 2 having count(*) > 1)
    select conversation, node, 'root' as kind, null as listed from m where parent is null union all select conversation, node, 'branch_point', listed from k""")
def branch_structure(spark, sf_dir):
    return graph.branch_structure(messages(spark, sf_dir))


@query("""select doc_id, sha256('{"a":' || doc_id || ',"b":["' || lang || '",null],"c":{"x":true,"y":"' || source || '"}}') as free, '"' || lang || '"' as found from documents""")
def canonical_json(spark, sf_dir):
    """Free JSON with its keys in another order, hashed in canonical form; and what a pointer names in it."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit('{ "c": {"y":"'), "source", F.lit('", "x":true},\n "b":["'), "lang", F.lit('",null], "a":'), F.col("doc_id").cast("string"), F.lit("}"))
    return d.select("doc_id", canonical_fingerprint()(text).alias("free"), resolve_pointer(text, F.lit("/b/0")).alias("found"))


@query("""with d as (select doc_id, lang, coalesce(text, '') as text from documents), o as (select *, ((length(text) - length(replace(text, 'the', ''))) / 3)::int as n from d)
    select doc_id, n as occurrences, case when n = 1 then sha256(replace(text, 'the', 'THE')) end as replaced, repeat('`', greatest(3, doc_id % 6 + 1)::int) as fence, lang as period, len(list_distinct(regexp_extract_all(lower(text), '\\p{L}{3,}')))::int as long_words from o""")
def text_functions(spark, sf_dir):
    """Counts, single replacement, fences, labelled lines and long words."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    ticks = F.concat(F.lit("x"), F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), F.lit("y`"))
    label = F.concat(F.lit("Head\n**Event period:** "), "lang", F.lit("\nBody"))
    return d.select(
        "doc_id", T.occurrences(F.col("text"), F.lit("the")).alias("occurrences"), sha256(T.replace_once(F.col("text"), F.lit("the"), F.lit("THE"))).alias("replaced"), T.fence(ticks).alias("fence"),
        T.labelled_line(label, "Event period").alias("period"), F.size(T.long_words(F.col("text"))).alias("long_words"),
    )


#: The bridge's messages with their lines in SQL.
LINES = f"""m as ({MESSAGES}), l as (select *, row_number() over (order by conversation, position, pointer)::bigint as line from m)"""


def _records(spark, sf_dir):
    """The bridge's messages as a published table of records with its lines."""
    m = messages(spark, sf_dir)
    provenance = F.struct(F.lit(SOURCE).alias("source_id"), F.lit("driver").alias("sha256"), F.col("pointer").alias("json_pointer"))
    place = f"{rounds.new_place(spark)}/dataset"
    sinks.publish_tables({"messages": m.select("record_id", provenance.alias("provenance"), "conversation", "node", "position", sha256(F.col("text")).alias("text_sha256"))}, place)
    return f"{place}/messages"


@query(f"with {LINES} select line, record_id from l")
def record_lines(spark, sf_dir):
    """Records numbered in the export's order."""
    return spark.read.parquet(f"{_records(spark, sf_dir)}.lines")


@query(f"""with {LINES}, n as (select count(*) as n from l), w as (select 1 as line union all select n // 2 from n union all select n from n)
    select l.line, record_id, conversation, node, sha256(text) as text_sha256 from l join (select distinct line from w where line > 0) w using (line)""")
def record_lookup(spark, sf_dir):
    """The records of the first, the middle and the last line, each looked up by its number and again by its id; there are
    none in an empty table."""
    place = _records(spark, sf_dir)
    n = spark.read.parquet(place).count()
    found = spark.read.parquet(place).limit(0).withColumn("line", F.lit(0).cast("long"))
    for line in sorted({1, n // 2, n} & set(range(1, n + 1))):
        first = lookup.record(spark, place, line=line).first()
        found = found.unionByName(lookup.record(spark, place, first["record_id"]).withColumn("line", F.lit(line).cast("long")))
    return found.select("line", "record_id", "conversation", "node", "text_sha256")
