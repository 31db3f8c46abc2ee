"""Provider exports as conversation, node, message, segment, attachment and warning tables.

Everything is a projection of JSON text in the JVM: objects as string maps that keep key order, arrays exploded with
their positions as variants, so that a value's type can be told. Unknown content stays in ``raw`` and gives a warning.
The tables share what the export's text is parsed into; who reads several of them says how it is kept (``rounds.written``),
so that it is parsed once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.identity import envelope, pointer_token, record_id

MAP = "map<string,string>"
#: A map whose values keep their JSON types, for objects that are written out again.
TYPED = "map<string,variant>"
CHATGPT_KINDS = ("text", "multimodal_text", "thoughts", "reasoning_recap")
CHATGPT_MEDIA = ("image_asset_pointer", "audio_asset_pointer", "real_time_user_audio_video_asset_pointer")
CLAUDE_KINDS = ("text", "thinking", "tool_use", "tool_result", "token_budget", "flag")
CLAUDE_ROOT = "00000000-0000-4000-8000-000000000000"


Keep = Callable[[DataFrame], DataFrame]


def anew(rows: DataFrame) -> DataFrame:
    """Keeps nothing: every table parses the export for itself."""
    return rows


@dataclass
class Tables:
    conversations: DataFrame
    nodes: DataFrame
    messages: DataFrame
    segments: DataFrame
    attachments: DataFrame
    warnings: DataFrame
    refused: DataFrame

    def union(self, other: Tables) -> Tables:
        return Tables(*[getattr(self, f).unionByName(getattr(other, f), allowMissingColumns=True) for f in self.__dataclass_fields__])


def role_of(provider: str, raw: Column) -> Column:
    """The role that a provider's spelling stands for; unknown for any other."""
    if provider == "chatgpt":
        return F.when(raw.isin("user", "assistant", "system", "tool"), raw).otherwise("unknown")
    return F.when(raw == "human", "user").when(raw == "assistant", "assistant").otherwise("unknown")


def _object(text: Column) -> Column:
    return F.from_json(text, MAP)


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def _items(df: DataFrame, array: Column, keep: list[str]) -> DataFrame:
    """One row per element of a JSON array text: keep, pos, value (a variant) and element (its JSON text)."""
    spark = df.sparkSession
    own = df.select(*keep, F.try_parse_json(array).alias("_array")).where(F.col("_array").isNotNull() & F.schema_of_variant("_array").startswith("ARRAY"))
    rows = own.lateralJoin(spark.tvf.variant_explode(F.col("_array").outer()))
    return rows.select(*keep, F.col("pos").cast("int").alias("pos"), "value").withColumn("element", F.to_json("value"))


def _text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def _first_present(obj: Column, *keys: str) -> Column:
    """The value of the first key that the object has, null values included."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(obj, k), obj[k]).otherwise(out)
    return out


ENVELOPE = ["schema_version", "importer_version", "record_id", "provider", "provenance"]
SOURCE = ["source_id", "provider", "sha256"]


def _wrap(df: DataFrame, kind: str, pointer: Column) -> DataFrame:
    return df.withColumns(envelope(kind, F.col("source_id"), F.col("provider"), F.col("sha256"), pointer))


def _attachments(rows: DataFrame, kind: Column) -> DataFrame:
    """rows: SOURCE, conversation_record_id, message_record_id, pointer, element."""
    obj = F.coalesce(_object(F.col("element")), F.create_map().cast(MAP))
    wrapped = _wrap(rows.withColumn("attachment_kind", kind).withColumn("_o", obj), "attachment", F.col("pointer"))
    return wrapped.select(
        *ENVELOPE, "conversation_record_id", "message_record_id", "attachment_kind", F.col("element").alias("raw"),
        _first_present(F.col("_o"), "file_name", "name").alias("filename"),
        _first_present(F.col("_o"), "file_id", "file_uuid", "id").alias("original_id"),
        F.lit("unverified_reference").alias("availability"),
    )


def _warn(rows: DataFrame, code: str, detail: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.col("message_record_id").alias("record_id"), F.lit(detail).alias("detail"))


def _segments(rows: DataFrame) -> DataFrame:
    """rows: message_record_id, rank (order of origin), pos, pointer, text, kind."""
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("message_record_id").orderBy("rank", "pos")) - 1
    return rows.select("message_record_id", index.alias("segment_index"), F.col("pointer").alias("json_pointer"), "text", "kind")


def _conversations(raw: DataFrame, ids: list[str], items: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Accepted conversations with their common columns, and refused ones with a reason."""
    parsed = raw.where("conversation is not null").withColumn("_c", _object(F.col("conversation"))).withColumn("_v", F.try_parse_json(F.concat(F.lit("["), F.col("conversation"), F.lit("]"))))
    original = F.coalesce(*[F.nullif(F.try_variant_get("_v", f"$[0].{i}", "string"), F.lit("")) for i in ids])
    shape = F.schema_of_variant(F.coalesce(F.try_variant_get("_v", f"$[0].{items}", "variant"), F.parse_json(F.lit("null"))))
    wanted = "OBJECT" if items == "mapping" else "ARRAY"
    error = F.when(F.col("_c").isNull(), "not_an_object").when(original.isNull(), "missing_id").when(~shape.startswith(wanted), f"{items}_missing")
    parsed = parsed.withColumn("original_id", original).withColumn("_error", error)
    pointer = F.concat(F.lit("/"), F.col("index").cast("string"))
    good = _wrap(parsed.where("_error is null"), "conversation", pointer).withColumn("pointer", pointer)
    good = good.withColumns({name: F.col("_c")[key] for name, key in fields.items()}).withColumn("raw_metadata", F.to_json(F.map_filter(F.from_json("conversation", TYPED), lambda k, _: k != items)))
    refused = raw.where("error is not null").select("source_id", "index", "error").unionByName(parsed.where("_error is not null").select("source_id", "index", F.col("_error").alias("error")))
    return good, refused


def chatgpt(raw: DataFrame, keep: Keep = anew) -> Tables:
    """``raw``: rows of sources.exports.conversations() of the provider chatgpt. ``keep`` gets the parsed conversations and
    the parsed nodes, which all tables but the refused are made of."""
    convs, refused = _conversations(raw, ["id", "conversation_id"], "mapping", {"title": "title", "created_at_raw": "create_time", "updated_at_raw": "update_time", "current_node_id": "current_node"})
    told = [*dict.fromkeys([*SOURCE, *ENVELOPE]), "original_id", "pointer", "title", "created_at_raw", "updated_at_raw", "current_node_id", "raw_metadata"]
    convs = keep(convs.select(*told, F.col("_c")["mapping"].alias("_mapping")))
    base = convs.select(*SOURCE, F.col("record_id").alias("conversation_record_id"), F.col("original_id").alias("conversation_original_id"), "pointer", F.posexplode(F.map_entries(_object(F.col("_mapping")))).alias("position", "_n"))
    fields = F.to_json(F.map_filter(F.from_json(F.col("_n.value"), TYPED), lambda k, _: k != "message"))
    node = base.withColumn("node_id", F.col("_n.key")).withColumn("_o", _object(F.col("_n.value"))).withColumn("_fields", fields).drop("_n")
    node = node.withColumn("raw", F.col("_o")["message"]).withColumn("pointer", F.concat("pointer", F.lit("/mapping/"), pointer_token(F.col("node_id")), F.lit("/message")))
    node = node.withColumn("message_record_id", F.when(F.col("raw").isNotNull(), record_id("message", F.col("source_id"), F.col("pointer"))))
    node = node.withColumn("_m", _object(F.col("raw"))).withColumn("_content", _object(F.col("_m")["content"]))
    node = keep(node.select(
        *SOURCE, "conversation_record_id", "conversation_original_id", "pointer", "position", "node_id", F.col("_o")["parent"].alias("parent_id"), F.from_json(F.col("_o")["children"], "array<string>").alias("children_ids"),
        F.col("_fields").alias("node_fields"), "message_record_id", "raw", F.col("_m")["id"].alias("original_id"), _object(F.col("_m")["author"])["role"].alias("role_raw"), F.col("_m")["create_time"].alias("created_at_raw"),
        F.col("_m")["update_time"].alias("updated_at_raw"), F.col("_content")["content_type"].alias("content_kind"), F.col("_content")["parts"].alias("_parts"), _object(F.col("_m")["metadata"])["attachments"].alias("_listed"),
    ))
    nodes = node.select("conversation_record_id", "node_id", "parent_id", "children_ids", "message_record_id", "position", "node_fields")
    m = node.where("raw is not null")
    messages = _wrap(m, "message", F.col("pointer")).select(
        *ENVELOPE, "conversation_record_id", "conversation_original_id", "original_id", "node_id", "parent_id", "position",
        role_of("chatgpt", F.col("role_raw")).alias("role"), "role_raw", "created_at_raw", "updated_at_raw", "content_kind", "raw",
    )
    keys = [*SOURCE, "conversation_record_id", "message_record_id", "pointer"]
    parts = _items(m.where(F.col("content_kind").isin("text", "multimodal_text")), F.col("_parts"), keys).withColumn("pointer", F.concat("pointer", F.lit("/content/parts/"), F.col("pos").cast("string")))
    parts = parts.withColumn("part_kind", F.when(_is(F.col("value"), "OBJECT"), _text(F.col("value"), "$.content_type")))
    spoken = F.coalesce((F.col("part_kind") == "audio_transcription") & F.try_variant_get("value", "$.text", "string").isNotNull(), F.lit(False))
    plain, others = parts.where(_is(F.col("value"), "STRING")), parts.where(_is(F.col("value"), "OBJECT"))
    segments = plain.select("message_record_id", F.lit(0).alias("rank"), "pos", "pointer", _text(F.col("value")).alias("text"), F.lit("text").alias("kind")).unionByName(
        others.where(spoken).select("message_record_id", F.lit(0).alias("rank"), "pos", F.concat("pointer", F.lit("/text")).alias("pointer"), _text(F.col("value"), "$.text").alias("text"), F.lit("transcription_text").alias("kind"))
    )
    media = others.where(~spoken)
    listed = _items(m, F.col("_listed"), keys).withColumn("pointer", F.concat("pointer", F.lit("/metadata/attachments/"), F.col("pos").cast("string")))
    attachments = _attachments(media, F.lit("multimodal_reference")).unionByName(_attachments(listed, F.lit("attachment")))
    known = F.coalesce(F.col("content_kind").isin(*CHATGPT_KINDS), F.lit(False))
    warnings = (
        _warn(m.where(~known), "unknown_content", "content kept in raw")
        .unionByName(_warn(media.where(~F.coalesce(F.col("part_kind").isin(*CHATGPT_MEDIA), F.lit(False))), "unknown_multimodal_content", "block kept in raw and as a reference"))
        .unionByName(_warn(parts.where(~_is(F.col("value"), "STRING") & ~_is(F.col("value"), "OBJECT")), "unknown_part", "part kept in raw"))
    )
    counts = messages.groupBy(F.col("conversation_record_id").alias("record_id")).agg(F.count("*").alias("message_count"))
    conversations = convs.join(counts, "record_id", "left").select(*ENVELOPE, "original_id", "title", "created_at_raw", "updated_at_raw", "current_node_id", F.array().cast("array<string>").alias("root_parent_ids"), "raw_metadata", F.coalesce("message_count", F.lit(0)).alias("message_count"))
    return Tables(conversations, nodes, messages, _segments(segments), attachments, warnings, refused)


def claude(raw: DataFrame, keep: Keep = anew) -> Tables:
    """``raw``: rows of sources.exports.conversations() of the provider claude. ``keep`` gets the parsed messages;
    the conversations' own columns are parsed apart."""
    convs, refused = _conversations(raw, ["uuid"], "chat_messages", {"title": "name", "created_at_raw": "created_at", "updated_at_raw": "updated_at"})
    base = convs.select(*SOURCE, F.col("record_id").alias("conversation_record_id"), F.col("original_id").alias("conversation_original_id"), "pointer", F.col("_c")["chat_messages"].alias("_list"))
    m = _items(base, F.col("_list"), [*SOURCE, "conversation_record_id", "conversation_original_id", "pointer"])
    # the element's own text keeps what the export wrote; a variant's order of keys is its own
    m = m.withColumn("pointer", F.concat("pointer", F.lit("/chat_messages/"), F.col("pos").cast("string"))).withColumn("_m", _object(F.col("element")))
    m = keep(m.withColumn("message_record_id", record_id("message", F.col("source_id"), F.col("pointer"))).withColumnRenamed("pos", "position"))
    role = role_of("claude", F.col("_m")["sender"])
    messages = _wrap(m, "message", F.col("pointer")).select(
        *ENVELOPE, "conversation_record_id", "conversation_original_id", F.col("_m")["uuid"].alias("original_id"), F.col("_m")["uuid"].alias("node_id"), F.col("_m")["parent_message_uuid"].alias("parent_id"), "position",
        role.alias("role"), F.col("_m")["sender"].alias("role_raw"), F.col("_m")["created_at"].alias("created_at_raw"), F.col("_m")["updated_at"].alias("updated_at_raw"), F.lit("blocks").alias("content_kind"), F.col("element").alias("raw"),
    )
    keys = [*SOURCE, "conversation_record_id", "message_record_id", "pointer"]
    own = m.where(F.try_variant_get("value", "$.text", "string").isNotNull()).select("message_record_id", F.lit(0).alias("rank"), F.lit(0).alias("pos"), F.concat("pointer", F.lit("/text")).alias("pointer"), _text(F.col("value"), "$.text").alias("text"), F.lit("text").alias("kind"))
    blocks = _items(m, F.col("_m")["content"], keys).withColumn("pointer", F.concat("pointer", F.lit("/content/"), F.col("pos").cast("string"))).withColumn("block", F.when(_is(F.col("value"), "OBJECT"), _text(F.col("value"), "$.type")))
    text = blocks.where("block = 'text'").where(_text(F.col("value"), "$.text").isNotNull()).select("message_record_id", F.lit(1).alias("rank"), "pos", F.concat("pointer", F.lit("/text")).alias("pointer"), _text(F.col("value"), "$.text").alias("text"), F.lit("text").alias("kind"))
    refs = None
    for rank, (field, kind) in enumerate((("attachments", "attachment"), ("files", "file_reference")), 2):
        some = _items(m, F.col("_m")[field], keys).withColumn("pointer", F.concat("pointer", F.lit(f"/{field}/"), F.col("pos").cast("string"))).withColumn("_kind", F.lit(kind)).withColumn("rank", F.lit(rank))
        refs = some if refs is None else refs.unionByName(some)
    extracted = refs.where(_is(F.col("value"), "OBJECT")).withColumn("text", _text(F.col("value"), "$.extracted_content")).where("text is not null")
    extracted = extracted.select("message_record_id", "rank", "pos", F.concat("pointer", F.lit("/extracted_content")).alias("pointer"), "text", F.lit("attachment_text").alias("kind"))
    attachments = _attachments(refs, F.col("_kind"))
    warnings = _warn(blocks.where(~F.coalesce(F.col("block").isin(*CLAUDE_KINDS), F.lit(False))), "unknown_content", "block kept in raw")
    nodes = messages.select("conversation_record_id", "node_id", "parent_id", F.col("record_id").alias("message_record_id"), "position", F.lit("{}").alias("node_fields"))
    kids = nodes.groupBy("conversation_record_id", F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("node_id").alias("c")))), lambda x: x["c"]).alias("children_ids"))
    nodes = nodes.join(kids, ["conversation_record_id", "node_id"], "left").withColumn("children_ids", F.coalesce("children_ids", F.array().cast("array<string>")))
    counts = messages.groupBy(F.col("conversation_record_id").alias("record_id")).agg(F.count("*").alias("message_count"), F.bool_or(F.coalesce(F.col("parent_id") == CLAUDE_ROOT, F.lit(False))).alias("rooted"))
    roots = F.when(F.col("rooted"), F.array(F.lit(CLAUDE_ROOT))).otherwise(F.array().cast("array<string>"))
    conversations = convs.join(counts, "record_id", "left").select(*ENVELOPE, "original_id", "title", "created_at_raw", "updated_at_raw", F.lit(None).cast("string").alias("current_node_id"), roots.alias("root_parent_ids"), "raw_metadata", F.coalesce("message_count", F.lit(0)).alias("message_count"))
    return Tables(conversations, nodes, messages, _segments(own.unionByName(text).unionByName(extracted)), attachments, warnings, refused)


#: Provider -> adapter (of the export and of how parsed rows are kept); an adapter for another provider can be added.
ADAPTERS = {"chatgpt": chatgpt, "claude": claude}


def normalize(raw: DataFrame, keep: Keep = anew) -> Tables:
    """All providers' tables in one."""
    tables = [adapter(raw.where(F.col("provider") == name), keep) for name, adapter in ADAPTERS.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def resolve_attachments(attachments: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """Adds availability, resolved_path and sha256: unverified_reference (no name, no root, or a multimodal reference),
    unsafe_reference, missing, local_filename_match or ambiguous_candidates. A match is a candidate, no proof.

    ``roots``: source_id, root; ``files``: root, name, path and sha256 (if known). Only an exact name below a root of the
    record's source counts. Every attachment gives one row; without roots or files none is found.
    """
    a = attachments.drop("availability", "resolved_path", "sha256").withColumn("_source", F.col("provenance.source_id"))
    unsafe = F.col("filename").rlike(r"(^|/)\.\.(/|$)|^/|\\")
    known = roots.select(F.col("source_id").alias("_source"), "root").distinct()
    there = files if "sha256" in files.columns else files.withColumn("sha256", F.lit(None).cast("string"))
    candidates = a.select("record_id", "_source", "filename").join(known, "_source").join(there.withColumnRenamed("name", "filename"), ["root", "filename"])
    matches = candidates.groupBy("record_id").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path"), F.min("sha256").alias("_hash"))
    with_root = known.select("_source").distinct().withColumn("_rooted", F.lit(True))
    joined = a.join(with_root, "_source", "left").join(matches, "record_id", "left")
    state = (
        F.when(F.coalesce(F.col("filename"), F.lit("")).eqNullSafe("") | (F.col("attachment_kind") == "multimodal_reference"), "unverified_reference")
        .when(unsafe, "unsafe_reference").when(F.col("_rooted").isNull(), "unverified_reference")
        .when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "local_filename_match").otherwise("ambiguous_candidates")
    )
    sure = joined.withColumn("availability", state)
    match = F.col("availability") == "local_filename_match"
    return sure.withColumn("resolved_path", F.when(match, F.col("path"))).withColumn("sha256", F.when(match, F.col("_hash"))).drop("_source", "_rooted", "n", "path", "_hash")
