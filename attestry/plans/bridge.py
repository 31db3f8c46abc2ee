"""The driver's tables seen as the engine's model: conversations as an export with branching trees, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.identity import record_id, sha256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SOURCE = "chatgpt:driver"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation, node, parent, position, role, text, pointer, record_id. The tree has two interleaved chains: the
    parent of turn 1 is 0, that of a later turn t is t - 2."""
    t = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") == 0, F.lit(None)).when(F.col("turn") == 1, F.lit(0)).otherwise(F.col("turn") - 2)
    pointer = F.concat(F.lit("/"), F.col("conv_id").cast("string"), F.lit("/mapping/"), F.col("turn").cast("string"), F.lit("/message"))
    return t.select(
        F.col("conv_id").alias("conversation"), F.col("turn").alias("node"), parent.cast("long").alias("parent"), F.col("turn").alias("position"), "role", "text", pointer.alias("pointer")
    ).withColumn("record_id", record_id("message", F.lit(SOURCE), F.col("pointer")))


def export_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two exports: the later one has some texts changed, some last turns gone and some turns new."""
    m = messages(spark, sf_dir).select("conversation", "node", "parent", "text")
    last = m.groupBy("conversation").agg(F.max("node").alias("last"))
    before = m.select("conversation", "node", "parent", sha256(F.col("text")).alias("message_sha"), F.coalesce(F.col("parent").cast("string"), F.lit("-")).alias("context_sha"))
    changed = F.when((F.col("conversation") * 31 + F.col("node")) % 17 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))
    stay = m.join(last, "conversation").where("not (conversation % 10 = 0 and node = last)").select("conversation", "node", "parent", changed.alias("text"))
    more = last.where("conversation % 7 = 0").select("conversation", (F.col("last") + 1).alias("node"), F.col("last").alias("parent"), F.lit("a new turn").alias("text"))
    after = stay.unionByName(more).select("conversation", "node", "parent", sha256(F.col("text")).alias("message_sha"), F.coalesce(F.col("parent").cast("string"), F.lit("-")).alias("context_sha"))
    return before, after


CLAUDE = "claude:driver"
CLAUDE_ROOT = "00000000-0000-4000-8000-000000000000"


def _array_of(rows: DataFrame, entry, name: str) -> DataFrame:
    """Rows (conversation, name): each conversation's entries in order of position."""
    # entries may hold variants, which have no order of their own
    listed = F.array_sort(F.collect_list(F.struct("position", entry.alias("e"))), lambda a, b: (a["position"] - b["position"]).cast("int"))
    return rows.groupBy("conversation").agg(F.transform(listed, lambda x: x["e"]).alias(name))


def _raw(rows: DataFrame, provider: str, source: str, value) -> DataFrame:
    return rows.select(
        F.lit(source).alias("source_id"), F.lit(provider).alias("provider"), F.lit("driver").alias("sha256"), F.col("conversation").alias("index"), F.to_json(value).alias("conversation"), F.lit(None).cast("string").alias("error")
    )


def raw_chatgpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge's conversations as rows of sources.exports.conversations(), one JSON text each. Every third node's
    message lists an attachment, every fourth (from 1) has an image beside its text, every fourth (from 3) no time."""
    m = messages(spark, sf_dir)
    parent = F.col("parent").cast("string")
    kids = m.where("parent is not null").groupBy("conversation", F.col("parent").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("node").cast("string").alias("n")))), lambda x: x["n"]).alias("children"))
    full = m.join(kids, ["conversation", "node"], "left")
    text = F.to_json(F.array(F.col("text")))
    image = F.lit(',{"content_type":"image_asset_pointer","name":"p.png"}]')
    parts = F.parse_json(F.when(F.col("node") % 4 == 1, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), image)).otherwise(text))
    listed = F.when(F.col("node") % 3 == 0, F.array(F.struct(F.concat(F.lit("f"), F.col("node")).alias("id"), F.concat(F.lit("n"), F.col("node"), F.lit(".txt")).alias("name"))))
    message = F.struct(
        F.concat(F.lit("m"), F.col("node")).alias("id"), F.struct("role").alias("author"), F.when(F.col("node") % 4 != 3, F.lit(1_700_000_000) + F.col("node")).alias("create_time"),
        F.struct(F.when(F.col("node") % 4 == 1, "multimodal_text").otherwise("text").alias("content_type"), parts.alias("parts")).alias("content"), F.struct(listed.alias("attachments")).alias("metadata"),
    )
    node = F.struct(F.col("node").cast("string").alias("id"), parent.alias("parent"), F.coalesce("children", F.array().cast("array<string>")).alias("children"), message.alias("message"))
    rows = _array_of(full, F.struct(F.col("node").cast("string").alias("k"), node.alias("v")), "entries").join(m.groupBy("conversation").agg(F.max("node").alias("last")), "conversation")
    number = F.col("conversation").cast("string")
    value = F.struct(
        F.concat(F.lit("c"), number).alias("id"), F.concat(F.lit("T"), number).alias("title"), F.when(F.col("conversation") % 9 != 0, F.lit(1_700_000_000) + F.col("conversation")).alias("create_time"),
        F.concat(F.lit("p"), F.col("conversation") % 3).alias("conversation_template_id"), F.col("last").cast("string").alias("current_node"), F.map_from_entries("entries").alias("mapping"),
    )
    return _raw(rows, "chatgpt", SOURCE, value)


def raw_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conversations in the other provider's form: ISO times, blocks, every third message with an attachment's
    text, every fourth (from 1) with a block of thinking."""
    m = messages(spark, sf_dir).withColumn("id", F.concat(F.lit("u"), F.col("node")))
    parent = F.coalesce(F.concat(F.lit("u"), F.col("parent")), F.lit(CLAUDE_ROOT))
    sender = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("thinking"))
    thought = F.struct(F.lit("thinking").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("hm").alias("thinking"))
    attached = F.when(F.col("node") % 3 == 0, F.array(F.struct(F.concat(F.lit("n"), F.col("node"), F.lit(".txt")).alias("file_name"), F.concat(F.lit("inside "), F.col("node")).alias("extracted_content"))))
    message = F.struct(
        F.col("id").alias("uuid"), parent.alias("parent_message_uuid"), sender.alias("sender"), F.col("text").alias("text"), F.when(F.col("node") % 4 == 1, F.array(block, thought)).otherwise(F.array(block)).alias("content"),
        F.lit("2024-01-02T03:04:05Z").alias("created_at"), attached.alias("attachments"),
    )
    number = F.col("conversation").cast("string")
    value = F.struct(F.concat(F.lit("k"), number).alias("uuid"), F.concat(F.lit("T"), number).alias("name"), F.lit("2024-01-02T03:04:05Z").alias("created_at"), F.col("list").alias("chat_messages"))
    return _raw(_array_of(m, message, "list"), "claude", CLAUDE, value)
