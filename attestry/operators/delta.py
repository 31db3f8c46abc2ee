"""What changed between two exports, by explicit ids; nothing is guessed and nothing absent counts as deleted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attestry.functions.identity import sha256
from attestry.operators.rounds import doubled, longest, written

KINDS = (
    "new_messages changed_messages unchanged_messages not_present_messages context_changed_messages "
    "new_conversations not_present_conversations conversation_metadata_changed ambiguous_conversations"
).split()


def usable(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with an id that occurs once, and the ambiguous ones: (conversation, issue)."""
    counted = conversations.groupBy("conversation").agg(F.count("*").alias("n"))
    unknown = conversations.where("conversation is null").select("conversation", F.lit("missing_conversation_id").alias("issue"))
    repeated = counted.where("conversation is not null and n > 1").select("conversation", F.lit("duplicate_conversation_id").alias("issue"))
    return conversations.join(counted.where("conversation is not null and n = 1").select("conversation"), "conversation", "left_semi"), unknown.unionByName(repeated)


def below(start: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (conversation, node) that links (conversation, parent, node) lead to from ``start``, the start itself only
    where a link leads back to it.

    Each node follows one of its parents up to a start, by doubling. A node with another parent that leads to a start is a
    start of the next pass; where nodes have one parent each there is one pass, whatever the depth.
    """
    own = links.where("parent is not null and node is not null").select(F.struct("conversation", F.col("parent").alias("node")).alias("up"), F.struct("conversation", "node").alias("at")).distinct()
    own = written(own)
    first = written(own.groupBy("at").agg(F.min("up").alias("next")))
    more = own.join(first, "at").where(F.col("up") != F.col("next")).select("at", "up")
    several = not more.isEmpty()
    rounds = longest(first.select("at.conversation"), "conversation")
    marked = written(start.select(F.struct("conversation", "node").alias("at")).distinct())
    while True:
        state = first.join(marked.withColumn("hit", F.lit(True)), "at", "left").select("at", "next", F.coalesce("hit", F.lit(False)).alias("hit"))
        # starts that no link leads to end the chains of others
        roots = marked.join(first, "at", "left_anti").select("at", F.lit(None).cast(first.schema["next"].dataType).alias("next"), F.lit(True).alias("hit"))
        ended = doubled(state.unionByName(roots), rounds, {"hit": F.col("hit") | F.coalesce("far_hit", F.lit(False))}, F.col("hit"))
        reached = ended.where("hit").select("at")
        if not several:
            break
        new = more.join(reached.withColumnRenamed("at", "up"), "up", "left_semi").select("at").join(reached, "at", "left_anti").distinct()
        if new.isEmpty():
            break
        marked = written(reached.unionByName(new), marked)
    under = own.join(reached.withColumnRenamed("at", "up"), "up", "left_semi")
    return under.select("at.conversation", "at.node").distinct()


def node_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (conversation, node, status) of the messages of either side.

    Both sides have conversation, node, parent, message_sha (null without a message) and context_sha. A message that is
    the same but below a changed, new or missing node is context_changed. Nodes of the column ``issues`` (optional, an
    array) that isn't empty get no status, but what is below them is context_changed too. Rows without a conversation
    are left out: they are the ambiguous ones, see usable(). An empty side makes all of the other new, or not present.
    """
    sides = []
    for name, side in (("x", before), ("y", after)):
        issues = F.size("issues") > 0 if "issues" in side.columns else F.lit(False)
        sides.append(side.where("conversation is not null").select("conversation", "node", F.struct("message_sha", "context_sha", issues.alias("unclear")).alias(name)))
    both = sides[0].join(sides[1], ["conversation", "node"], "full_outer")
    x, y = F.col("x"), F.col("y")
    unclear = F.coalesce(x["unclear"], F.lit(False)) | F.coalesce(y["unclear"], F.lit(False))
    same_context = x["context_sha"].eqNullSafe(y["context_sha"])
    status = (
        F.when(unclear, F.lit(None))
        .when(y["message_sha"].isNotNull() & x["message_sha"].isNull(), "new_messages")
        .when(y["message_sha"].isNotNull() & (x["message_sha"] != y["message_sha"]), "changed_messages")
        .when(y["message_sha"].isNotNull() & ~same_context, "context_changed_messages")
        .when(y["message_sha"].isNotNull(), "unchanged_messages")
        .when(x["message_sha"].isNotNull(), "not_present_messages")
    )
    dirty = unclear | x.isNull() | y.isNull() | ~x["message_sha"].eqNullSafe(y["message_sha"]) | ~same_context
    found = both.select("conversation", "node", status.alias("status"), dirty.alias("dirty"))
    links = before.select("conversation", "parent", "node").unionByName(after.select("conversation", "parent", "node")).where("conversation is not null and parent is not null").distinct()
    under = below(found.where("dirty").select("conversation", "node"), links)
    return (
        found.where("status is not null")
        .join(under.withColumn("below", F.lit(True)), ["conversation", "node"], "left")
        .select("conversation", "node", F.when(F.col("below") & (F.col("status") == "unchanged_messages"), "context_changed_messages").otherwise(F.col("status")).alias("status"))
    )


def conversation_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (conversation, status) for new, absent or changed conversations; both sides have conversation, metadata_sha."""
    both = before.select("conversation", F.struct("metadata_sha").alias("x")).join(after.select("conversation", F.struct("metadata_sha").alias("y")), "conversation", "full_outer")
    status = (
        F.when(F.col("x").isNull(), "new_conversations")
        .when(F.col("y").isNull(), "not_present_conversations")
        .when(~F.col("x.metadata_sha").eqNullSafe(F.col("y.metadata_sha")), "conversation_metadata_changed")
    )
    return both.select("conversation", status.alias("status")).where("status is not null")


def counts(*changes: DataFrame) -> DataFrame:
    """Rows (kind, n): every kind once, absent ones as 0."""
    spark = changes[0].sparkSession
    seen = changes[0].select("status")
    for c in changes[1:]:
        seen = seen.unionByName(c.select("status"))
    kinds = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    return kinds.join(seen.groupBy(F.col("status").alias("kind")).agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@dataclass
class Comparison:
    """counts: kind, n; changes: kind, conversation_id, node_id, logical_key, before, after (places; null on a side that
    lacks it); ambiguities: side, conversation_id, node_id, issues."""

    counts: DataFrame
    changes: DataFrame
    ambiguities: DataFrame


def logical_key(namespace: str, conversation, node):
    """The id of a message across exports: the hash of a JSON array (ASCII, so that any id has one spelling)."""
    array = F.to_json(F.array(F.lit("chatgpt"), F.lit(namespace), conversation, node))
    return sha256(_ascii(array))


@F.pandas_udf(StringType())
def _ascii(texts):
    import json

    return texts.map(lambda t: json.dumps(json.loads(t), ensure_ascii=True, separators=(",", ":")) if isinstance(t, str) else None)


def compare(before: DataFrame, after: DataFrame, namespace: str) -> Comparison:
    """Compares two sides of raw_store.occurrences(): conversations by id where it names one on each side at most, nodes
    by id within them. Unchanged messages are counted, not listed. Both sides are written once, and read from there."""
    spark = before.sparkSession
    sides = {"before": written(before), "after": written(after)}
    unknown = [s.where("conversation_id is null").select(F.lit(k).alias("side"), "conversation_id", F.lit(None).cast("string").alias("node_id"), "issues") for k, s in sides.items()]
    several = [s.where("conversation_id is not null").groupBy("conversation_id").count().where("count > 1").select("conversation_id") for s in sides.values()]
    twice = several[0].union(several[1]).distinct()
    repeated = twice.select(F.lit("both").alias("side"), "conversation_id", F.lit(None).cast("string").alias("node_id"), F.array(F.lit("duplicate_conversation_id")).alias("issues"))
    clear = {k: s.where("conversation_id is not null").join(twice, "conversation_id", "left_anti") for k, s in sides.items()}
    place = F.struct("payload_sha256", "json_pointer", "byte_span", F.lit(None).cast("string").alias("message_sha256"), F.lit(None).cast("string").alias("message_id"))
    nodes, convs = {}, {}
    for k, s in clear.items():
        convs[k] = s.select(F.col("conversation_id").alias("conversation"), F.col("metadata_sha256").alias("metadata_sha"), place.alias(k))
        each = s.select("conversation_id", "payload_sha256", F.explode("nodes").alias("n"))
        at = F.struct("payload_sha256", F.col("n.message_pointer").alias("json_pointer"), F.col("n.message_byte_span").alias("byte_span"), "n.message_sha256", "n.message_id")
        nodes[k] = each.select(F.col("conversation_id").alias("conversation"), F.col("n.node_id").alias("node"), F.col("n.parent_id").alias("parent"), F.col("n.message_sha256").alias("message_sha"), F.col("n.context_sha256").alias("context_sha"), F.col("n.issues").alias("issues"), at.alias(k))
    changed = written(node_changes(nodes["before"], nodes["after"]))
    moved = conversation_changes(convs["before"], convs["after"])
    ambiguous = unknown[0].unionByName(unknown[1]).unionByName(repeated)
    marked = ambiguous.select(F.lit("ambiguous_conversations").alias("status"))
    issues = nodes["before"].select("conversation", "node", "issues").union(nodes["after"].select("conversation", "node", "issues")).where("size(issues) > 0")
    unclear = issues.groupBy("conversation", "node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues"))
    kinds = spark.createDataFrame([("not_present_conversations", "conversation_not_present"), ("conversation_metadata_changed", "conversation_metadata_changed")], "status string, kind string")
    whole = moved.join(F.broadcast(kinds), "status").withColumn("node", F.lit(None).cast("string"))
    listed = whole.select("kind", "conversation", "node").join(convs["before"].drop("metadata_sha"), "conversation", "left").join(convs["after"].drop("metadata_sha"), "conversation", "left").withColumn("logical_key", F.lit(None).cast("string"))
    each = changed.where("status <> 'unchanged_messages'").withColumnRenamed("status", "kind").withColumn("logical_key", logical_key(namespace, F.col("conversation"), F.col("node")))
    for k in sides:
        each = each.join(nodes[k].select("conversation", "node", k), ["conversation", "node"], "left")
    columns = ["kind", F.col("conversation").alias("conversation_id"), F.col("node").alias("node_id"), "logical_key", "before", "after"]
    return Comparison(
        counts(changed, moved, marked),
        listed.select(*columns).unionByName(each.select(*columns)),
        ambiguous.unionByName(unclear.select(F.lit("both").alias("side"), F.col("conversation").alias("conversation_id"), F.col("node").alias("node_id"), "issues")),
    )
