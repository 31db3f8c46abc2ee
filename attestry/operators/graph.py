"""Conversation trees: order, paths, fan-out, link checks, cycles.

Trees are worked on by joins over all conversations at once, whatever the size of one: what follows links to any depth is
pointer doubling in written rounds (rounds.doubled). Rows without a conversation are one conversation like any other; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.ranges import numbered
from attestry.operators.rounds import doubled, longest, written

KEY = ["conversation", "node"]


class GraphError(ValueError):
    """A conversation whose nodes can't all be reached from a root."""


def tree_order(nodes: DataFrame, strict: bool = True) -> DataFrame:
    """Adds ``order``, the place from 0 of each node in its conversation's parent-first order (replacing a column of that
    name). Every row gives one row.

    ``nodes`` has conversation, node, parent and position (the export's order, which orders siblings). A node whose
    parent isn't in its conversation is a root; of rows that repeat a node its children hang below the last. Cycles raise
    GraphError if strict, else their nodes, and those below, get a null.

    The order is a rank in a list: a walk round the trees goes down to each node and up from it again. Down leads to the
    first child, else up; up leads down to the next sibling, else up from the parent. Doubling counts, for each step, the
    nodes gone down to from there to the end.
    """
    held = written(nodes.drop("order").withColumn("_row", F.monotonically_increasing_id()))
    links = held.select("_row", "conversation", "node", "parent", "position")
    place = links.where("node is not null").groupBy(F.col("conversation").alias("_c"), F.col("node").alias("_n")).agg(F.max_by("_row", F.struct("position", "_row")).alias("up"))
    named = links.join(place, F.col("conversation").eqNullSafe(F.col("_c")) & (F.col("parent") == F.col("_n")), "left").select("_row", "conversation", "position", "up")
    siblings = Window.partitionBy("conversation", "up").orderBy("position", "_row")
    placed = written(named.select("_row", "conversation", "up", F.lead("_row").over(siblings).alias("beside"), (F.row_number().over(siblings) == 1).alias("eldest")))
    child = placed.where(F.col("eldest") & F.col("up").isNotNull()).select(F.col("up").alias("_row"), F.col("_row").alias("child"))
    down, up = F.col("_row") * 2, F.col("_row") * 2 + 1
    steps = placed.join(child, "_row", "left").select(
        F.explode(
            F.array(
                F.struct(down.alias("at"), F.coalesce(F.col("child") * 2, up).alias("next"), F.lit(1).cast("long").alias("left")),
                F.struct(up.alias("at"), F.coalesce(F.col("beside") * 2, F.col("up") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("left")),
            )
        ).alias("s")
    )
    ranked = doubled(steps.select("s.*"), longest(placed, "conversation") + 1, {"left": F.col("left") + F.coalesce("far_left", F.lit(0))})
    if strict and not ranked.where("next is not null").isEmpty():
        raise GraphError("the graph has a cycle or nodes that no root reaches")
    reached = ranked.where("next is null and at % 2 = 0").select((F.col("at") / 2).cast("long").alias("_row"), "left")
    counted = placed.select("_row", "conversation").join(reached, "_row")
    # the first root has all nodes before the end
    total = counted.groupBy(F.col("conversation").alias("_c")).agg(F.max("left").alias("total"))
    order = counted.join(total, F.col("conversation").eqNullSafe(F.col("_c"))).select("_row", (F.col("total") - F.col("left")).cast("int").alias("order"))
    return held.join(order, "_row", "left").drop("_row")


def _parents(nodes: DataFrame) -> DataFrame:
    """Rows (at, next): each node's place and its parent's, as structs; of rows that repeat a node the least parent's."""
    at = nodes.where("node is not null").groupBy(*KEY).agg(F.min("parent").alias("parent"))
    return at.select(F.struct(*KEY).alias("at"), F.when(F.col("parent").isNotNull(), F.struct("conversation", F.col("parent").alias("node"))).alias("next"))


def selected_path(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (conversation, node, depth) from each conversation's current node (depth 0) up to its root; on a cycle each
    node once. ``current`` has conversation and current; what names no node there has no rows.

    Round k adds to the nodes of the path so far those 2**k above them.
    """
    jumps = written(_parents(nodes))
    path = written(current.where("current is not null").select(F.struct("conversation", F.col("current").cast(nodes.schema["node"].dataType).alias("node")).alias("at"), F.lit(0).alias("depth")).join(jumps.select("at"), "at", "left_semi").distinct())
    for k in range(longest(nodes, "conversation")):
        above = path.join(jumps.where("next is not null"), "at").select(F.col("next").alias("at"), (F.col("depth") + (1 << k)).alias("depth")).join(jumps.select("at"), "at", "left_semi")
        if above.isEmpty():
            break
        path = written(path.unionByName(above).groupBy("at").agg(F.min("depth").alias("depth")), path)
        far = jumps.select(F.col("at").alias("next"), F.col("next").alias("far"))
        jumps = written(jumps.join(far, "next", "left").select("at", F.col("far").alias("next")), jumps)
    return path.select("at.conversation", "at.node", "depth")


def on_cycles(parent: dict) -> set:
    """The keys that lie on a cycle of the map; tails that lead into one don't count. Peels off, again and again, what
    nothing points at: what is left has a way back to itself."""
    into: dict = {k: 0 for k in parent}
    for p in parent.values():
        if p in into:
            into[p] += 1
    free = [k for k, n in into.items() if n == 0]
    while free:
        k = free.pop()
        p = parent[k]
        del into[k]
        if p in into:
            into[p] -= 1
            if into[p] == 0:
                free.append(p)
    return set(into)


def cycle_members(nodes: DataFrame) -> DataFrame:
    """Rows (conversation, node) of nodes that lie on a cycle of parent links; tails that lead into one don't count. Who
    goes on for more links than there are nodes ends on a cycle, and its nodes all end on it."""
    ended = doubled(_parents(nodes), longest(nodes, "conversation"))
    return ended.where("next is not null").select("next.conversation", "next.node").distinct()


def children(nodes: DataFrame) -> DataFrame:
    """Rows (conversation, node, children): each parent's child nodes by position."""
    return (
        nodes.where("parent is not null")
        .groupBy("conversation", F.col("parent").alias("node"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("node").alias("child")))), lambda x: x["child"]).alias("children"))
    )


def branch_points(nodes: DataFrame) -> DataFrame:
    """Rows (conversation, node, fan_out) of nodes with several children."""
    return nodes.where("parent is not null").groupBy("conversation", F.col("parent").alias("node")).agg(F.count("*").alias("fan_out")).where("fan_out > 1")


def branch_structure(nodes: DataFrame) -> DataFrame:
    """Rows (conversation, node, kind, listed): roots (nodes whose parent isn't a node there; listed is that parent, if
    any) and branch points (listed are the children, by position, with a comma between)."""
    known = nodes.select("conversation", F.col("node").alias("parent"))
    roots = nodes.join(known, ["conversation", "parent"], "left_anti").select("conversation", "node", F.lit("root").alias("kind"), F.col("parent").cast("string").alias("listed"))
    several = children(nodes).where(F.size("children") > 1).join(nodes.select(*KEY), KEY, "left_semi")
    return roots.unionByName(several.select("conversation", "node", F.lit("branch_point").alias("kind"), F.array_join(F.col("children").cast("array<string>"), ",").alias("listed")))


def dangling_parents(nodes: DataFrame, roots: list | None = None) -> DataFrame:
    """Nodes whose parent is neither null nor a node of their conversation nor one of the known root ids."""
    known = nodes.select("conversation", F.col("node").alias("parent"))
    out = nodes.where("parent is not null").join(known, ["conversation", "parent"], "left_anti")
    return out.where(~F.col("parent").isin(roots)) if roots else out


def link_mismatches(nodes: DataFrame) -> DataFrame:
    """Rows (conversation, parent, child, code): child_link where a listed child doesn't name the parent, parent_link
    where a node's parent doesn't list it. ``nodes`` also has children_ids; a null list lists nothing and is no fault."""
    listed = nodes.select("conversation", F.col("node").alias("parent"), F.explode("children_ids").alias("child"))
    named = nodes.where("parent is not null").select("conversation", "parent", F.col("node").alias("child"))
    silent = nodes.where("children_ids is null").select("conversation", F.col("node").alias("parent"))
    there = nodes.select("conversation", F.col("node").alias("parent"))
    both = ["conversation", "parent", "child"]
    return (
        listed.join(named, both, "left_anti").withColumn("code", F.lit("child_link"))
        .unionByName(
            named.join(there, ["conversation", "parent"], "left_semi").join(silent, ["conversation", "parent"], "left_anti")
            .join(listed, both, "left_anti").select(*both).withColumn("code", F.lit("parent_link"))
        )
    )


def conversation_rank(conversations: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1: conversations without a time first, then by time, original id and record id."""
    return numbered(conversations, ["created_at", "original_id", "record_id"], "rank")
