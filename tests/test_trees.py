"""Trees by doubling against loops, on forests, chains, cycles and rows with nulls and repeats."""

import random

import pytest

from attestry.operators import delta, graph

SCHEMA = "conversation int, node string, parent string, position int"


def forest(seed, conversations=6, n=40, cycles=False):
    rng, rows = random.Random(seed), []
    for c in [None, *range(conversations)]:
        size = rng.randint(1, n)
        for i in range(size):
            parent = rng.choice([None, f"{rng.randrange(size)}" if cycles else f"{rng.randrange(i)}", f"{i - 1}", "gone"]) if i else None
            rows.append((c, str(i), parent, rng.randint(0, 9) * 100 + i))
    rng.shuffle(rows)
    return rows


def walk(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[3])
        known = {r[1] for r in own}
        kids = {}
        for r in own:
            kids.setdefault(r[2] if r[2] in known else None, []).append(r[1])
        order, todo = [], list(reversed(kids.get(None, [])))
        while todo:
            x = todo.pop()
            order.append(x)
            todo += reversed(kids.get(x, []))
        out |= {(c, x): i for i, x in enumerate(order)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_forests(spark, seed):
    rows = forest(seed)
    got = {(r["conversation"], r["node"]): r["order"] for r in graph.tree_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == walk(rows) and len(got) == len(rows)


def test_order_path_and_cycles_where_links_go_round(spark):
    rows = forest(3, cycles=True)
    nodes = spark.createDataFrame(rows, SCHEMA)
    want = walk(rows)
    got = {(r["conversation"], r["node"]): r["order"] for r in graph.tree_order(nodes, strict=False).collect()}
    assert got == {(r[0], r[1]): want.get((r[0], r[1])) for r in rows} and None in got.values()
    with pytest.raises(graph.GraphError):
        graph.tree_order(nodes).collect()
    parent = {(r[0], r[1]): (r[0], r[2]) for r in rows}
    round_ = set()
    for k in parent:
        at, seen = parent[k], set()
        while at in parent and at not in seen and at != k:
            seen.add(at)
            at = parent[at]
        round_ |= {k} if at == k else set()
    assert {(r["conversation"], r["node"]) for r in graph.cycle_members(nodes).collect()} == round_ and round_
    starts = [(c, str(i)) for c, i in [(None, 0), (0, 1), (1, 3), (2, 0), (3, 2), (4, 99), (5, None)]]
    steps = {}
    for k in starts:
        at, depth = k, 0
        while at in parent and at not in steps:
            steps[at] = depth
            at, depth = parent[at], depth + 1
    path = graph.selected_path(nodes.select("conversation", "node", "parent"), spark.createDataFrame([(c, n if n != "None" else None) for c, n in starts], "conversation int, current string"))
    assert {(r["conversation"], r["node"]): r["depth"] for r in path.collect()} == steps


def test_repeated_nodes_keep_their_rows(spark):
    rows = [(1, "a", None, 0), (1, "a", None, 5), (1, "b", "a", 1), (1, None, "b", 2), (1, None, None, 9)]
    got = sorted((r["order"], r["node"], r["position"]) for r in graph.tree_order(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, "a", 0), (1, "a", 5), (2, "b", 1), (3, None, 2), (4, None, 9)]


def test_one_deep_conversation(spark):
    """A chain of 20,000 nodes with a leaf at each: no row of a task grows with it."""
    n = 20_000
    chain = spark.range(n).selectExpr("1 as conversation", "id * 2 as node", "case when id > 0 then id * 2 - 2 end as parent", "id * 2 as position")
    leaves = spark.range(n).selectExpr("1 as conversation", "id * 2 + 1 as node", "id * 2 as parent", "id * 2 + 1 as position")
    ordered = graph.tree_order(chain.unionByName(leaves))
    # a leaf comes before the chain goes on only where its position is less
    got = ordered.selectExpr("min(order)", "max(order)", "count(distinct order)", "sum(case when node % 2 = 0 and order = node / 2 + (case when node > 0 then node / 2 else 0 end) then 1 else 0 end)").first()
    assert tuple(got) == (0, 2 * n - 1, 2 * n, n)


def test_below_follows_every_parent(spark):
    rng = random.Random(4)
    links = [(c, str(rng.randrange(30)), str(rng.randrange(30))) for c in (None, 1, 2) for _ in range(33)]
    start = [(None, "1"), (1, "2"), (1, "3"), (2, "99"), (2, "4")]
    want = set()
    for c, s in start:
        todo = [s]
        while todo:
            at = todo.pop()
            for k in [(x, n) for x, p, n in links if x == c and p == at]:
                if k not in want:
                    want.add(k)
                    todo.append(k[1])
    got = delta.below(spark.createDataFrame(start, "conversation int, node string"), spark.createDataFrame(links, "conversation int, parent string, node string"))
    assert {tuple(r) for r in got.collect()} == want and want
