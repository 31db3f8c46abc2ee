"""Folds over ranges of a group and joins of intervals, against loops."""

import random

import pytest

from attestry.operators import folds, intervals

SCHEMA = "g string, i int, size int, extra string"


def groups(seed, sizes, lengths):
    """Rows with a group of a third of them, a null group and many small groups, shuffled."""
    rng = random.Random(seed)
    counts = {"hot": lengths[0], None: lengths[1], **{f"g{k:03}": rng.randint(1, 6) for k in range(lengths[2])}}
    rows = [(g, i, rng.choice(sizes), f"{g}-{i}") for g, n in counts.items() for i in range(n)]
    rng.shuffle(rows)
    return rows


def by_group(rows):
    out = {}
    for g, i, n, _ in rows:
        out.setdefault(g, []).append((i, n or 0))
    return {g: sorted(r) for g, r in out.items()}


def filled(rows, limit):
    want = {}
    for g, own in by_group(rows).items():
        number, used = 0, limit + 1
        for i, n in own:
            if used + n > limit:
                number, used = number + 1, 0
            used += n
            want[g, i] = number
    return want


def taken(rows, budget):
    want = {}
    for g, own in by_group(rows).items():
        left = budget
        for i, n in own:
            want[g, i] = n <= left
            left -= n if n <= left else 0
    return want


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("sizes,limit", [([0, 1, 5, 9, 10, None], 10), ([3, 4, 40], 25), ([0, None], 5), ([1], 1)])
def test_fill(spark, parts, sizes, limit):
    rows = groups(parts, sizes, (400, 150, 60))
    out = folds.fill(spark.createDataFrame(rows, SCHEMA), "g", ["i"], "size", limit, "n", parts)
    got = out.collect()
    assert out.columns == ["g", "i", "size", "extra", "n"] and len(got) == len(rows)
    assert {(r.g, r.i): r.n for r in got} == filled(rows, limit)
    assert all(r.extra == f"{r.g}-{r.i}" for r in got)


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("sizes,budget", [([0, 1, 5, 9, None], 60), ([7, 100, 1000, 3], 900), (list(range(1, 65)), 4000), ([1], 0), ([0, 5], 4)])
def test_take(spark, parts, sizes, budget):
    rows = groups(parts + 1, sizes, (400, 150, 60))
    got = folds.take(spark.createDataFrame(rows, SCHEMA), "g", ["i"], "size", budget, "n", parts).collect()
    assert {(r.g, r.i): r.n for r in got} == taken(rows, budget) and len(got) == len(rows)


def test_a_budget_that_shrinks_by_halves_over_many_ranges(spark):
    rows = [("a", i, 2 ** (12 - i // 30) if i % 30 == 0 else 5000, "") for i in range(390)]
    got = folds.take(spark.createDataFrame(rows, SCHEMA), "g", ["i"], "size", 2**13 - 1, "n", 40).collect()
    assert {(r.g, r.i): r.n for r in got} == taken(rows, 2**13 - 1) and sum(r.n for r in got) == 13


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running(spark, parts):
    rows = groups(parts + 2, [0, 3, 8, None], (400, 150, 60))
    want = {}
    for g, own in by_group(rows).items():
        total = 0
        for i, n in own:
            want[g, i] = total
            total += n
    got = folds.running(spark.createDataFrame(rows, SCHEMA), "g", ["i"], "size", "n", parts).collect()
    assert {(r.g, r.i): r.n for r in got} == want and len(got) == len(rows)


def test_a_group_of_two_keys_and_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert folds.fill(none, "g", ["i"], "size", 3, "n").collect() == folds.take(none, "g", ["i"], "size", 3, "n").collect() == folds.running(none, "g", ["i"], "size", "n").collect() == []
    # repeated rows and ties stay in one range and are counted each for itself
    rows = [("a", 1, 2, "x")] * 9 + [("a", 0, 1, "y")]
    got = folds.running(spark.createDataFrame(rows, SCHEMA), "g", ["i"], "size", "n", 5).collect()
    assert sorted(r.n for r in got) == [0, 1, 3, 5, 7, 9, 11, 13, 15, 17]
    assert sorted(r.n for r in folds.fill(spark.createDataFrame(rows, SCHEMA), "g", ["i"], "size", 4, "n", 5).collect()) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_a_large_group_takes_many_tasks(spark):
    rows = spark.range(40_000).selectExpr("'one' as g", "cast(id as int) as i", "1 as size", "'' as extra")
    out = folds.running(rows, "g", ["i"], "size", "n", 20)
    assert out.where("n <> i").count() == 0
    packed = folds.fill(rows, "g", ["i"], "size", 7, "n", 20)
    assert packed.where("n <> floor(i / 7) + 1").count() == 0


def pairs(left, right):
    return sorted((a[-1], b[-1]) for a in left for b in right if a[0] is not None and a[0] == b[0] and None not in (*a[1:3], *b[1:3]) and a[1] <= a[2] and b[1] <= b[2] and a[1] < b[2] and b[1] < a[2])


def test_overlaps(spark):
    rng = random.Random(3)

    def some(n, name):
        rows = []
        for i in range(n):
            start = rng.randint(-40, 400)
            rows.append((rng.choice(["a", "b"]), start, start + rng.choice([0, 1, 3, 4, 5, 16, 17, 64, 300]), f"{name}{i}"))
        return [*rows, (None, 0, 9, f"{name}n"), ("a", None, 9, f"{name}s"), ("a", 0, None, f"{name}e"), ("a", 9, 0, f"{name}r"), rows[0]]

    left, right = some(120, "l"), some(90, "r")
    a, b = spark.createDataFrame(left, "k string, s int, e int, l string"), spark.createDataFrame(right, "k string, s2 long, e2 long, r string")
    out = intervals.overlapping(a, b, ["k"], ("s", "e"), ("s2", "e2"))
    assert out.columns == ["k", "s", "e", "l", "s2", "e2", "r"]
    assert sorted((r.l, r.r) for r in out.collect()) == pairs(left, right)
    assert intervals.overlapping(a.limit(0), b, ["k"], ("s", "e"), ("s2", "e2")).collect() == []
    with pytest.raises(ValueError, match="both sides"):
        intervals.overlapping(a, b.withColumn("l", b.r), ["k"], ("s", "e"), ("s2", "e2"))


def test_a_hundred_thousand_of_one_segment(spark):
    """Pieces of 400 and quotes of 40 places on one text: what the join tries is a small multiple of what it gives."""
    pieces = spark.range(100_000).selectExpr("'m' as k", "id * 400 as s", "id * 400 + 400 as e", "id as piece")
    quotes = spark.range(100_000).selectExpr("'m' as k", "id * 400 + 380 as qs", "id * 400 + 420 as qe", "id as quote")
    out = intervals.overlapping(quotes, pieces, ["k"], ("qs", "qe"), ("s", "e"))
    assert out.where("piece not in (quote, quote + 1)").count() == 0 and out.count() == 199_999
    left = intervals._dealt(quotes, "qs", "qe", [64, 1024], "_l").groupBy("k", "_w", "_b").count()
    right = intervals._dealt(pieces, "s", "e", [64, 1024], "_r").groupBy("k", "_w", "_b").count()
    tried = left.alias("l").join(right.alias("r"), ["k", "_w", "_b"]).selectExpr("sum(l.count * r.count) as n").first().n
    assert tried < 2_000_000
