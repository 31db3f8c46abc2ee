"""Sessions against a loop over each client's clicks, on ranges that are smaller than an island, too."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from attestry.llm import sessions

BASE = datetime(2024, 1, 1)
SCHEMA = "client_id long, ts timestamp_ntz, click_id long, arrived_at timestamp_ntz, kind string, value double, client string, session string, part string, flags string, r string"


def click(i, client, second, kind="view", value=1.0, delay=0, micro=0):
    ts = None if second is None else BASE + timedelta(seconds=second, microseconds=micro)
    arrived = None if delay is None or ts is None else ts + timedelta(seconds=delay)
    return (client, ts, i, arrived, kind, value, "c", "s", "p", "f", "r")


def us(t):
    return (t - BASE) // timedelta(microseconds=1) + 1_704_067_200_000_000


def brute(rows):
    own = {}
    for r in sorted((r for r in rows if None not in r[:3]), key=lambda r: r[2]):
        own.setdefault(r[2], r)
    clients = {}
    for r in own.values():
        clients.setdefault(r[0], []).append(r)
    late_of = lambda r: r[3] is not None and r[3] - r[1] > timedelta(minutes=15)
    final = lambda r: r[4] in ("purchase", "signup") and r[5] is not None and r[5] >= 60
    out = []
    for client, mine in clients.items():
        found = []
        for r in sorted((r for r in mine if not late_of(r)), key=lambda r: (r[1], r[2])):
            why = None
            if found:
                last = found[-1][-1]
                why = "end" if final(last) else "gap" if r[1] - last[1] >= timedelta(minutes=15) else "length" if r[1] - found[-1][0][1] > timedelta(hours=1) else None
                if why is None:
                    found[-1].append(r)
                    continue
                out[-1][7] = why
            found.append([r])
            out.append([client, r[2], us(r[1]), None, None, 0, None, None, None])
            out[-1][7] = found[-1]
        mine_out = out[len(out) - len(found) :]
        for k, (o, s) in enumerate(zip(mine_out, found, strict=True)):
            nxt = found[k + 1][0][1] if k + 1 < len(found) else None
            o[3], o[4] = us(s[-1][1]), len(s)
            o[5] = sum(1 for r in mine if late_of(r) and r[1] >= s[0][1] and (nxt is None or r[1] < nxt))
            o[6] = sum(0 if r[5] is None else int(np.floor(100 * r[5] + 0.5)) for r in s)
            o[7] = o[7] if isinstance(o[7], str) else "end" if final(s[-1]) else "none"
            o[8] = ",".join(str(r[2]) for r in s)
    return sorted(map(tuple, out))


def found(spark, rows, parts, schema=SCHEMA):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return sorted(map(tuple, sessions.sessionise(spark.createDataFrame(rows, schema)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def stream(seed, n, pause, ends=0.05, clients=(7, 7, 7, 3, 9), lates=0.1):
    rng, rows, second = random.Random(seed), [], {}
    for i in range(n):
        c = rng.choice(clients)
        second[c] = second.get(c, 0) + rng.choice(pause)
        late = rng.random() < lates
        rows.append(click(i * 7 % (7 * n + 1), c, second[c], *(("purchase", 60.0) if rng.random() < ends else (rng.choice(["view", None, "signup"]), rng.choice([None, 1.005, 59.99, -3.0]))), 901 if late else rng.choice([None, 0, 900]), rng.choice([0, 0, 1])))
    return rows


@pytest.mark.parametrize(("seed", "pause", "ends", "parts"), [(1, [0, 1, 300, 899, 900], 0.05, 3), (2, [0, 60, 240, 600], 0.0, 24), (3, [600, 890], 0.0, 40), (4, [0, 1, 2], 0.01, 30), (5, [0, 400, 899, 901], 0.2, 40)])
def test_equals_a_loop(spark, seed, pause, ends, parts):
    rows = stream(seed, 160, pause, ends)
    assert found(spark, rows, parts) == brute(rows)


def test_one_client_of_one_island_over_many_ranges(spark):
    rows = stream(9, 150, [61, 500, 720], ends=0.0, clients=(5,), lates=0.3)
    assert found(spark, rows, 37) == brute(rows)
    assert {r[7] for r in brute(rows)} >= {"length"}


def test_edges(spark):
    rows = [
        click(1, 1, 0), click(1, 1, 0), click(2, None, 5), click(3, 1, None), click(None, 1, 9), click(4, 1, 3600), click(5, 1, 899), click(6, 1, 1700), click(7, 1, 2500),
        click(8, 1, 3300), click(9, 1, 3601), click(10, 1, 3600, delay=901), click(11, 1, 3601, delay=901), click(12, 2, 5, delay=4000), click(13, 3, 5, delay=None, kind="purchase", value=None),
        click(14, 4, 5, "signup", 60.0), click(15, 4, 5, "signup", 60.0), click(16, 4, 5), click(17, 4, 5, delay=901), click(18, 4, 4, delay=901),
    ]
    own = brute(rows)
    assert found(spark, rows, 3) == own and found(spark, rows, 40) == own
    assert [r[5] for r in own if r[0] == 4] == [0, 0, 1] and not [r for r in own if r[0] == 2]
    assert found(spark, [], 4) == [] and found(spark, [click(1, None, 4)], 4) == []


def test_odd_values_and_text_ids(spark):
    nan = float("nan")
    rows = [("a", BASE, "x", BASE, "view", nan), ("a", BASE + timedelta(seconds=1), "w", None, "view", 1e300), ("b", BASE, "v", BASE, "purchase", 60.0)]
    got = found(spark, rows, 3, "client_id string, ts timestamp_ntz, click_id string, arrived_at timestamp_ntz, kind string, value double")
    assert [(r[0], r[1], r[4], r[7], r[8]) for r in got] == [("a", "x", 2, "none", "x,w"), ("b", "v", 1, "end", "v")]


def test_lockstep_splits_islands_whose_keys_would_overflow():
    ts = np.array([0, 2**61, 2**61 + 5, 0, 10, 2**61], dtype=np.int64)
    assert sessions.next_starts(ts, np.array([0, 3]), 7).tolist() == [0, 1, 3, 4, 5]
    assert sessions.next_starts(ts[:0], np.array([], dtype=np.int64), 7).tolist() == []
