"""Payloads taken apart at any place are described as they are whole."""

import json
import random

import pytest

from attestry.functions.identity import canonical
from attestry.sources import raw_store, splits


def exports(seed=0, n=5):
    rng = random.Random(seed)
    odd = ['a "quoted" \\ text', "[{,}]", "\\\\", '\\"', "é🌱日本", "\n\t", "", "end\\", '"', "x" * 50]
    out = []
    for i in range(n):
        nodes = {f"n{j}é": {"id": f"n{j}é", "parent": f"n{j - 1}é" if j else None, "children": [f"n{j + 1}é"] if j < 2 else [], "message": {"id": f"m{j}", "t": rng.choice(odd) + rng.choice(odd)} if j != 1 else None} for j in range(3)}
        out.append({"id": f"c{i}", "title": rng.choice(odd), "mapping": nodes, "more": [[1, {"a": []}], rng.choice(odd)]})
    return out


def payloads():
    data = exports()
    bad = exports(2, 2)
    del bad[0]["mapping"]
    texts = {
        "plain": json.dumps(data), "raw": json.dumps(data, ensure_ascii=False, indent=1), "bom": "﻿ \n" + json.dumps(data, ensure_ascii=False) + " \n", "one": json.dumps(exports(3, 1)),
        "empty": " [ \n ] ", "object": json.dumps({"a": [1, 2]}), "trailing": json.dumps(data)[:-1] + ",]", "two": "[1][2]", "text": '"[a, b]"', "cut": json.dumps(data)[:-9], "bad": json.dumps(bad),
        "number": "[1, 2]", "twice": '[{"mapping": {}, "mapping": {}}]', "junk": "x" + json.dumps(data), "after": json.dumps(data) + "]", "comma": json.dumps(data) + ",", "nothing": "   ", "bare": json.dumps(data[0]),
    }
    out = {k: t.encode() for k, t in texts.items()}
    return out | {"bytes": b"[\xff]" + b" " * 40, "inner": json.dumps(data, ensure_ascii=False).encode()[:200] + b"\xff" + json.dumps(data).encode()[200:]}


@pytest.mark.parametrize("split", [7, 64])
def test_equal_descriptions_for_any_split(spark, split):
    rows = payloads()
    frame = spark.createDataFrame(list(rows.items()), "payload_sha256 string, content binary")
    got = {r.payload_sha256: (r.description, r.error) for r in raw_store.descriptions(frame, split=split).collect()}
    want = {}
    for k, data in rows.items():
        try:
            want[k] = (canonical(raw_store.describe(data), ascii_only=True), None)
        except raw_store.StoreError as e:
            want[k] = (None, str(e))
    assert got == want
    assert {k for k, (d, _) in want.items() if d} == {"plain", "raw", "bom", "one", "empty"}
    apart = {r.payload_sha256: r.description for r in splits.described(frame, split).collect()}
    assert {k for k, d in apart.items() if d} == {"plain", "raw", "bom", "one", "empty"}, "the rest isn't a description of parts"


def test_states_of_every_place():
    text = json.dumps(exports(7, 2), ensure_ascii=False).encode()
    whole = splits.marks(text, splits.OUT, 0)
    assert [chr(text[i]) for i in whole] == ["[", ",", "]"]
    for size in (1, 2, 3, 11, 100):
        state, depth, found = splits.OUT, 0, []
        for a in range(0, len(text), size):
            part = text[a : a + size]
            found += [a + i for i in splits.marks(part, state, depth)]
            ends = splits.transitions(part)
            state, depth = ends[2 * state], depth + ends[2 * state + 1]
        assert (found, state, depth) == (whole, splits.OUT, 0)
