"""Texts looked for in a document of many rows."""

import random

from attestry.operators import needles


def test_equals_contains(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé🌱") for _ in range(n))
    document = [word(rng.randint(0, 60)) for _ in range(25)] + [None, "", word(900)]
    sought = [word(rng.randint(1, 6)) for _ in range(150)] + [document[0][3:30], document[-1][100:400], document[-1], "x", None, "", "a\nb"]
    want = {s for s in sought if s is not None and any(s in d for d in document if d is not None)}
    frames = spark.createDataFrame([(s,) for s in sought], "needle string"), spark.createDataFrame([(d,) for d in document], "text string")
    assert {r.needle for r in needles.found(*frames, automaton=40, chunk=16).collect()} == want
    none = spark.createDataFrame([], "text string")
    assert needles.found(frames[0], none).collect() == [] and needles.found(none.withColumnRenamed("text", "needle"), frames[1]).collect() == []
