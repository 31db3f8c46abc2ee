"""Passages that very many documents have, in the n-gram join: they join no clusters, and no link is lost for that."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import ngram_join


def documents(rng):
    """400 unrelated documents, all with one passage; 20 of them with a near copy; 15 that are little but the passage."""
    passage = " ".join(f"p{i}" for i in range(20))
    out = [(i, " ".join(f"w{i}x{j}" for j in range(100)) + " " + passage + " " + " ".join(f"v{i}x{j}" for j in range(100))) for i in range(400)]
    out += [(1000 + i, out[i][1] + f" more{i}") for i in range(20)]
    out += [(2000 + i, f"{passage} end{i}") for i in range(15)]
    rng.shuffle(out)
    return out


def test_a_common_passage_joins_no_clusters(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTED", 5000)
    largest, real = [], ngram_join.components

    def components(edges):
        out = real(edges)
        largest.append(out.groupBy("root").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ngram_join, "components", components)
    rows = spark.createDataFrame(documents(random.Random(3)), "doc_id long, text string").repartition(4)
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_join(rows, n=5, threshold=(80, 100)).collect())
    assert got == Counter([(i, i) for i in range(400)] + [(1000 + i, i) for i in range(20)] + [(2000 + i, 2000) for i in range(15)])
    # the clusters of signatures: hundreds of documents in one before
    assert largest[0] < 40


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (70, 100), (100, 100)])
def test_linked_sets_share_a_signature_whatever_is_common(num, den):
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.choice([1, 2, 3, 5, 9, 20, 60, 200, 700]))
        every = rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64)
        rank = rng.choice(3, len(every), p=[[1, 0, 0], [0.8, 0.1, 0.1], [0.3, 0.5, 0.2], [0, 0.5, 0.5]][rng.integers(4)]).astype(np.int8)
        order = np.argsort(every)
        common, of = every[order], rank[order]
        # up to as many differences as a link allows: shifted against each other, or one in the other
        if rng.integers(2):
            k = n * (den - num) // (den + num)
            a, b = every[:n], every[(m := k - int(rng.integers(2)) * (k > 0)) : m + n]
        else:
            a, b = every[:n], every[n * (den - num) // den : n]
        shared = len(np.intersect1d(a, b))
        assert den * shared >= num * (len(a) + len(b) - shared)
        one, two = (ngram_join.signatures(np.sort(s), num, den, ngram_join.commonness(np.sort(s), common, of)) for s in (a, b))
        assert len(np.intersect1d(one, two))
