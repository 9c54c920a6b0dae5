"""Fused rankings against whole rankings in plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from qaloom.operators.ranking import _ahead, fused_top


def plain(queries, docs, k, rrf):
    words = lambda t: "".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in (t or "").lower()).split()
    texts = {d: words(t) for d, t in docs}
    n, mean = len(texts), sum(map(len, texts.values())) / max(1, len(texts))
    df = Counter(t for said in texts.values() for t in set(said))
    out = []
    for q, text in queries:
        asked = set(words(text))
        scored = []
        for d, said in texts.items():
            tf = Counter(t for t in said if t in asked)
            if tf:
                weight = lambda t, f, said=said: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(said) / mean))
                scored.append((d, sum(round(weight(t, f) * 1e9) for t, f in tf.items()), len(tf)))
        ranks = [{d: r for r, (d, *_) in enumerate(sorted(scored, key=lambda x: (-x[m], x[0])), 1)} for m in (1, 2)]
        fused = sorted(((1 / (rrf + ranks[0][d]) + 1 / (rrf + ranks[1][d]), d) for d, *_ in scored), key=lambda x: (-x[0], x[1]))
        out += [(q, d, r, s) for r, (s, d) in enumerate(fused[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "rrf", "at_once"), [(10, 60, 1000), (3, 1, 2), (1, 0, 1), (25, 5, 3)])
def test_fused_equals_whole_rankings(spark, k, rrf, at_once):
    rng = random.Random(k)
    said = lambda n: " ".join(rng.choice("alpha Beta ga-mma x9 of the the é zeta".split()) for _ in range(rng.randrange(n)))
    docs = [(i, rng.choice([None, "", said(4), said(60), said(60)])) for i in range(-100, 300)]
    docs += [(1000 + i, docs[150][1]) for i in range(40)]  # ties
    queries = [(q, said(6)) for q in range(5)] + [(7, None), (8, "nowhere"), (9, "the the of")]
    got = fused_top(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(5), k, rrf, at_once=at_once).collect()
    want = plain(queries, docs, k, rrf)
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in got) == [w[:3] for w in want] and want
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in got} == pytest.approx({w[:2]: w[3] for w in want})


def test_nothing_to_rank(spark):
    some, none = spark.createDataFrame([(1, "a b")], "query_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert fused_top(some, none).count() == 0
    assert fused_top(some.limit(0), spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 0


def test_places_of_candidates():
    ids, by = np.array([5, 3, 9, 1]), np.array([10, 20, 10, 0])
    assert _ahead(ids, by, np.array([9, 5, 4, 3]), np.array([10, 10, 10, 20])).tolist() == [2, 1, 1, 0]
