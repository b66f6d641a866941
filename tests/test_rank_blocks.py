"""PageRank by blocks of edges: nodes of several blocks, loops, lone seeds; directed graphs keep the plain loop."""

import random

import numpy as np
import pytest

from chronoloom.operators import graph as P
from chronoloom.operators import rank_blocks as B


def solved(n, edges, reset, damping):
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[b, a] += w
    out, r = m.sum(axis=0), reset / reset.sum()
    walk = np.divide(m, out, out=np.zeros_like(m), where=out > 0) + np.outer(r, out == 0)
    return np.linalg.solve(np.eye(n) - damping * walk, (1 - damping) * r)


def test_blocks_give_the_fixed_point_in_few_steps(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_NUMBERS", 130)
    rng = random.Random(5)
    n = 14
    und = [(rng.randrange(12), rng.randrange(12), rng.choice([1.0, 2.5])) for _ in range(30)] + [(3, 3, 2.0)]
    edges = [(a, b, w) for a, b, w in und] + [(b, a, w) for a, b, w in und if a != b]
    resets = {7: np.array([1.0] + [0] * 12 + [3.0]), 9: np.array([0, 2.0, 1.0] + [0] * 11)}      # 13 has no edges
    de = spark.createDataFrame([(f"n{a}", f"n{b}", w) for a, b, w in edges], "src string, dst string, weight double")
    dr = spark.createDataFrame([(q, f"n{i}", float(m)) for q, r in resets.items() for i, m in enumerate(r)], "qid int, node string, mass double")
    got = {(r["qid"], r["node"]): r["score"] for r in P.personalized_pagerank(de, dr, 0.5, steps=22).collect()}   # the plain loop takes 35
    for q, r in resets.items():
        want = solved(n, edges, r, 0.5)
        for i in range(n):
            assert got.get((q, f"n{i}"), 0.0) == pytest.approx(want[i], abs=1e-9)
    assert B.undirected(de.where("src <> 'n3'")) is None
