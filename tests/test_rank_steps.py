"""Steps over several blocks leave plans of bounded size; the best pairs of ends are those of all sums."""

import random

from chronoloom.operators import graph as P
from chronoloom.operators import rank_blocks as B


def test_plan_sizes_do_not_grow_with_the_steps(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_NUMBERS", 130)
    rng = random.Random(7)
    und = [(f"n{rng.randrange(12)}", f"m{rng.randrange(12)}", 1.0) for _ in range(40)]
    de = spark.createDataFrame(und + [(b, a, w) for a, b, w in und], "src string, dst string, weight double")
    dr = spark.createDataFrame([(1, und[0][0], 1.0)], "qid int, node string, mass double")
    ranks = P.personalized_pagerank(de, dr, 0.5)
    bits = ranks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    assert bits < 2000
    assert abs(sum(r.score for r in ranks.collect()) - 1) < 1e-9


def test_best_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_QUERIES", 2)
    rng = random.Random(3)
    ranks = {(q, n): rng.randrange(1, 6) / 8 for q in (11, 12, 13, 14, 15) for n in "abcdef" if rng.random() < 0.7}
    pairs = [(s, o) for s in "abcx" for o in "adey" if rng.random() < 0.8] + [(None, "a"), ("a", None), ("b", "b")]
    got = P._best_pairs(spark.createDataFrame(pairs, "s string, o string"), spark.createDataFrame([(q, n, x) for (q, n), x in ranks.items()], "qid int, node string, score double"), 2)
    want = set()
    for q in (11, 12, 13, 14, 15):
        sums = {(s, o): sum(ranks[q, n] for n in (s, o) if (q, n) in ranks) for s, o in pairs if any((q, n) in ranks for n in (s, o))}
        best = sorted(set(sums.values()))[-2:]
        want |= {(q, s, o, x) for (s, o), x in sums.items() if x in best}
    assert {tuple(r) for r in got.select("qid", "s", "o", "score").collect()} == want
