"""Blocks left out by time, by the triangle bound on angles and by upper bounds; results are those of the full product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import neighbours as N
from chronoloom.operators import pivots as P
from chronoloom.operators import vectors as V


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 50)
    monkeypatch.setattr(V, "ROW_BLOCK", 40)
    monkeypatch.setattr(V, "SLICE", 7)


# ---- time blocks ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def timed(spark):
    rng = np.random.default_rng(1)
    q = [(i, int(rng.integers(0, 300)) if i % 17 else None, rng.normal(size=4).round(1).tolist(), int(rng.integers(0, 900))) for i in range(300)]
    r = [(i, 100 if i % 3 == 0 else int(rng.integers(0, 300)) if i % 19 else None, rng.normal(size=4).round(1).tolist()) for i in range(900)]
    return (q, r, spark.createDataFrame(q, "qid int, at bigint, qvec array<double>, g int").cache(),
            spark.createDataFrame(r, "rid int, e bigint, vec array<double>").cache())


def test_every_visible_pair_meets_once_and_the_future_never(timed):
    _, _, q, r = timed
    a, b = V.time_blocks(q, r, ["qid"], "rid", "at", "e")
    pairs = a.join(b, ["_qb", "_rb"])
    visible = q.join(r, F.expr("e <= at")).count()
    assert pairs.where("e <= at").count() == visible
    assert pairs.count() < 1.15 * visible < 0.65 * 300 * 900         # a full product has 270,000
    assert a.select("qid").distinct().count() == 300                  # also those without a time
    assert b.groupBy("_rb").agg(F.count_distinct("rid").alias("n")).agg(F.max("n")).first()[0] < 100   # a third share one time


def test_counts_under_the_guard(timed):
    q, r, dq, dr = timed
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    s = np.round(np.array([unit(x[2]) for x in q]) @ np.array([unit(x[2]) for x in r]).T, 9) + 0.0
    cuts = dq.join(dr.select(F.col("rid").alias("g"), F.col("vec").alias("gv")), "g").withColumn("cut", F.round(V.cosine("qvec", "gv"), 9) + 0.0)
    got = {x["qid"]: (x["n_better"], x["n_seen"]) for x in V.count_better(cuts, dr, ["qid"], "rid", "cut", "g", before=("at", "e")).collect()}
    for i, at, _, g in q:
        seen = [j for j in range(900) if at is not None and r[j][1] is not None and r[j][1] <= at]
        assert got[i] == (sum(s[i, j] > s[i, g] or (s[i, j] == s[i, g] and j < g) for j in seen), len(seen))


def test_topk_under_the_guard(timed):
    q, r, dq, dr = timed
    got = V.topk(dq, dr, 3, ["qid"], "rid", unit=False, before=("at", "e")).toPandas()
    s = np.round(np.array([x[2] for x in q]) @ np.array([x[2] for x in r]).T, 9)
    for i, at, _, _ in q:
        seen = [j for j in range(900) if at is not None and r[j][1] is not None and r[j][1] <= at]
        assert got[got.qid == i].sort_values("rank")["rid"].tolist() == sorted(seen, key=lambda j: (-s[i, j], j))[:3]


# ---- pivots --------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    v = centres[np.arange(500) % 12] + 0.08 * rng.normal(size=(500, 16))
    v[100:260] = v[100]                      # very many equal vectors
    v[7], v[8] = 0.0, v[9] * 1e-9            # no direction, and a very short vector
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, vec array<double>").cache()


@pytest.mark.parametrize("least,k", [(0.8, 30), (0.95, 400), (0.5, 5), (1.0, 500), (-0.2, 9)])
def test_pivots_give_the_full_product(clustered, least, k):
    _, df = clustered
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    got = P.nearest_above(q, df, k, least, ["qid"], "id", not_same="qid")
    full = V.topk(q, df, k, ["qid"], "id", not_same="qid").where(F.col("score") >= least)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
    assert got.columns == full.columns


def test_blocks_are_left_out(clustered):
    _, df = clustered
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    pivots = P.draw_pivots(df, "id", "vec", 13)
    assert 5 < len(pivots) <= 13
    a, b = P.cell_pairs(q, df, ["qid"], "id", "qvec", "vec", 0.8, pivots)
    blocks_q, blocks_r = a.select("_qb").distinct().count(), b.select("_rb").distinct().count()
    met = a.select("_qb", "_rb").distinct().join(b.select("_qb", "_rb").distinct(), ["_qb", "_rb"]).count()
    assert met < 0.5 * blocks_q * blocks_r
    assert a.count() < 0.5 * 500 * blocks_r and b.count() < 0.5 * 500 * blocks_q
    assert b.groupBy("_rb").agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0] < 100  # 160 equal vectors are dealt out


@pytest.mark.parametrize("least,k", [(0.2, 30), (0.2, 3), (0.6, 500)])
def test_vectors_far_from_each_other_meet_in_few_long_blocks(spark, monkeypatch, least, k):
    monkeypatch.setattr(V, "LONG_BLOCK", 160)
    v = np.random.default_rng(5).normal(size=(400, 24))
    v[11], v[12] = 0.0, v[13]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, vec array<double>")
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    pivots = P.draw_pivots(df, "id", "vec", 40)
    assert P.cell_pairs(q, df, ["qid"], "id", "qvec", "vec", 0.2, pivots) is None      # 1,600 pairs of cells otherwise
    full = V.topk(q, df, k, ["qid"], "id", not_same="qid").where(F.col("score") >= least)
    assert sorted(map(tuple, P.nearest_above(q, df, k, least, ["qid"], "id", not_same="qid").collect())) == sorted(map(tuple, full.collect()))


def test_pivots_of_nothing(spark, clustered):
    _, df = clustered
    none = df.where("id < 0")
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    assert P.nearest_above(q, none, 3, 0.5, ["qid"], "id").count() == 0
    assert P.nearest_above(q.where("qid < 0"), df, 3, 0.5, ["qid"], "id").count() == 0
    zeros = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(90)], "id int, vec array<double>")
    assert P.nearest_above(zeros.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), zeros, 3, 0.5, ["qid"], "id").count() == 0


def test_names_as_ids(spark):
    rows = [(f"name{i:03d}", [float(i % 5 == j) for j in range(5)]) for i in range(120)]
    df = spark.createDataFrame(rows, "e string, vec array<double>")
    got = N.synonym_edges(df, "e", least=0.9)
    assert got.count() == 120 * 23 and got.where("src = dst").count() == 0


# ---- late interaction ----------------------------------------------------------------------------
def maxsim_by_hand(q, p, k):
    out = {}
    for qid in {x[0] for x in q}:
        scores = {}
        for name in {x[0] for x in p}:
            rows = np.array([x[2] for x in p if x[0] == name])
            scores[name] = round(sum(round(float((rows @ np.array(x[2])).max()), 9) for x in q if x[0] == qid), 9)
        out[qid] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.fixture(scope="module")
def tokens(spark):
    rng = np.random.default_rng(6)
    q = [(i, t, rng.normal(size=6).round(2).tolist()) for i in range(40) for t in range(1 + i % 9)]
    p = [(f"p{i:02d}", i * 1000 + j, (rng.normal(size=6) * (0.3 if i == 3 else 1)).round(2).tolist()) for i in range(30) for j in range(150 if i < 5 else 1 + i % 7)]
    return q, p, spark.createDataFrame(q, "qid int, token int, qvec array<double>"), spark.createDataFrame(p, "passage string, row_id int, vec array<double>")


@pytest.mark.parametrize("oversize", [10000, 20])
def test_maxsim_of_whole_and_dealt_passages(tokens, oversize):
    q, p, dq, dp = tokens
    want = maxsim_by_hand(q, p, 4)
    got = N.maxsim(dq, dp, 4, oversize=oversize).toPandas()
    for qid, best in want.items():
        own = got[got.qid == qid].sort_values("rank")
        assert own["passage"].tolist() == [n for n, _ in best]
        assert np.allclose(own["score"], [s for _, s in best], atol=2e-8)


def test_maxsim_shuffles_scores_of_passages_only(tokens):
    _, _, dq, dp = tokens
    plan = N.maxsim(dq, dp, 4)._jdf.queryExecution().executedPlan().toString()
    after = plan[:plan.index("CoGroup")]
    assert after.count("Exchange") == 1 and "token" not in after.split("Exchange")[1].split("\n")[0]


def test_hopeless_large_passages_are_not_multiplied(tokens, monkeypatch):
    _, p, dq, dp = tokens
    asked = []
    whole = N._piece_maxima

    def watched(queries, pieces, hopeful, *rest):
        asked.append({(r[0], r[1]) for r in hopeful.collect()})
        return whole(queries, pieces, hopeful, *rest)

    monkeypatch.setattr(N, "_piece_maxima", watched)
    # A large passage of short vectors cannot be among the best of a query with many good small ones.
    N.maxsim(dq, dp.where("passage = 'p03' or passage >= 'p05'"), 1, oversize=20).collect()
    assert len(asked[0]) < 40 * 0.6


def test_sums_of_dealt_passages_start_no_python_per_group(spark):
    rows = [(1, "a", [0.5, 3.0]), (1, "a", [2.0, -1.0]), (1, "b", [0.25, 0.25]), (2, "a", [-1.0])]
    got = N._summed_maxima(spark.createDataFrame(rows, "qid int, passage string, best array<double>"), "qid", "passage")
    assert "InArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "a", 5.0), (1, "b", 0.5), (2, "a", -1.0)]


@pytest.mark.parametrize("strip", [1, 7, 64, 1000])
def test_passages_cut_by_strips(monkeypatch, strip):
    monkeypatch.setattr(V, "STRIP", strip)
    rng = np.random.default_rng(8)
    left, right, names = rng.normal(size=(9, 5)), rng.normal(size=(150, 5)), np.array([0, 1, 7, 8, 64, 140])
    assert np.allclose(N._passage_maxima(left, right, names), np.maximum.reduceat(left @ right.T, names, axis=1))


def test_passages_of_a_block_of_rows_are_not_dealt(spark, monkeypatch):
    monkeypatch.setattr(N, "_piece_maxima", lambda *_: pytest.fail("dealt"))
    p = spark.range(9000).selectExpr("'p' as passage", "id as row_id", "array(cast(id as double), -1.0D) as vec")
    q = spark.createDataFrame([(1, 0, [1.0, 0.5]), (1, 1, [-1.0, 1.0])], "qid int, token int, qvec array<double>")
    assert [tuple(r) for r in N.maxsim(q, p, 2).collect()] == [(1, "p", 8997.5, 1)]
