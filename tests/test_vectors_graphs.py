"""Blocked scoring, ranking studies, graph loops and near-duplicate removal against plain Python."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import dedup as D
from chronoloom.operators import graph as P
from chronoloom.operators import graph_build as B
from chronoloom.operators import incremental as I
from chronoloom.operators import metrics as M
from chronoloom.operators import neighbours as N
from chronoloom.operators import vectors as X


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5)).round(2)
    v[10] = v[11] = v[12]                      # equal vectors tie
    df = spark.createDataFrame([(i, v[i].tolist(), i * 3) for i in range(60)], "id bigint, vec array<float>, te bigint")
    return v.astype(np.float32).astype(float), df


@pytest.mark.parametrize("unit,qb,rb", [(True, 1024, 32768), (False, 7, 9)])
def test_topk_any_block_layout(monkeypatch, table, unit, qb, rb):
    monkeypatch.setattr(X, "QUERY_BLOCK", qb)
    monkeypatch.setattr(X, "ROW_BLOCK", rb)
    monkeypatch.setattr(X, "SLICE", 3)
    v, df = table
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), (F.col("te") + 40).alias("at"))
    got = X.topk(q, df, 4, ["qid"], "id", unit=unit, before=("at", "te"), not_same="qid").toPandas()
    w = v / np.linalg.norm(v, axis=1, keepdims=True) if unit else v
    s = np.round(w @ w.T, 9)
    for i in range(60):
        pool = [j for j in range(60) if j != i and j * 3 <= i * 3 + 40]
        want = sorted(pool, key=lambda j: (-s[i, j], j))[:4]
        assert got[got.qid == i].sort_values("rank")["id"].tolist() == want


def test_counts_give_ranks(table):
    v, df = table
    w = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(w @ w.T, 9)
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")).join(
        df.select(F.col("id").alias("g"), F.col("vec").alias("gv")), F.expr("g = (qid + 1) % 60"))
    q = q.withColumn("cut", F.round(X.cosine("qvec", "gv"), 9))
    got = {r["qid"]: (r["n_better"], r["n_seen"]) for r in X.count_better(q, df, ["qid"], "id", "cut", "g").collect()}
    for i in range(60):
        order = sorted(range(60), key=lambda j: (-s[i, j], j))
        assert got[i] == (order.index((i + 1) % 60), 60)


def test_own_text_is_always_found(spark):
    """A caption searched with its own text must come first."""
    from chronoloom import hooks
    docs = spark.createDataFrame([(i, f"entry {i} about thing{i * 7} and place{i * 13}") for i in range(96)], "id bigint, t string")
    e = hooks.encode(docs, "t")
    hits = X.topk(e.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), e, 1, ["qid"], "id")
    assert hits.where("qid = id").count() == 96


def test_scaled_constant_is_one(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, qvec array<float>")
    r = spark.createDataFrame([(1, [2.0, 1.0]), (2, [2.0, 5.0])], "id bigint, vec array<float>")
    assert [x["scaled"] for x in X.dense_retrieval(q, r, 5, ["qid"], "id").collect()] == [1.0, 1.0]


def test_synonyms_test_only_the_source_name(spark):
    df = spark.createDataFrame([("ab", [1.0, 0.0]), ("abc", [1.0, 0.0]), ("", [1.0, 0.0]), ("xyz", [0.0, 1.0])], "e string, vec array<float>")
    assert sorted((r["src"], r["dst"]) for r in N.synonym_edges(df, "e").collect()) == [("abc", "ab")]


def test_maxsim(spark):
    rng = np.random.default_rng(4)
    q, p = rng.normal(size=(3, 4, 3)), rng.normal(size=(5, 6, 3))
    dq = spark.createDataFrame([(i, j, q[i, j].tolist()) for i in range(3) for j in range(4)], "qid bigint, token bigint, qvec array<double>")
    dp = spark.createDataFrame([(i, i * 6 + j, p[i, j].tolist()) for i in range(5) for j in range(6)], "passage bigint, row_id bigint, vec array<double>")
    got = {(r["qid"], r["passage"]): r["score"] for r in N.maxsim(dq, dp, 5).collect()}
    for i in range(3):
        for k in range(5):
            assert got[(i, k)] == pytest.approx((q[i] @ p[k].T).max(axis=1).sum(), abs=1e-6)


def test_two_rules_for_empty_gold(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "qid bigint, rid bigint, rank int")
    gold = spark.createDataFrame([(1, 11, 2)], "qid bigint, rid bigint, rel int")
    assert {r["k"]: r["recall"] for r in M.recall_at(hits, gold, (1, 2)).collect()} == {1: 0.0, 2: 0.5}
    both = spark.createDataFrame([(1,), (2,)], "qid bigint")
    r = M.ranking_metrics(hits, gold, both, (2,)).first()
    assert (r["recall"], r["hit"], r["precision"], r["map"], r["mrr"]) == (1.0, 0.5, 0.25, 0.25, 0.25)
    assert r["ndcg_linear"] == pytest.approx((1 / np.log2(3)) / 2, abs=1e-6)


def numpy_ppr(n, edges, reset, damping, steps=300):
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] += x
    out = w.sum(axis=1)
    r = reset / reset.sum()
    p = r.copy()
    for _ in range(steps):
        moved = sum(p[i] * w[i] / out[i] for i in range(n) if out[i] > 0)
        lone = sum(p[i] for i in range(n) if out[i] == 0)
        p = damping * moved + (1 - damping + damping * lone) * r
    return p


@pytest.mark.parametrize("damping", [0.5, 0.85])
def test_pagerank(spark, damping):
    rng = random.Random(1)
    n = 14                                           # node 13 has no edges but is a seed
    und = [(rng.randrange(13), rng.randrange(13), rng.choice([1.0, 2.5])) for _ in range(24)]
    edges = [(a, b, w) for a, b, w in und if a != b] + [(b, a, w) for a, b, w in und if a != b]
    resets = {1: np.array([1.0] + [0] * 12 + [1.0]), 2: np.array([0, 2.0, 1.0] + [0] * 11)}
    de = spark.createDataFrame([(f"n{a}", f"n{b}", w) for a, b, w in edges], "src string, dst string, weight double")
    dr = spark.createDataFrame([(q, f"n{i}", float(m)) for q, r in resets.items() for i, m in enumerate(r)]
                               + [(1, "n5", float("nan")), (2, "n6", -3.0)], "qid int, node string, mass double")
    got = {(r["qid"], r["node"]): r["score"] for r in P.personalized_pagerank(de, dr, damping, steps=150, tol=1e-8, cut_every=10).collect()}
    for q, r in resets.items():
        want = numpy_ppr(n, edges, r, damping)
        for i in range(n):
            assert got.get((q, f"n{i}"), 0.0) == pytest.approx(want[i], abs=1e-6)


def test_triples_without_entities_keep_the_similar_ones(spark):
    t = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "", "")], "tid bigint, s string, o string")
    sim = spark.createDataFrame([(7, 1, 0.9), (8, 3, 0.4)], "qid bigint, tid bigint, score double")
    got = {(r["qid"], r["tid"], r["source"]) for r in P.triples_by_ppr(t, sim, 2, steps=20, tol=0).collect()}
    assert got == {(7, 1, "walk"), (7, 2, "walk"), (8, 3, "similar")}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(0, i) for i in range(90, 110)] + [(i, i + 1) for i in range(200, 225)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in P.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def brute_signature(text, a, b):
    words = re.split("[^A-Za-z_0-9]", text)
    grams = {" ".join(words[i:i + 5]) for i in range(len(words) - 4)}
    hashes = [int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams]
    return [min(((h * int(x) + int(y)) % 2**64) % (2**61 - 1) & 0xFFFFFFFF if h * int(x) < 2**64 else
                ((h * int(x)) % 2**64 + int(y)) % 2**64 % (2**61 - 1) & 0xFFFFFFFF for h in hashes) for x, y in zip(a, b)]


def test_minhash_against_plain_python(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(8)]
    texts = base + [base[0], base[1].replace(base[1].split()[100], "changed", 1), "a b", "c d", "e"] + [base[2]] * 20
    docs = pd.DataFrame({"idx": range(len(texts)), "content": texts})
    a, b = D.coefficients()
    sigs = {i: brute_signature(t, a, b) for i, t in enumerate(texts) if len(re.split("[^A-Za-z_0-9]", t)) >= 5}
    for i in (0, 3):
        packed = spark.createDataFrame([(texts[i],)], "t string").select(D.token_hashes(F.col("t"), 5).alias("h")).first()["h"]
        assert D.signature(np.frombuffer(packed, dtype="<u4").astype(np.uint64), a, b).tolist() == sigs[i]
    parent = {i: i for i in sigs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sigs:
        for j in sigs:
            if i < j and any(sigs[i][k * 10:k * 10 + 10] == sigs[j][k * 10:k * 10 + 10] for k in range(25)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = sorted([i for i in sigs if find(i) == i] + [i for i in range(len(texts)) if i not in sigs])
    got = sorted(r["idx"] for r in D.deduplicate(spark.createDataFrame(docs), "idx", "content").collect())
    assert got == want and {8, 9}.isdisjoint(got) and {10, 11, 12} <= set(got)


def test_edges_count_both_ways_and_skip_loops(spark):
    t = spark.createDataFrame([(1, "A", "likes", "B"), (2, "a", "sees", "b"), (2, "b", "is", "B")], "doc bigint, s string, p string, o string")
    got = {(r["src"], r["dst"]): r["weight"] for r in B.fact_edges(B.normalized(t)).collect()}
    assert got == {("a", "b"): 2.0, ("b", "a"): 2.0}


def test_add_then_delete_restores_the_first_state(spark):
    old = [(1, "montebello", "part of", "rockland county"), (2, "oliver badman", "is a", "politician")]
    new = [(3, "tom hort", "is", "singer"), (3, "montebello", "near", "tom hort")]
    t = spark.createDataFrame(old + new, "doc bigint, s string, p string, o string")
    gone = spark.createDataFrame([(3,)], "doc bigint")
    parts = I.delete_tables(t, gone)
    assert sorted(tuple(r) for r in parts["triples"].collect()) == sorted(old)
    assert {r["entity"] for r in parts["entities_gone"].collect()} == {"tom hort", "singer"}
    assert parts["facts_gone"].count() == 2
