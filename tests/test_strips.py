"""The kernel of the vector searches works in strips: equal results, little memory, every pair multiplied once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import vectors as V


def _tables(n_q, n_r, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    q, r = rng.normal(size=(n_q, dim)).round(1), rng.normal(size=(n_r, dim)).round(1)
    r[: n_r // 3] = r[n_r // 3: 2 * (n_r // 3)]                       # copies tie
    ids = rng.permutation(n_r)
    return (q, r, ids, pa.table({"qid": pa.array(range(n_q)), "qvec": pa.array(q.tolist())}),
            pa.table({"rid": pa.array(ids), "vec": pa.array(r.tolist())}))


@pytest.mark.parametrize("k", [1, 5, 40])
def test_strips_give_the_full_product(monkeypatch, k):
    monkeypatch.setattr(V, "STRIP", 16)
    monkeypatch.setattr(V, "SLICE", 7)
    q, r, ids, tq, tr = _tables(30, 300)
    got = V.best_in_block(tq, tr, ["qid"], "rid", k, "qvec", "vec", False, ends=True).to_pandas()
    tied = V.best_in_block(tq, tr, ["qid"], "rid", k, "qvec", "vec", False, ties=True).to_pandas()
    s = np.round(q @ r.T, 9) + 0.0
    for i in range(30):
        order = sorted(range(300), key=lambda j: (-s[i, j], ids[j]))
        mine = got[got.qid == i]
        assert mine.rid.tolist() == [ids[j] for j in order[:k]]
        assert set(mine.lo) == {s[i].min()} and set(mine.hi) == {s[i].max()}
        assert sorted(tied[tied.qid == i].rid) == sorted(ids[j] for j in order if s[i, j] >= s[i, order[k - 1]])


def test_a_full_block_takes_little_memory():
    """The product of one slice with a whole block of rows would take 67 MB, and each of its copies as much again."""
    _, _, _, tq, tr = _tables(V.SLICE, V.ROW_BLOCK)
    tracemalloc.start()
    V.best_in_block(tq, tr, ["qid"], "rid", 10, "qvec", "vec", True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_retrieval_multiplies_once(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(50)], "qid bigint, qvec array<double>")
    out = V.dense_retrieval(v, v.select(F.col("qid").alias("rid"), F.col("qvec").alias("vec")), 3, ["qid"], "rid")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups") == 1
