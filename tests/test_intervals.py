"""Range, tolerance, nearest and as-of joins against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import intervals as I
from chronoloom.operators import lookups as L


@pytest.fixture(scope="module")
def spans(spark):
    rng = np.random.default_rng(5)
    a = pd.DataFrame({"aid": range(120), "al": rng.integers(-50, 900, 120)})
    a["ah"] = a["al"] + rng.integers(0, 80, 120)
    b = pd.DataFrame({"bid": range(150), "bl": rng.integers(0, 900, 150)})
    b["bh"] = b["bl"] + np.where(rng.random(150) < .1, 500, rng.integers(0, 30, 150))
    return a, b, spark.createDataFrame(a), spark.createDataFrame(b)


@pytest.mark.parametrize("width", [7, 100, 5000])
@pytest.mark.parametrize("strict", [False, True])
def test_overlap(spans, width, strict):
    a, b, da, db = spans
    got = [(r["aid"], r["bid"]) for r in I.overlap_join(da, db, ("al", "ah"), ("bl", "bh"), width, strict=strict).collect()]
    m = a.merge(b, how="cross")
    m = m[(m.al < m.bh) & (m.ah > m.bl)] if strict else m[(m.al <= m.bh) & (m.ah >= m.bl)]
    assert sorted(got) == sorted(zip(m.aid, m.bid)) and len(got) == len(set(got))


def test_tolerance_closes_gaps(spark):
    clips = spark.createDataFrame([(1, 0.0, 29.0), (2, 35.0, 60.0)], "clip int, cs double, ce double")
    q = spark.createDataFrame([(9, 32.0)], "qid int, p double")
    assert I.tolerance_join(q, clips, "p", ("cs", "ce"), 0, 30).count() == 0
    assert I.tolerance_join(q, clips, "p", ("cs", "ce"), 7, 30).count() == 2


def test_nearest_span_prefers_first(spark):
    clips = spark.createDataFrame([(1, 0, 10), (2, 20, 30)], "clip int, cs int, ce int")
    q = spark.createDataFrame([(1, 15), (2, 28), (3, 60)], "qid int, p int")
    got = {r["qid"]: (r["clip"], r["distance"], r["offset"]) for r in
           L.nearest_span(q, clips, "p", ("cs", "ce"), "qid", "clip", 15, 20).collect()}
    assert got == {1: (1, 5, 10), 2: (2, 0, 8)}


def test_nearest_sample_ties_and_fallback(spark):
    s = spark.createDataFrame([("a", 1.0, .1, .1), ("a", 2.0, .9, .9), ("a", 9.0, .4, .4)], "clip string, t double, x double, y double")
    f = spark.createDataFrame([("a", 0, 1.5), ("a", 1, 5.0), ("b", 2, 1.0)], "clip string, frame_id int, ft double")
    got = {r["frame_id"]: (r["x"], r["how"]) for r in L.nearest_sample(f, s, 0.5).collect()}
    assert got == {0: (.1, "near"), 1: (.4, "median"), 2: (None, "none")}


def test_as_of_and_visible(spark):
    rng = np.random.default_rng(8)
    snaps = sorted(set(rng.integers(0, 500, 40).tolist()))
    asks = rng.integers(-20, 520, 200).tolist()
    q = spark.createDataFrame([(i, int(t)) for i, t in enumerate(asks)], "qid bigint, at bigint")
    v = spark.createDataFrame([(int(s),) for s in snaps for _ in range(3)], "snap bigint")
    got = {r["qid"]: r["as_of"] for r in I.as_of(q, v, "at", "snap").collect()}
    seen = {r["qid"]: (r["n_visible"], r["last_end"]) for r in I.visible_counts(q, v, "at", "snap").collect()}
    for i, t in enumerate(asks):
        old = [s for s in snaps if s <= t]
        assert got[i] == (max(old) if old else None)
        assert seen[i] == (3 * len(old), max(old) if old else None)


def test_visible_join_horizon(spark):
    q = spark.createDataFrame([(1, 100)], "qid bigint, at bigint")
    r = spark.createDataFrame([(i, i * 10) for i in range(15)], "rid bigint, te bigint")
    got = sorted(x["rid"] for x in I.visible_join(q, r, "at", "te", 25, 40).collect())
    assert got == [6, 7, 8, 9, 10]


def test_segments_keep_empty_ones(spark):
    lengths = spark.createDataFrame([("v", 65.0)], "video string, duration double")
    grid = L.segment_grid(lengths, ["video"], "duration", 30)
    entries = spark.createDataFrame([("v", 1, 30.0, 31.0, "b"), ("v", 0, 29.0, 30.0, "a")], "video string, id int, s double, e double, t string")
    out = L.attach_texts(grid, entries, ("seg_start", "seg_end"), ("s", "e"), ["video", "segment"], ["s", "id"], F.col("t"), 30, ["video"], strict=True)
    assert [(r["seg_end"], r["texts"]) for r in out.orderBy("segment").collect()] == [(30.0, ["a"]), (60.0, ["b"]), (65.0, [])]


def test_rebase_clock(spark):
    s = spark.createDataFrame([("a", 3.0), ("a", -1.0), ("a", 33.0), ("b", 500.0), ("b", -1.0), ("b", 510.0)], "clip string, t double")
    got = sorted((r["clip"], r["t"]) for r in L.rebase_clock(s).collect())
    assert got == [("a", -1.0), ("a", 3.0), ("a", 33.0), ("b", -1.0), ("b", 0.0), ("b", 10.0)]
