"""Counts, nearest spans and texts of intervals without shuffled pairs, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import intervals as I
from chronoloom.operators import lookups as L


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    points = [(i, "ab"[i % 2], int(rng.integers(-30, 400)) if i % 29 else None) for i in range(300)]
    spans = [(i, "ab"[int(rng.integers(0, 2))], int(s), int(s + (250 if i % 40 == 0 else rng.integers(0, 25))), int(rng.integers(0, 9)))
             for i, s in enumerate(rng.integers(0, 380, 250))]
    return (points, spans, spark.createDataFrame(points, "qid bigint, g string, p bigint"),
            spark.createDataFrame(spans, "sid bigint, g string, lo bigint, hi bigint, v int"))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_counts_of_meeting_spans(data, by):
    points, spans, dp, ds = data
    out = I.meeting_counts(dp, ds, "p", ("lo", "hi"), {"n": (40, F.lit(True)), "near": (7, F.lit(True)), "odd": (40, F.col("v") % 2 == 1)}, by)
    got = {(r["g"] if by else None, r["p"]): (r["n"], r["near"], r["odd"]) for r in out.collect()}
    want = {}
    for _, g, p in points:
        if p is not None:
            mine = [s for s in spans if not by or s[1] == g]
            met = lambda tol, ok=lambda s: True: sum(s[2] <= p + tol and s[3] >= p - tol and ok(s) for s in mine)
            want[(g if by else None, p)] = (met(40), met(7), met(40, lambda s: s[4] % 2 == 1))
    assert got == want


@pytest.mark.parametrize("by", [[], ["g"]])
def test_nearest_spans(data, by):
    points, spans, dp, ds = data
    got = {r["qid"]: (r["sid"], r["distance"], r["offset"]) for r in L.nearest_span(
        dp, ds if by else ds.drop("g"), "p", ("lo", "hi"), "qid", "sid", 6, 20, by).collect()}
    for i, g, p in points:
        near = [] if p is None else sorted((max(lo - p, p - hi, 0), sid, min(max(p - lo, 0), hi - lo)) for sid, h, lo, hi, _ in spans
                                           if (not by or g == h) and max(lo - p, p - hi, 0) <= 6)
        assert got.get(i) == ((near[0][1], near[0][0], near[0][2]) if near else None)


@pytest.mark.parametrize("listed,strict", [(16384, False), (3, False), (3, True)])
def test_texts_of_segments(monkeypatch, data, listed, strict):
    """Full buckets and segments longer than the width go other ways to the same texts."""
    monkeypatch.setattr(L, "LISTED", listed)
    points, spans, dp, ds = data
    segs = dp.withColumn("until", F.col("p") + F.when(F.col("qid") % 10 == 0, 90).otherwise(12))
    text = F.when(F.col("v") > 0, F.concat(F.lit("t"), F.col("v").cast("string")))
    got = {r["qid"]: r["texts"] for r in L.attach_texts(segs, ds, ("p", "until"), ("lo", "hi"), ["qid"], ["lo", "sid"], text, 20, ["g"], strict).collect()}
    for i, g, p in points:
        end = None if p is None else p + (90 if i % 10 == 0 else 12)
        met = [] if p is None else sorted((lo, sid, f"t{v}") for sid, h, lo, hi, v in spans if g == h and v > 0 and (
            (p < hi and end > lo) if strict else (p <= hi and end >= lo)))
        assert got[i] == [x[2] for x in met]


def test_questions_of_one_moment_are_counted_once(spark):
    """No join of points and spans, and one bucket of the look-back for each query beside its own."""
    p = spark.range(500).select(F.col("id").alias("qid"), (F.col("id") % 5).alias("p"))
    s = spark.createDataFrame([(1, 0, 9)], "sid int, lo bigint, hi bigint")
    assert I.meeting_counts(p, s, "p", ("lo", "hi"), {"n": (2, F.lit(True))}).count() == 5
    assert "_b" not in joins(I.meeting_counts(p, s, "p", ("lo", "hi"), {"n": (2, F.lit(True))}))
    plan = I.visible_join(p, s, "p", "hi", 10.0, 1000.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "/ 1000.0" in plan and "/ 10.0" not in plan
