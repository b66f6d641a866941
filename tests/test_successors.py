"""Greedy walks through the successor graph against plain loops, on any block size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import stateful as S
from chronoloom.operators import successors as G


def kept_by_hand(vectors, least):
    kept, last = [], None
    for i, v in enumerate(vectors):
        if last is not None:
            size = np.sqrt((v * v).sum() * (last * last).sum())
            if size > 0 and (v * last).sum() / size >= least:
                continue
        kept.append(i)
        last = v
    return kept


@pytest.fixture(scope="module")
def videos(spark):
    rng = np.random.default_rng(8)
    out = {"one": rng.normal(size=(1, 3)), "noise": rng.normal(size=(150, 3)), "still": np.repeat(rng.normal(size=(1, 3)), 130, axis=0),
           "slow": np.array([[np.cos(i / 60), np.sin(i / 60), 0.0] for i in range(400)]), "zeros": np.zeros((20, 3))}
    out["mixed"] = np.concatenate([out["still"][:70], out["zeros"][:3], out["noise"][:40], out["slow"][:90], out["still"][70:]])
    rows = [(name, i, float(i // 2), v.tolist()) for name, vs in out.items() for i, v in enumerate(vs)]
    return out, spark.createDataFrame(rows, "video string, episode_id int, start double, vec array<double>").cache()


@pytest.mark.parametrize("block,least", [(2048, 0.9), (7, 0.9), (5, 0.2), (16, 1.0)])
def test_kept_episodes(videos, block, least):
    by_hand, df = videos
    got = S.consecutive_dedupe(df, "video", least, block).toPandas()
    for name, vectors in by_hand.items():
        assert sorted(got[got.video == name]["episode_id"]) == kept_by_hand(vectors, least), name


@pytest.mark.parametrize("block", [2048, 6])
def test_time_bins(spark, block):
    rng = np.random.default_rng(9)
    t = {k: np.sort(rng.choice(np.arange(0, 40, 0.05).round(2), n)) for k, n in (("a", 300), ("b", 1), ("c", 90))}
    xy = {k: rng.random(size=(len(v), 2)) for k, v in t.items()}
    rows = [(k, i, float(v[i]), *map(float, xy[k][i])) for k, v in t.items() for i in range(len(v))]
    got = S.path_straightness(spark.createDataFrame(rows, "k string, sid int, t double, x double, y double"), ["k"], "sid", 0.25, block)
    got = {r["k"]: (r["straightness"], r["n_bins"]) for r in got.collect()}
    for k, v in t.items():
        bins, opened = [], None
        for i, at in enumerate(v):
            if opened is None or at - opened > 0.25:
                opened = at
                bins.append([])
            bins[-1].append(xy[k][i])
        c = [np.mean(b, axis=0) for b in bins]
        path = sum(np.linalg.norm(q - p) for p, q in zip(c, c[1:]))
        want = 0.0 if len(c) < 3 else np.linalg.norm(c[-1] - c[0]) / path
        assert got[k][1] == len(c) and got[k][0] == pytest.approx(want)


def test_one_long_stream_is_many_groups(spark):
    """A single stream of 3,000 rows whose steps are 1 to 400 long, over blocks of 50."""
    rng = np.random.default_rng(10)
    following = [min(i + int(rng.choice([1, 2, 7, 400])), 3001) for i in range(1, 3001)]
    rows = [("v", i, n if n <= 3000 else None) for i, n in enumerate(following, 1)]
    df = spark.createDataFrame(rows, "k string, rn bigint, next bigint")
    at, want = 1, []
    while at <= 3000:
        want.append(at)
        at = following[at - 1]
    for block in (50, 5000):
        assert sorted(r["rn"] for r in G.reached_from_first(df, ["k"], block).collect()) == want


def test_successors_are_looked_for_in_later_blocks_only_if_needed(spark):
    df = spark.range(1, 501).select(F.lit("v").alias("k"), F.col("id").alias("rn"), (F.col("id") >= 470).alias("hit"))

    def match(a, b):
        hit = b.column("hit").to_numpy()
        return np.repeat(hit[None, :], len(a), axis=0)

    got = {r["rn"]: r["next"] for r in G.find_successors(df, ["k"], match, 20).collect()}
    assert got == {i: 470 if i < 470 else i + 1 if i < 500 else None for i in range(1, 501)}


def test_only_long_streams_go_through_the_graph(spark, monkeypatch):
    """Streams of up to a block share calls; the one of 41 rows is all that the successor search is given."""
    given = []

    def search(rows, by, match, block):
        given.append(sorted(r[by[0]] for r in rows.select(*by).distinct().collect()))
        return G.find_successors(rows, by, match, block)

    monkeypatch.setattr(S, "find_successors", search)
    sizes = {f"s{i}": 1 + i % 7 for i in range(60)} | {"edge": 40, "long": 41}
    rows = [(k, i, i * 0.1, float(i % 3), float(i % 2)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, sid int, t double, x double, y double")
    bins = {r["k"]: r["n_bins"] for r in S.path_straightness(df, ["k"], "sid", 0.25, 40).collect()}
    assert bins == {k: (n + 2) // 3 for k, n in sizes.items()}          # a bin holds 0, 0.1 and 0.2 s
    e = df.select("k", F.col("sid").alias("episode_id"), F.col("t").alias("start"), F.array("x", "y", F.lit(1.0)).alias("vec"))
    kept = S.consecutive_dedupe(e, "k", 0.999999, 40).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in kept} == sizes
    assert given == [["long"], ["long"]]


def test_short_streams_share_calls(spark):
    """2,000 streams of 1 to 5 rows, keyed by a text and a number, over batches that cut them: values below, and few calls."""
    calls = spark.sparkContext.accumulator(0)

    def match(a, b):
        calls.add(1)
        return b.column("v").to_numpy()[None, :] > a.column("v").to_numpy()[:, None]

    rng = np.random.default_rng(11)
    streams = {(f"t{i % 50}", float(i // 50)): rng.integers(0, 6, 1 + i % 5).tolist() for i in range(2000)}
    rows = [(*k, n, v) for k, vs in streams.items() for n, v in enumerate(vs)] + [(None, 1.0, 0, 3)]
    df = spark.createDataFrame(rows, "a string, b double, n int, v int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "333")
    try:
        got = {(r["a"], r["b"], r["n"]): (r["step"], r["kept"]) for r in G.walk_short(df, ["a", "b"], ["n"], match).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for k, vs in streams.items():
        last, step = -1, 0
        for n, v in enumerate(vs):
            kept = v > last
            last, step = (v, step + 1) if kept else (last, step)
            want[*k, n] = step, kept
    assert got == want and 0 < calls.value < 100
