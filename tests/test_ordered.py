"""Ordered operators against pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import ordered as O
from chronoloom.operators import selection as S
from chronoloom.operators import sequences as Q
from chronoloom.operators import windows as W


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n)),
                        "v": rng.integers(0, 40, n), "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_row_numbers_and_running(spark, rows, partitions):
    pdf, df = rows
    want = pdf.sort_values(["k", "v", "id"]).copy()
    want["rn"] = want.groupby("k").cumcount() + 1
    want["total"] = want.groupby("k")["v"].cumsum()
    want["top"] = want.groupby("k")["v"].cummax()
    c = O.chunked(df, ["k"], ["v", "id"], partitions)
    got = O.running_over(O.number_over(c, ["k"], ["v", "id"]), ["k"], ["v", "id"],
                         {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}).toPandas()
    got = got.sort_values(["k", "v", "id"])
    for col in ("id", "rn", "total", "top"):
        assert got[col].tolist() == want[col].tolist()


def test_descending_order(rows):
    pdf, df = rows
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("k").head(3)
    got = O.row_numbers(df, ["k"], [F.desc("v"), "id"]).where("rn <= 3").toPandas()
    assert sorted(got["id"]) == sorted(want["id"])


@pytest.mark.parametrize("partitions", [1, 5])
def test_lag_crosses_chunks(rows, partitions):
    pdf, df = rows
    want = pdf.sort_values(["k", "v", "id"])
    want = want.assign(p=want.groupby("k")["id"].shift())
    c = O.chunked(df, ["k"], ["v", "id"], partitions)
    got = O.lag_over(c, ["k"], ["v", "id"], {"p": F.col("id")}).toPandas().sort_values(["k", "v", "id"])
    assert got["p"].fillna(-1).tolist() == want["p"].fillna(-1).tolist()


def test_percentiles(rows):
    pdf, df = rows
    got = {r["k"]: (r["m"], r["q"]) for r in O.exact_percentile(df, ["k"], "v", 0.5, "m").join(
        O.exact_percentile(df, ["k"], "v", 0.9, "q"), "k").collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == (pytest.approx(g["v"].quantile(0.5)), pytest.approx(g["v"].quantile(0.9)))
    up = {r["k"]: r["m"] for r in O.upper_median(df, ["k"], "v", "m").collect()}
    for k, g in pdf.groupby("k"):
        assert up[k] == sorted(g["v"])[len(g) // 2]


def sequential_windows(starts, width):
    out, current = [], None
    for s in sorted(starts):
        if current is None:
            current = s
            out.append([s, 1])
        elif s < current + width:
            out[-1][1] += 1
        else:
            current = s // width * width
            out.append([current, 1])
    return [tuple(x) for x in out]


def test_multiscale_closed_form(spark):
    rng = np.random.default_rng(1)
    streams = {f"s{i}": sorted(rng.choice(5000, 25, replace=False).tolist()) for i in range(12)}
    streams["edge"] = [40183, 40183 + 180, 40320, 40500, 44000]      # unaligned start, item on an edge, a gap
    pdf = pd.DataFrame([(k, s, i, f"t{i}", None) for k, v in streams.items() for i, s in enumerate(v)],
                       columns=["stream", "start_sec", "item_id", "text", "path"])
    df = spark.createDataFrame(pdf, "stream string, start_sec bigint, item_id bigint, text string, path string")
    got = W.scale_windows(df, ["stream"], 180).toPandas()
    for k, v in streams.items():
        mine = got[got["stream"] == k].sort_values("start_sec")
        assert list(zip(mine["start_sec"], mine["n_items"])) == sequential_windows(v, 180)
    text = got[got["stream"] == "edge"].sort_values("start_sec")["text"].iloc[0]
    assert text.split("\n")[0] == "t0"


def test_frame_fold_is_not_a_mean(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 1), (1, 1, 1.0, 1.0, 2), (1, 2, 1.0, 0.0, 3)], "f int, sid int, x double, y double, kind int")
    r = W.frame_samples(df, ["f"], "sid").first()
    assert (r["x"], r["y"], r["kind"]) == (0.75, 0.25, 3)


@pytest.mark.parametrize("n,cap", [(5, 8), (100, 8), (33, 32), (7, 1), (64, 63)])
def test_thin_matches_linspace(spark, n, cap):
    df = spark.range(n).withColumn("k", F.lit("x"))
    got = sorted(r["id"] for r in S.thin(df, ["k"], ["id"], cap).collect())
    want = list(range(n)) if n <= cap else sorted(set(np.linspace(0, n - 1, cap, dtype=int).tolist()))
    assert got == want


def test_mixture_stops(spark):
    pdf = pd.DataFrame([("a", i) for i in range(30)] + [("b", 100 + i) for i in range(7)], columns=["src", "id"])
    df = spark.createDataFrame(pdf)
    first = S.mixture(df, "src", "id", {"a": 3, "b": 1}, 2, "s").toPandas()
    assert not first.duplicated(["src", "id"]).any()
    assert (first.groupby("slot")["src"].nunique() == 1).all()
    whole = S.mixture(df, "src", "id", {"a": 3, "b": 1}, 2, "s", "all_exhausted").toPandas()
    assert set(zip(whole["src"], whole["id"])) == set(zip(pdf["src"], pdf["id"]))


def test_episode_rule_compares_with_previous_row(spark):
    data = [("c", i, float(t), t + 0.5, x, 0.0, o, ["p"], f"cap{i}") for i, (t, x, o) in enumerate(
        [(0, 0.0, "cup"), (1, 40.0, "pan"), (2, 80.0, "pan"), (3, 85.0, "cup"), (10, 86.0, "jar")])]
    df = spark.createDataFrame(data, "clip string, fixation_id int, start double, end double, cx double, cy double, "
                                     "object string, others array<string>, caption string")
    got = Q.episodes(df, "clip", 50.0, 2.0).orderBy("episode").collect()
    assert [r["fixation_ids"] for r in got] == [[0, 1, 2, 3], [4]]
    assert got[0]["object"] == "cup" and got[0]["captions"][0] == "cap0"


def test_holm_and_average_ranks(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "k string, p double")
    got = {r["k"]: round(r["p_holm"], 6) for r in Q.holm(p, "p", "k").collect()}
    assert got == {"a": 0.04, "b": 0.09, "c": 0.09, "d": 0.5}
    v = spark.createDataFrame([(1, x) for x in (5, 7, 7, 9)], "g int, v int")
    assert {r["v"]: r["avg_rank"] for r in Q.average_ranks(v, ["g"], "v").collect()} == {5: 1.0, 7: 2.5, 9: 4.0}


def test_scales_at_once_equal_scales_in_turn(spark):
    import random
    rnd = random.Random(2)
    rows = [(i % 3, rnd.choice([None, rnd.randrange(40, 9000)]) if i % 11 == 0 else rnd.randrange(40, 9000), f"i{i:03d}",
             rnd.choice([None, f"t{i}"]), f"p{i}") for i in range(200)] + [(3, 17, "x", None, "p"), (3, 17, "w", None, "q")]
    df = spark.createDataFrame(rows, "stream int, start_sec bigint, item_id string, text string, path string")
    scales = (70, 300, 900, 4000)
    at_once = W.multiscale(df, ["stream"], scales)
    in_turn = W.multiscale(df, ["stream"], scales, summary=lambda text: text)
    columns = sorted(at_once.columns)
    def listed(out):
        return sorted(map(repr, out.select(*columns).collect()))
    assert sorted(in_turn.columns) == columns and listed(at_once) == listed(in_turn)
    # The first grouping of items, the starts, and all scales: three exchanges however many scales there are.
    assert at_once._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 3
