"""Inputs that must not be lost in silence, and stores that two runs wrote at once."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import timekeys as K
from chronoloom.operators import graph, incremental
from chronoloom.operators.store import BucketStore
from chronoloom.sources.captions import read_captions, read_snapshots, read_srt

BLOCKS = ["1\n00:00:01,000 --> 00:00:02,500\nfirst\nline", "2\n00:01:00,000 --> 00:01:01,000\nsecond"]


@pytest.mark.parametrize("end, mark", [("\n", ""), ("\r\n", ""), ("\r\n", "﻿"), ("\n", "﻿")])
def test_subtitles_with_any_line_end(spark, tmp_path, end, mark):
    (tmp_path / "a.srt").write_bytes((mark + "\n\n".join(BLOCKS) + "\n").replace("\n", end).encode())
    rows = sorted((r.start_sec, r.end_sec, [x for x in r.lines if x]) for r in read_srt(spark, str(tmp_path)).collect())
    assert rows == [(1.0, 2.5, ["first", "line"]), (60.0, 61.0, ["second"])]


def test_cut_off_json_is_reported(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "x", "start_time": "1"')
    with pytest.raises(Exception, match="malformed JSON"):
        read_captions(spark, {"30sec": str(tmp_path)}).collect()
    (tmp_path / "a.json").write_text('{"1": {"consolidated_semantic_triples": [["a", "b", "c"]')
    with pytest.raises(Exception, match="malformed JSON"):
        read_snapshots(spark, str(tmp_path)).collect()


def test_days_of_two_digits_in_chains(spark):
    row = spark.createDataFrame([("DAY11", "10000000DAY12_11000000")], "date string, time string").withColumn(
        "time_list", F.array().cast("array<string>"))
    assert len(row.select(F.explode(K.target_points("date", "time", "time_list"))).collect()) == 2


def test_doubled_cache_entries_do_not_multiply(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("hello",)], "prompt string")
    first = incremental.cached_inference(spark, rows, "prompt", path).collect()
    for _ in range(2):
        BucketStore(spark, path + "2", incremental.CACHE, "key").append(BucketStore(spark, path, incremental.CACHE, "key").rows())
    again = incremental.cached_inference(spark, rows, "prompt", path + "2").collect()
    assert len(first) == len(again) == 1 and again[0].hit and again[0].response == first[0].response


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(600)], "u int, v int")
    assert {r.component for r in graph.connected_components(edges).collect()} == {0}


def test_pagerank_reports_an_early_end(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)], "src string, dst string, weight double")
    reset = spark.createDataFrame([(1, "a", 1.0)], "qid int, node string, mass double")
    with pytest.raises(RuntimeError):
        graph.personalized_pagerank(edges, reset, 0.85, steps=10, tol=1e-12).collect()
    scores = {r.node: r.score for r in graph.personalized_pagerank(edges, reset, 0.5).collect()}
    assert scores["a"] == pytest.approx(0.5 + 0.25 * scores["b"], abs=1e-8) and sum(scores.values()) == pytest.approx(1)
