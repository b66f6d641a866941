"""Registered queries against their SQL on the smallest tables, and coverage of the inventory."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, rows_of

QUICK = ("ts_to_seconds parse_time_range target_spans answer_normalize mcq_grade_lenient openie_clean visible_join asof_snapshot "
         "overlap_join nearest_sample sync_windows exclude_seen multiscale_windows graph_edges ranking_metrics accuracy_breakdown "
         "pooled_effect rank_candidates episode_islands saccade_segments uniform_thin mixture_interleave fixation_frame_pick "
         "candidate_corpus snapshot_remove cosine_topk maxsim eval_rank watermark_index cached_inference hard_negative_mining "
         "label_contrast_pairs mcnemar_exact chance_recall src_captions src_gaze_json sink_results watermark_index_stream").split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, small, name):
    df = entry.queries()[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == rows_of(cols, res.fetchall()) and got


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["arm", "n"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partition_count_does_not_matter(spark, small):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        df = entry.queries()["row_groups"](spark, small)
        return rows_of(df.columns, [tuple(r) for r in df.collect()])

    a, b = run(2), run(9)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b
