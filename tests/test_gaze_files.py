"""Gaze documents of many recordings in few files."""

from chronoloom import catalog
from chronoloom.catalog import sources
from chronoloom.sources import gaze as Z


def test_keyed_lines_of_all_shapes(spark, tmp_path):
    lines = ['a\t{"gaze": [{"t": 1, "x": 0.25, "y": 0.5}, {"t": 2, "x": 480, "y": 360}]}', 'b\t[[3, 0.5, 0.75]]', '\t{"points": [[0.1, 2.9]]}',
             'no key and no tab', 'c\t{"samples": [{"time": 4, "gaze_x": 0.5, "gaze_y": null}, {"time": 5, "gaze_x": 0, "gaze_y": 1, "note": "\\t"}]}']
    (tmp_path / "many.txt").write_text("\n".join(lines) + "\n")
    got = Z.read_keyed_json(spark, str(tmp_path), 960, 720).collect()
    assert sorted(map(tuple, got)) == [("", 0, -1.0, 0.1 / 960, 2.9 / 720), ("a", 0, 1.0, 0.25, 0.5), ("a", 1, 2.0, 0.5, 0.5), ("b", 0, 3.0, 0.5, 0.75),
                                       ("c", 1, 5.0, 0.0, 1.0)]


def test_files_do_not_grow_with_clips(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "scratch", lambda _, name: str(tmp_path / name))
    root = "/root/testdata/sf0.01"
    n = catalog.QUERIES["src_gaze_json"](spark, root).select("clip").distinct().count()
    files = [p for p in (tmp_path / "gaze-json").rglob("part-*")]
    assert n == spark.read.parquet(f"{root}/events.parquet").select("user_id").distinct().count() > 100
    assert 0 < len(files) <= 8
