"""Readers by name."""

import pytest

from chronoloom.sources import readers


def test_readers_by_name(spark, tmp_path):
    (tmp_path / "A_07000000.srt").write_text("1\n00:00:05,120 --> 00:00:07,500\nhello there\n")
    got = readers.read(spark, "srt", str(tmp_path))
    assert got.columns == readers.READERS["srt"](spark, str(tmp_path)).columns and got.count() == 1
    with pytest.raises(KeyError, match="gaze_csv"):
        readers.read(spark, "nothing")


def test_a_name_is_taken_once(spark, monkeypatch):
    monkeypatch.setattr(readers, "READERS", dict(readers.READERS))
    readers.register("numbers", lambda s, n: s.range(n))
    assert readers.read(spark, "numbers", 3).count() == 3
    with pytest.raises(ValueError):
        readers.register("numbers", lambda s: s.range(1))
