"""Large JSON files split over tasks give the rows of the whole file."""

import json
import random

import pytest

from chronoloom.sources import captions
from chronoloom.sources.json_split import members, pieces


@pytest.fixture
def tiny_splits(spark):
    """Splits of 97 bytes, so that braces, quotes and escapes fall on the edges of blocks."""
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "97")
    yield
    spark.conf.set(name, old)


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "界", "a ", "\\\"}", "😀"]) for _ in range(rng.randrange(12)))


def odd_object(rng, depth=2):
    out = {}
    for _ in range(rng.randrange(4)):
        deep = depth and rng.random() < 0.4
        out[odd_text(rng) + str(len(out))] = rng.choice([odd_object(rng, depth - 1), [odd_object(rng, depth - 1), []]]) if deep else odd_text(rng)
    return out


@pytest.mark.parametrize("indent", [None, 1])
def test_array_members(spark, tmp_path, tiny_splits, indent):
    rng = random.Random(3)
    lists = {f"f{i}.json": [odd_object(rng) for _ in range(n)] for i, n in enumerate((0, 1, 2, 60))}
    for name, items in lists.items():
        (tmp_path / name).write_text(json.dumps(items, indent=indent, ensure_ascii=bool(indent)) + "\n" * rng.randrange(2), encoding="utf-8")
    parts = pieces(spark, str(tmp_path))
    assert parts.rdd.getNumPartitions() > 8 and parts.where("file LIKE '%f3.json'").select("block").distinct().count() > 8
    got = {}
    for r in members(parts, ["file"], "array").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.pos] = json.loads(r.value)
    assert got == {name: dict(enumerate(items)) for name, items in lists.items() if items}


@pytest.mark.parametrize("indent", [None, 2])
def test_map_members(spark, tmp_path, tiny_splits, indent):
    rng = random.Random(5)
    maps = {f"m{i}.json": {odd_text(rng) + str(j): odd_object(rng) for j in range(n)} for i, n in enumerate((0, 1, 40))}
    for i, (name, items) in enumerate(maps.items()):
        (tmp_path / name).write_text(json.dumps(items, indent=indent) + "\n" * (i % 2), encoding="utf-8")
    got = {}
    for r in members(pieces(spark, str(tmp_path)), ["file"], "map").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {}).update(json.loads("{" + r.value + "}"))
    assert got == {name: items for name, items in maps.items() if items}


@pytest.mark.parametrize("kind, text", [
    ("array", '[{"a": 1}, {"a": 2}'), ("array", '[{"a": 1}, {"a"'), ("array", '[{"a": "x}'), ("array", '[{"a": 1} {"a": 2}]'),
    ("array", '[1, {"a": 1}]'), ("array", '{"a": 1}'), ("array", "no json"), ("array", '[{"a": 1}]]'), ("array", '[{"a": 1}, 3]'),
    ("map", '{"k": {"a": 1}, '), ("map", '{"k": {"a": 1}'), ("map", '{"k": {"a": [1}}'), ("map", '{"k": 1, "l": {"a": 1}}'), ("map", '[{"a": 1}]'),
])
def test_malformed_files_are_named(spark, tmp_path, kind, text):
    (tmp_path / "bad.json").write_text(text)
    reader = members(pieces(spark, str(tmp_path)), ["file"], kind)
    with pytest.raises(Exception, match="bad.json"):
        if kind == "array":
            reader.collect()
        else:
            captions.read_snapshots(spark, str(tmp_path)).collect()


def test_captions_of_one_file_in_many_tasks(spark, tmp_path, tiny_splits):
    rng = random.Random(8)
    rows = [{"text": odd_text(rng), "start_time": f"{i:08d}", "end_time": "x", "date": "DAY1", "video_path": "{"} for i in range(80)]
    (tmp_path / "all.json").write_text(json.dumps(rows))
    got = captions.read_captions(spark, {"30sec": str(tmp_path), "whatever": str(tmp_path / "none")})
    assert got.columns == ["file", "granularity", "pos", "id", "text", "start_time", "end_time", "date", "video_path"]
    assert {(r.id, r.text, r.start_time) for r in got.collect()} == {(f"30sec_{i}", r["text"], r["start_time"]) for i, r in enumerate(rows)}


def test_snapshots_of_several_files(spark, tmp_path, tiny_splits):
    for day in range(1, 5):
        snapshot = {str(day * 1000 + i): {"consolidated_semantic_triples": [["a", "b}", str(j)] for j in range(3)] + [["x", "y"]]} for i in range(day)}
        (tmp_path / f"{day}.json").write_text(json.dumps(snapshot) + "\n")
    got = {(r.ts, r.id, r.s, r.p, r.o) for r in captions.read_snapshots(spark, str(tmp_path)).collect()}
    stamps = [day * 1000 + i for day in range(1, 5) for i in range(day)]
    assert got == {(t, f"semantic_{t}_{j}", "a", "b}", str(j)) for t in stamps for j in range(3)}
