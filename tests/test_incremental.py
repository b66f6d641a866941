"""Stores, caches, timed indexes, sequential walks, rounds and consolidation."""

import itertools
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import consolidate as C
from chronoloom.operators import incremental as I
from chronoloom.operators import rounds as R
from chronoloom.operators import stateful as S
from chronoloom.operators import stats as T
from chronoloom.session import scratch
from chronoloom.sources import captions as SC
from chronoloom.streaming.fixations import fixation_stream


def test_store_appends_only_new_texts(spark):
    path, after = scratch(spark, "t-store"), scratch(spark, "t-after")
    I.upsert(spark, path, spark.createDataFrame([("a",), ("b",), ("a",)], "t string"), "t", "chunk-")
    first = {r["hash_id"]: r["embedding"] for r in I.open_store(spark, path).collect()}
    I.upsert(spark, path, spark.createDataFrame([("b",), ("c",)], "t string"), "t", "chunk-")
    both = {r["hash_id"]: r["embedding"] for r in I.open_store(spark, path).collect()}
    assert len(first) == 2 and len(both) == 3 and all(both[k] == v for k, v in first.items())
    gone = spark.createDataFrame([(next(iter(first)),)], "hash_id string")
    I.remove(spark, path, after, gone)
    assert I.open_store(spark, after).count() == 2 and I.lookup(I.open_store(spark, path), gone).count() == 1


def test_cache_and_failures(spark):
    path = scratch(spark, "t-cache")
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "bad")], "id int, p string")

    def answer(text):
        if text == "bad":
            raise ValueError("no")
        return text * 2

    one = {r["id"]: (r["hit"], r["response"], r["error"]) for r in I.cached_inference(spark, rows, "p", path, answer=answer).collect()}
    two = {r["id"]: (r["hit"], r["response"]) for r in I.cached_inference(spark, rows, "p", path, answer=answer, waves=3).collect()}
    assert one == {1: (False, "xx", None), 2: (False, "yy", None), 3: (False, "xx", None), 4: (False, "", "ValueError: no")}
    assert two == {1: (True, "xx"), 2: (True, "yy"), 3: (True, "xx"), 4: (False, "")}


def test_index_takes_late_rows_and_never_goes_back(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id bigint, te bigint")
    index = I.TimedIndex(spark, scratch(spark, "t-index"), rows, "id", "te")
    assert index.advance(rows.where("id <> 1"), 20) and not index.advance(rows, 20) and not index.advance(rows, 5)
    assert index.advance(rows, 30)
    assert {r["id"]: r["_call"] for r in index.entries().collect()} == {2: 20, 1: 30, 3: 30}


def test_snapshots_replace(spark):
    s = spark.createDataFrame([(5, "a"), (9, "b"), (9, "c")], "ts int, x string")
    assert sorted(r["x"] for r in I.snapshot_at(s, "ts", 10).collect()) == ["b", "c"]
    assert I.snapshot_at(s, "ts", 7).first()["x"] == "a" and I.snapshot_at(s, "ts", 1).count() == 0


# --- fixations: the rule restated over lists of inliers --------------------------------------------

def plain_fixations(samples, radius=.05, least=.3, gap=.2, dropout=.4):
    """Each fixation keeps its inliers; restarted from the excursion's first sample when that lasts too long."""
    out, i, n = [], 0, len(samples)
    if not n:
        return out
    begin, inside, away = 0, [0], None

    def emit():
        t0, t1 = samples[begin][0], samples[inside[-1]][0]
        if t1 - t0 >= least:
            out.append((t0, t1, float(np.mean([samples[j][1] for j in inside])), len(inside)))

    for i in range(1, n):
        t, x, y = samples[i]
        if t - samples[i - 1][0] > dropout:
            emit()
            begin, inside, away = i, [i], None
            continue
        cx, cy = np.mean([samples[j][1] for j in inside]), np.mean([samples[j][2] for j in inside])
        if math.hypot(x - cx, y - cy) <= radius:
            inside.append(i)
            away = None
            continue
        away = i if away is None else away
        if t - samples[away][0] <= gap:
            continue
        emit()
        begin, inside = away, [away]
        near = math.hypot(x - samples[begin][1], y - samples[begin][2]) <= radius
        away = None if near else i
        if near and i != begin:
            inside.append(i)
    emit()
    return out


def clip_samples():
    rng = random.Random(9)
    steady = [(i / 10, .5, .5) for i in range(10)]
    clips = {"steady": steady,
             "flick": steady[:4] + [(.4, .8, .8), (.5, .8, .8)] + steady[6:],
             "long flick": steady[:4] + [(.4 + i / 10, .8, .8) for i in range(4)] + [(.8 + i / 10, .5, .5) for i in range(5)],
             "hole": steady[:5] + [(1.0 + i / 10, .5, .5) for i in range(5)],
             "short": steady[:2]}
    for k in range(6):
        t, rows = 0.0, []
        for _ in range(150):
            t += rng.choice([.05, .1, .1, .1, .6])
            rows.append((round(t, 3), round(.5 + rng.choice([0, 0, 0, .2]) + rng.uniform(-.03, .03), 4), round(.5 + rng.uniform(-.03, .03), 4)))
        clips[f"random {k}"] = rows
    return clips


def test_fixations_batch(spark):
    clips = clip_samples()
    pdf = pd.DataFrame([(k, i, *s) for k, v in clips.items() for i, s in enumerate(v)], columns=["clip", "sid", "t", "x", "y"])
    got = S.detect_fixations(spark.createDataFrame(pdf), min_seconds=.3).toPandas()
    for k, v in clips.items():
        want = plain_fixations(v)
        mine = got[got["clip"] == k].sort_values("start")
        assert mine["start"].tolist() == [w[0] for w in want], k
        assert mine["end"].tolist() == [w[1] for w in want] and mine["n_samples"].tolist() == [w[3] for w in want]
        assert mine["cx"].tolist() == pytest.approx([w[2] for w in want])
    count = got.groupby("clip").size().to_dict()
    assert (count["steady"], count["flick"], count["long flick"], count["hole"], count.get("short")) == (1, 1, 2, 2, None)


def test_fixations_stream_equals_batch(spark):
    """Clips that start later than others, a late sample, and a mark at the end of every clip."""
    clips = {k: v for k, v in clip_samples().items() if k.startswith("random")}
    clips |= {f"later {k}": v for k, v in clips.items()}
    names = ["clip", "sid", "t", "x", "y"]
    pdf = pd.DataFrame([(k, i, *s) for k, v in clips.items() for i, s in enumerate(v)], columns=names)
    schema = "clip string, sid bigint, t double, x double, y double"
    first = next(iter(clips))
    late = clips[first][0]
    base, out = scratch(spark, "t-gaze"), scratch(spark, "t-fix")

    def file(rows) -> None:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base)

    for later in (False, True):                            # files in time order -> micro-batches; then those of other clips from 0
        part = pdf[pdf["clip"].str.startswith("later") == later]
        for lo, hi in ((-1e9, 6.0), (6.0, 12.0), (12.0, 1e9)):
            file(part[(part.t > lo) & (part.t <= hi)])
    file([(first, 9999, float(late[0]) - 1, .5, .5)])
    file([(k, None, None, None, None) for k in clips])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)
    q = (fixation_stream(stream, min_seconds=.3).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch(spark, "t-state")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out).toPandas()
    batch = S.detect_fixations(spark.createDataFrame(pdf), min_seconds=.3).toPandas()
    assert got[got["kind"] == "late"][["clip", "start"]].values.tolist() == [[first, late[0] - 1]]
    got = got[got["kind"] == "fixation"]
    columns = ["clip", "start", "end", "cx", "cy", "n_samples"]
    mine, every = (x[columns].sort_values(columns[:2]).reset_index(drop=True) for x in (got, batch))
    assert len(every) > len(clips)
    pd.testing.assert_frame_equal(mine, every)


STREAM = "clip string, sid bigint, t double, x double, y double"


def written_samples(spark, n_files, seed, marks=()):
    """The random clips, dealt over files at random; and their batch result."""
    clips = {k: v for k, v in clip_samples().items() if k.startswith("random")}
    rows = [(k, i, *s) for k, v in clips.items() for i, s in enumerate(v)]
    base, rng = scratch(spark, "t-shuffled"), random.Random(seed)
    dealt = [[] for _ in range(n_files)]
    for r in rows:
        rng.choice(dealt).append(r)
    for part in [*dealt, *marks]:
        spark.createDataFrame(part, STREAM).coalesce(1).write.mode("append").parquet(base)
    batch = S.detect_fixations(spark.createDataFrame(rows, STREAM), min_seconds=.3)
    return base, sorted(map(tuple, batch.select("clip", "start", "end", "n_samples").collect())), clips


def closed(spark, out):
    got = spark.read.schema("clip string, kind string, start double, end double, n_samples bigint").parquet(out)
    assert got.where("kind <> 'fixation'").count() == 0
    return sorted(map(tuple, got.select("clip", "start", "end", "n_samples").collect()))


def test_shuffled_files_give_the_batch_result(spark):
    ends = [(f"random {k}", None, None, None, None) for k in range(6)]
    base, want, _ = written_samples(spark, 4, 1, [ends])
    stream = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(base)
    out = scratch(spark, "t-fix")
    (fixation_stream(stream, min_seconds=.3, slack=None).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch(spark, "t-state")).trigger(availableNow=True).start().awaitTermination())
    assert closed(spark, out) == want


def test_idle_clips_close_without_a_mark(spark):
    base, want, _ = written_samples(spark, 2, 2)
    out = scratch(spark, "t-fix")
    stream = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(base)
    q = (fixation_stream(stream, min_seconds=.3, slack=None, idle=8).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch(spark, "t-state")).trigger(processingTime="500 milliseconds").start())
    try:
        for _ in range(120):
            time.sleep(1)
            if q.exception() or q.lastProgress and len(closed(spark, out)) >= len(want):
                break
        assert q.exception() is None
    finally:
        q.stop()
    assert closed(spark, out) == want


def test_consecutive_dedupe(spark):
    e = spark.createDataFrame([("v", 1, 1, [1.0, 0.0]), ("v", 2, 2, [.99, .1]), ("v", 3, 3, [.7, .7]), ("v", 4, 4, [1.0, 0.0]), ("w", 5, 1, [1.0, 0.0])],
                              "video string, episode_id int, start int, vec array<double>")
    assert sorted(r["episode_id"] for r in S.consecutive_dedupe(e, "video", .9).collect()) == [1, 3, 4, 5]


def test_straightness(spark):
    line = [("l", i, i * .2, .1 * i, 0.0) for i in range(9)]
    back = [("b", i, i * .4, [0.0, 1.0, 0.0, 1.0, 0.0][i], 0.0) for i in range(5)]
    few = [("f", 0, 0.0, 0.0, 0.0), ("f", 1, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(line + back + few, "fix string, sid int, t double, x double, y double")
    got = {r["fix"]: r["straightness"] for r in S.path_straightness(df, ["fix"], "sid").collect()}
    assert got["l"] == pytest.approx(1.0) and got["b"] == 0.0 and got["f"] == 0.0


def test_consolidation(spark):
    def encoder(texts):                                    # all triples of one subject are alike
        return [np.eye(4, dtype=np.float32)[{"a": 0, "b": 1, "c": 2}[t.split()[0]]] for t in texts]

    rows = [("10", "a", "likes", "tea", ["e1"]), ("10", "b", "has", "car", ["e2"]), ("2", "a", "likes", "milk", ["e3"]), ("2", "a", "owns", "cat", ["e4"])]
    df = spark.createDataFrame(rows, "ts string, s string, p string, o string, evidence array<string>")
    got = sorted((r["ts"], r["s"], r["p"], r["o"], tuple(r["evidence"])) for r in C.consolidate(df, encoder=encoder).collect())
    assert got == [("10", "a", "likes", "tea", ("e1",)), ("10", "b", "has", "car", ("e2",)),      # "10" sorts before "2"
                   ("2", "a", "likes", "milk", ("e1", "e3")), ("2", "a", "owns", "cat", ("e4",)), ("2", "b", "has", "car", ("e2",))]


def test_versions_are_deltas(spark):
    """A stamp opens and closes what it changes; the rest is one version from its first stamp on."""
    def encoder(texts):
        return [np.eye(16, dtype=np.float32)[int(t.split()[0][1:])] for t in texts]

    rows = [("1", f"s{i}", "p", "old", [f"e{i}"]) for i in range(16)] + [("2", "s3", "p", "new", ["f3"]), ("3", "s3", "p", "newer", ["g3"]), ("3", "s5", "q", "x", [])]
    df = spark.createDataFrame(rows, "ts string, s string, p string, o string, evidence array<string>")
    versions = C.consolidate_versions(df, encoder=encoder).cache()
    assert versions.count() == 19 and versions.where("valid_to IS NULL").count() == 17
    changed = sorted(tuple(r) for r in versions.where("s = 's3'").select("o", "evidence", "valid_from", "valid_to").collect())
    assert changed == [("new", ["e3", "f3"], "2", "3"), ("newer", ["e3", "f3", "g3"], "3", None), ("old", ["e3"], "1", "2")]
    for ts, n in (("0", 0), ("1", 16), ("2", 16), ("25", 16), ("3", 17), ("9", 17)):
        assert versions.where(C.holds_at(F.lit(ts))).count() == n
    every = C.snapshots(versions, df.select("ts"))
    assert {r["ts"]: r["count"] for r in every.groupBy("ts").count().collect()} == {"1": 16, "2": 16, "3": 17}
    for ts in "123":
        a, b = every.where(F.col("ts") == ts).drop("ts"), versions.where(C.holds_at(F.lit(ts))).drop("valid_from", "valid_to")
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_consolidating_nothing(spark):
    df = spark.createDataFrame([], "ts string, s string, p string, o string, evidence array<string>")
    assert C.consolidate(df).collect() == [] and C.consolidate_versions(df).columns == ["s", "p", "o", "evidence", "valid_from", "valid_to"]


def test_rounds_never_repeat_a_hit(spark):
    items = spark.createDataFrame([(i, float(10 - i)) for i in range(8)], "item bigint, score double")

    def memory(q, n):
        return q.select("qid").withColumn("k", F.lit(1)).join(items.withColumn("k", F.lit(1)), "k").where(F.col("item") < n).drop("k")

    def decide(open_, history, i):
        return open_.withColumn("action", F.when(F.col("qid") <= i - 1, "answer").otherwise("search")).withColumn("memory", F.lit("m")).withColumn("search", F.lit(""))

    q = spark.createDataFrame([(1,), (2,), (99,)], "qid bigint")
    final, history = R.retrieval_rounds(q, decide, {"m": memory}, 2, max_rounds=3)
    assert {r["qid"]: (r["action"], r["rounds"]) for r in final.collect()} == {1: ("answer", 1), 2: ("answer", 2), 99: ("limit", 3)}
    hits = history.toPandas()
    assert not hits.duplicated(["qid", "item"]).any()
    assert sorted(hits[hits.qid == 99]["item"].astype(int)) == [0, 1, 2, 3]


def test_resampling_bands(spark):
    d = spark.createDataFrame([(x,) for x in [1] * 30 + [-1] * 10 + [0] * 60], "d int")
    exact = sum(math.comb(40, k) for k in range(11)) * 2 / 2 ** 40
    assert T.sign_flip_p(d, "d", n=20000, seed=3).first()["p"] == pytest.approx(exact, abs=.001)
    assert T.sign_flip_p(d.where("d = 0"), "d", n=100).first()["p"] == 1.0
    sizes = [-.5, .75, 1.25, 2.0, 2.5, 3.0, -1.0, 4.0]
    several = spark.createDataFrame([(x,) for x in sizes], "d double")
    flips = [abs(sum(s * x for s, x in zip(signs, sizes))) for signs in itertools.product((1, -1), repeat=len(sizes))]
    share = sum(f >= abs(sum(sizes)) for f in flips) / len(flips)
    for chunk_values in (50000, 3, 1):
        assert T.sign_flip_p(several, "d", n=20000, seed=3, chunk_values=chunk_values).first()["p"] == pytest.approx(share, abs=.015)
    sd = math.sqrt((40 / 100 - .04) / 100)
    for chunk_values in (50000, 2, 1):                     # one chunk, or several
        r = T.bootstrap_interval(d, "d", draws=4000, seed=3, chunk_values=chunk_values).first()
        assert r["mean"] == pytest.approx(.2) and r["low"] == pytest.approx(.2 - 1.96 * sd, abs=.02) and r["high"] == pytest.approx(.2 + 1.96 * sd, abs=.02)
    none = T.bootstrap_interval(d.where("d > 5"), "d", draws=10).first()
    assert none["mean"] is None and none["low"] is None


def test_signed_rank_needs_ten(spark):
    rows = [("few", 1, 2)] * 5 + [("many", 10 + i, 5) for i in range(20)]
    got = {r["g"]: (r["n"], r["better"], r["p"]) for r in T.signed_rank(spark.createDataFrame(rows, "g string, a int, b int"), "g", "a", "b").collect()}
    assert got["few"][2] is None and got["many"][:2] == (20, 20) and got["many"][2] < .001


def test_signed_rank_counts_out_small_groups(spark):
    rng, rows, want = random.Random(4), [], {}
    for g, n in (("ten", 10), ("twelve", 12), ("all up", 11)):
        sizes = rng.sample(range(2, 400), n)
        ups = [g == "all up" or rng.random() < .6 for _ in sizes]
        rows += [(g, s, 1) if u else (g, 1, s) for s, u in zip(sizes, ups, strict=True)]
        ranks = [sorted(sizes).index(s) + 1 for s in sizes]
        w = sum(r for r, u in zip(ranks, ups, strict=True) if u)
        sums = [sum(r for r, u in zip(ranks, signs, strict=True) if u) for signs in itertools.product((0, 1), repeat=n)]
        want[g] = min(1, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))
    rows += [("tied", 3, 1)] * 12 + [("many", 3 + i, 2 + 2 * i % 7) for i in range(90)]
    got = {r["g"]: (r["method"], r["p"]) for r in T.signed_rank(spark.createDataFrame(rows, "g string, a int, b int"), "g", "a", "b").collect()}
    for g, p in want.items():
        assert got[g][0] == "exact" and got[g][1] == pytest.approx(p, abs=1e-12)
    assert got["tied"][0] == got["many"][0] == "normal"


def test_srt_rules(spark, tmp_path):
    text = "1\n00:00:05,120 --> 00:00:07,500\n中文\nhello there\n\n2\n01:00:08,000 --> 01:00:09,000\n \n\n3\n00:10:00,000 --> 00:10:01,000\none\n two \n"
    (tmp_path / "A_07000000.srt").write_text(text, encoding="utf-8")
    blocks = SC.read_srt(spark, str(tmp_path))
    last = sorted((r["start"], r["text"]) for r in SC.srt_last_line(blocks, F.lit(7)).collect())
    assert last == [(70005, "hello there"), (71000, "two"), (80008, "")]
    joined = sorted((r["start_sec"], r["text"]) for r in SC.srt_joined(blocks).collect())
    assert joined == [(5.12, "中文 hello there"), (600.0, "one two")]


def test_hooks(spark):
    from chronoloom import hooks
    df = spark.createDataFrame([(1, "text", "a b"), (2, "image", "p.jpg"), (3, "sound", "x")], "id int, m string, payload string")
    got = {r["id"]: r["vec"] for r in hooks.by_modality(df, "m", {"text": hooks.hashed_words, "image": lambda s: [[1.0, 2.0]] * len(s)}, "payload").collect()}
    assert len(got[1]) == hooks.DIMENSIONS and got[2] == [1.0, 2.0] and got[3] is None
    assert df.select(hooks.prompt("Q {id}: {text}!", id="id", text="payload").alias("p")).first()["p"] == "Q 1: a b!"
