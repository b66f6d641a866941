"""Incremental, stateful and model-backed work over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import consolidate as C
from ..operators import incremental as I
from ..operators import rounds as R
from ..operators import shared_vectors as shared
from ..operators import stateful as S
from ..operators.gaze_tables import fixation_summary as summary
from ..operators.intervals import tolerance_join
from ..operators.vectors import topk
from ..session import cut, saved, scratch
from . import views as V
from .registry import Tables, query
from .study import arm_clips, ask_vectors, study_sql

CC = V.with_views("captions", "clips")


@query("vector_store_upsert", """
WITH old AS (SELECT DISTINCT md5(d.text) AS h FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
every AS (SELECT DISTINCT md5(text) AS h FROM documents UNION SELECT md5(text) FROM benchmark)
SELECT 'chunk-' || e.h AS hash_id, o.h IS NULL AS is_new FROM every e LEFT JOIN old o ON o.h = e.h""")
def vector_store_upsert(t: Tables) -> DataFrame:
    """Labelled documents are stored first; then all documents and benchmark texts arrive."""
    path = scratch(t.spark, "store")
    docs = t.documents.select("doc_id", "text")
    I.upsert(t.spark, path, docs.join(t.labels.select("doc_id"), "doc_id"), "text", "chunk-")
    first = I.open_store(t.spark, path).select("hash_id", F.lit(False).alias("was"))
    before = scratch(t.spark, "store-ids")
    first.write.parquet(before)
    I.upsert(t.spark, path, docs.select("text").unionByName(t.benchmark.select("text")), "text", "chunk-")
    store = I.open_store(t.spark, path).select("hash_id")
    return store.join(t.spark.read.parquet(before), "hash_id", "left").select("hash_id", F.col("was").isNull().alias("is_new"))


@query("vector_store_delete", """
SELECT DISTINCT md5(text) AS hash_id FROM documents WHERE md5(text) NOT IN (SELECT md5(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1)""")
def vector_store_delete(t: Tables) -> DataFrame:
    path, left = scratch(t.spark, "store"), scratch(t.spark, "store-after")
    I.upsert(t.spark, path, t.documents.select("text"), "text")
    toxic = t.documents.join(t.labels.where("toxic = 1").select("doc_id"), "doc_id").select(F.md5("text").alias("hash_id")).distinct()
    I.remove(t.spark, path, left, toxic)
    return I.open_store(t.spark, left).select("hash_id")


@query("shard_merge", """
WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_suppkey AS shard, max(l_partkey) AS v FROM lineitem GROUP BY ALL)
SELECT k, arg_max(v, shard) AS v, max(shard) AS shard FROM s GROUP BY k""")
def shard_merge(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_suppkey").alias("shard")).agg(
        F.max("l_partkey").alias("v"))
    return I.merge_shards(s, "k", "shard")


@query("split_contiguous", """
SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil(count(*) OVER () / 7)) AS BIGINT) AS chunk FROM documents""")
def split_contiguous(t: Tables) -> DataFrame:
    return I.contiguous(t.documents.select("doc_id"), ["doc_id"], 7)


@query("watermark_index", CC + """
, c AS (SELECT clip, CASE WHEN ce <= 1000000 THEN 1000000 WHEN ce <= 1800000 THEN 1800000 END AS taken_at FROM clips),
s AS (SELECT clip, day * 86400 AS snap FROM clips)
SELECT 'clip' AS kind, CAST(clip AS VARCHAR) AS item, CAST(taken_at AS BIGINT) AS taken_at FROM c WHERE taken_at IS NOT NULL
UNION ALL SELECT 'snapshot', CAST(clip AS VARCHAR), CAST(snap AS BIGINT) FROM s WHERE snap = (SELECT max(snap) FROM s WHERE snap <= 1800000)""")
def watermark_index(t: Tables) -> DataFrame:
    clips = V.clips(t).select("clip", "ce")
    index = I.TimedIndex(t.spark, scratch(t.spark, "index"), clips, "clip", "ce")
    for until in (1000000, 900000, 1800000):   # the second call lies below the mark and does nothing
        index.advance(clips, until)
    seen = index.entries().select(F.lit("clip").alias("kind"), F.col("clip").cast("string").alias("item"), F.col("_call").alias("taken_at"))
    snaps = V.clips(t).select("clip", (F.col("day") * 86400).alias("snap"))
    now = I.snapshot_at(snaps, "snap", 1800000)
    return seen.unionByName(now.select(F.lit("snapshot").alias("kind"), F.col("clip").cast("string").alias("item"), F.col("snap").alias("taken_at")))


@query("cached_inference", """
WITH k AS (SELECT conv_id, turn, role, text, sha256(text || '|rule|text') AS key FROM conversations),
old AS (SELECT DISTINCT key FROM k WHERE role = 'assistant')
SELECT conv_id, turn, k.key, o.key IS NOT NULL AS hit, length(text) || ':' || coalesce(regexp_extract(text, '\\S+'), '') AS response
FROM k LEFT JOIN old o ON o.key = k.key""".replace("\\\\", "\\"))
def cached_inference(t: Tables) -> DataFrame:
    """Assistant turns were answered before; then all turns are asked."""
    path = scratch(t.spark, "cache")
    c = t.conversations
    I.cached_inference(t.spark, c.where("role = 'assistant'"), "text", path)
    return I.cached_inference(t.spark, c, "text", path, waves=2).select("conv_id", "turn", "key", "hit", "response")


def marked(text: str) -> str:
    """Stand-in for a translation model: the text behind a language mark."""
    return f"[en] {text}"


@query("translate_caption_jobs", "SELECT conv_id, turn, md5('[en] ' || text) AS translated, true AS ok FROM conversations")
def translate_caption_jobs(t: Tables) -> DataFrame:
    out = I.cached_inference(t.spark, t.conversations, "text", scratch(t.spark, "translations"), model="mark", answer=marked)
    return out.select("conv_id", "turn", F.md5("response").alias("translated"), F.col("error").isNull().alias("ok")).orderBy("conv_id", "turn")


RADII = (0.03, 0.05, 0.08)


def fixation_sql(radii: tuple[float, ...], least: float, gap: float = 0.2, dropout: float = 0.4) -> str:
    """The detector as a recursive query: one step per sample of a clip, with the state of the open fixation.

    Move A ends it after a hole, B takes the sample in, C waits through an excursion, D ends it and opens one
    where the excursion began. `found` has all closed fixations.
    """
    numbers = ", ".join(f"({r}::DOUBLE)" for r in radii)
    return V.with_views("gaze").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, g AS MATERIALIZED (SELECT clip, t, x, y, row_number() OVER (PARTITION BY clip ORDER BY t, sid) AS rn, count(*) OVER (PARTITION BY clip) AS size FROM gaze),
w AS (
  SELECT param, clip, rn, size, t AS a, t AS b, 1::BIGINT AS n, x AS sx, y AS sy, NULL::DOUBLE AS ot, NULL::DOUBLE AS ox, NULL::DOUBLE AS oy, t AS seen,
    NULL::DOUBLE AS ca, NULL::DOUBLE AS cb, NULL::BIGINT AS cn, NULL::DOUBLE AS csx, NULL::DOUBLE AS csy
  FROM g, (VALUES {numbers}) p(param) WHERE rn = 1
  UNION ALL
  SELECT param, clip, rn, size,
    CASE move WHEN 'A' THEN t WHEN 'D' THEN pt ELSE a END, CASE WHEN move = 'C' THEN b WHEN move = 'D' AND NOT near THEN pt ELSE t END,
    CASE WHEN move = 'A' THEN 1 WHEN move = 'B' THEN n + 1 WHEN move = 'C' THEN n WHEN near THEN 2 ELSE 1 END,
    CASE WHEN move = 'A' THEN x WHEN move = 'B' THEN sx + x WHEN move = 'C' THEN sx WHEN near THEN px + x ELSE px END,
    CASE WHEN move = 'A' THEN y WHEN move = 'B' THEN sy + y WHEN move = 'C' THEN sy WHEN near THEN py + y ELSE py END,
    CASE WHEN move = 'C' THEN pt WHEN move = 'D' AND NOT near THEN t END, CASE WHEN move = 'C' THEN px WHEN move = 'D' AND NOT near THEN x END,
    CASE WHEN move = 'C' THEN py WHEN move = 'D' AND NOT near THEN y END, t,
    CASE WHEN move IN ('A', 'D') THEN a END, CASE WHEN move IN ('A', 'D') THEN b END, CASE WHEN move IN ('A', 'D') THEN n END,
    CASE WHEN move IN ('A', 'D') THEN sx END, CASE WHEN move IN ('A', 'D') THEN sy END
  FROM (
    SELECT w.*, g.t, g.x, g.y, coalesce(w.ot, g.t) AS pt, coalesce(w.ox, g.x) AS px, coalesce(w.oy, g.y) AS py,
      CASE WHEN g.t - w.seen > {dropout} THEN 'A' WHEN sqrt((g.x - w.sx / w.n) ** 2 + (g.y - w.sy / w.n) ** 2) <= param THEN 'B'
        WHEN g.t - coalesce(w.ot, g.t) <= {gap} THEN 'C' ELSE 'D' END AS move,
      sqrt((g.x - coalesce(w.ox, g.x)) ** 2 + (g.y - coalesce(w.oy, g.y)) ** 2) <= param AS near
    FROM (SELECT * REPLACE (rn + 1 AS rn) FROM w) w JOIN g ON g.clip = w.clip AND g.rn = w.rn)),
found AS MATERIALIZED (
  SELECT param, clip, ca AS start, cb AS "end", csx / cn AS cx, csy / cn AS cy, cb - ca AS duration, cn AS n_samples FROM w WHERE cn IS NOT NULL AND cb - ca >= {least}
  UNION ALL SELECT param, clip, a, b, sx / n, sy / n, b - a, n FROM w WHERE rn = size AND b - a >= {least})
"""


def fixations(t: Tables, radius: float | tuple[float, ...] = 0.05) -> DataFrame:
    return S.detect_fixations(V.gaze(t).select("clip", "sid", "t", "x", "y"), radius=radius, min_seconds=0.3)


@query("fixation_detect", fixation_sql((0.05,), 0.3) + """
SELECT clip, start, "end", round(cx, 9) AS cx, round(cy, 9) AS cy, round(duration, 9) AS duration, n_samples FROM found""")
def fixation_detect(t: Tables) -> DataFrame:
    return fixations(t).withColumns({c: F.round(c, 9) for c in ("cx", "cy", "duration")})


@query("fixation_summary", fixation_sql(RADII, 0.3) + """
, ends AS (SELECT clip, min(t) AS a, max(t) AS b FROM gaze GROUP BY clip),
f AS (SELECT clip, unnest(range(0, CAST(floor((b - a) * 4) AS BIGINT) + 1)) AS frame_id, a FROM ends),
p AS (SELECT param, clip, a + frame_id * 0.25::DOUBLE AS ft FROM f, (SELECT unnest([""" + ", ".join(map(str, RADII)) + """]::DOUBLE[]) AS param)),
share AS (SELECT param, clip, avg(CAST(EXISTS (SELECT 1 FROM found x WHERE x.param = p.param AND x.clip = p.clip AND ft BETWEEN x.start AND x."end") AS INTEGER)) AS share FROM p GROUP BY ALL),
per AS (SELECT s.param, s.clip, share, (SELECT count(*) FROM found x WHERE x.param = s.param AND x.clip = s.clip) AS n_fix FROM share s),
d AS (SELECT param, avg(CAST(duration > 3 AS INTEGER)) AS share_long, median(duration) AS median_duration, quantile_cont(duration, 0.9) AS p90_duration FROM found GROUP BY param)
SELECT per.param, count(*) AS n_clips, round(avg(n_fix), 6) AS mean_per_clip, count(CASE WHEN n_fix = 0 THEN 1 END) AS n_empty,
  round(any_value(share_long), 6) AS share_long, round(avg(share), 6) AS mean_covered, median(n_fix) AS median_per_clip,
  round(any_value(median_duration), 6) AS median_duration, round(any_value(p90_duration), 6) AS p90_duration
FROM per LEFT JOIN d ON d.param = per.param GROUP BY per.param""")
def fixation_summary(t: Tables) -> DataFrame:
    """Three radii; coverage is the share of a recording's frames inside a fixation."""
    from .joins import frames
    found = cut(fixations(t, RADII))
    radii = F.array(*[F.lit(r) for r in RADII])
    clips = V.gaze(t).select("clip").distinct().withColumn("param", F.explode(radii))
    fr = frames(t)
    pairs = tolerance_join(fr, found.select("param", "clip", F.col("start").alias("s"), F.col("end").alias("e")), "ft", ("s", "e"), 0.0, 1.0, ["clip"])
    inside = pairs.select("param", "clip", "frame_id").distinct().groupBy("param", "clip").agg(F.count(F.lit(1)).alias("n_in"))
    totals = fr.groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    covered = clips.join(totals, "clip").join(inside, ["param", "clip"], "left").select(
        "param", "clip", (F.coalesce("n_in", F.lit(0)) / F.col("n")).alias("share"))
    return summary(found, covered, clips).withColumns({c: F.round(c, 6) for c in ("median_duration", "p90_duration")})


@query("path_straightness", fixation_sql((0.05,), 0.3) + """
, i AS MATERIALIZED (SELECT f.clip, f.start AS s, g.t, g.x, g.y, row_number() OVER (PARTITION BY f.clip, f.start ORDER BY g.t, g.sid) AS rn
   FROM found f JOIN gaze g ON g.clip = f.clip AND g.t BETWEEN f.start AND f."end"),
b AS (SELECT clip, s, rn, t AS opened, 1 AS bin FROM i WHERE rn = 1
  UNION ALL SELECT i.clip, i.s, i.rn, CASE WHEN i.t - b.opened > 0.1 THEN i.t ELSE b.opened END, b.bin + CAST(i.t - b.opened > 0.1 AS INTEGER)
  FROM b JOIN i ON i.clip = b.clip AND i.s = b.s AND i.rn = b.rn + 1),
c AS (SELECT b.clip, b.s, bin, avg(x) AS cx, avg(y) AS cy FROM b JOIN i ON i.clip = b.clip AND i.s = b.s AND i.rn = b.rn GROUP BY ALL),
l AS (SELECT *, lag(cx) OVER (PARTITION BY clip, s ORDER BY bin) AS px, lag(cy) OVER (PARTITION BY clip, s ORDER BY bin) AS py FROM c),
p AS (SELECT clip, s, count(*) AS n_bins, coalesce(sum(sqrt((cx - px) ** 2 + (cy - py) ** 2)), 0) AS path,
   sqrt((arg_max(cx, bin) - arg_min(cx, bin)) ** 2 + (arg_max(cy, bin) - arg_min(cy, bin)) ** 2) AS net FROM l GROUP BY ALL)
SELECT clip, s, round(CASE WHEN n_bins < 3 OR path = 0 THEN 0 ELSE net / path END, 6) AS straightness, n_bins FROM p""")
def path_straightness(t: Tables) -> DataFrame:
    fix = fixations(t).select("clip", F.col("start").alias("s"), F.col("end").alias("e"))
    pts = V.gaze(t).select("clip", "sid", "t", "x", "y")
    inside = tolerance_join(pts, fix, "t", ("s", "e"), 0.0, 1.0, ["clip"])
    return S.path_straightness(inside, ["clip", "s"], "sid", 0.1).withColumn("straightness", F.round("straightness", 6))


@query("consecutive_dedupe", """
WITH RECURSIVE e AS MATERIALIZED (SELECT label AS video, vec_id AS episode_id, CAST(embedding AS DOUBLE[]) AS vec, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
n AS MATERIALIZED (SELECT a.video, a.rn, min(b.rn) AS following FROM e a JOIN e b ON b.video = a.video AND b.rn > a.rn
  WHERE NOT coalesce(list_inner_product(a.vec, b.vec) / nullif(sqrt(list_inner_product(a.vec, a.vec) * list_inner_product(b.vec, b.vec)), 0) >= 0.1, false) GROUP BY ALL),
w AS (SELECT video, rn FROM e WHERE rn = 1 UNION ALL SELECT n.video, n.following FROM w JOIN n ON n.video = w.video AND n.rn = w.rn)
SELECT e.video, e.episode_id FROM w JOIN e ON e.video = w.video AND e.rn = w.rn""")
def consecutive_dedupe(t: Tables) -> DataFrame:
    """Vectors of one label are the episodes of one video, in id order."""
    e = t.embeddings.select(F.col("label").alias("video"), F.col("vec_id").alias("episode_id"), F.col("vec_id").alias("start"),
                            F.col("embedding").alias("vec"))
    return S.consecutive_dedupe(e, "video", 0.1)


@query("scene_filter", V.with_views("captions", "clips") + """
, e AS (SELECT clip, value % 10 AS duration, value % 256 AS brightness, 0.8 + (clip % 200) / 1000.0 AS similarity FROM clips),
r AS (SELECT *, CASE WHEN duration < 1.5 THEN 'short' WHEN brightness < 16 THEN 'black' WHEN similarity < 0.9 THEN 'scene change' ELSE 'steady' END AS reason FROM e)
SELECT reason, reason IN ('short', 'steady') AS kept, count(*) AS n FROM r GROUP BY reason""")
def scene_filter(t: Tables) -> DataFrame:
    e = V.clips(t).select("clip", (F.col("value") % 10).alias("duration"), (F.col("value") % 256).alias("brightness"),
                          (F.lit(0.8) + (F.col("clip") % 200) / F.lit(1000.0)).alias("similarity"))
    return S.scene_filter(e, 16).groupBy("reason", "kept").agg(F.count(F.lit(1)).alias("n"))


def consolidate_sql(stamps: list[str], dims: int = 64) -> str:
    """The fold unrolled over the stamps. A word of a text adds 1 or -1 to one of the vector's places, by its md5."""
    places = ", ".join(f"sum(CASE WHEN place = {i} THEN sign ELSE 0 END)" for i in range(dims))
    out = [V.with_views("triples") + f"""
, raw AS MATERIALIZED (SELECT substr(o_orderpriority, 1, 1) AS ts, s, o, CAST(doc AS VARCHAR) AS doc, s || ' made by ' || o AS txt FROM triples JOIN orders ON o_orderkey = doc),
word AS (SELECT txt, md5(unnest(regexp_extract_all(lower(txt), '\\w+'))) AS h FROM (SELECT DISTINCT txt FROM raw)),
hashed AS (SELECT txt, CAST('0x' || substr(h, 1, 2) AS INTEGER) % {dims} AS place, CASE WHEN CAST('0x' || substr(h, 9, 2) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM word),
summed AS (SELECT txt, CAST([{places}] AS FLOAT[]) AS v FROM hashed GROUP BY txt),
e AS MATERIALIZED (SELECT txt, CAST(list_transform(v, lambda x: CAST(x / CAST(sqrt(list_inner_product(v, v)) AS FLOAT) AS FLOAT)) AS DOUBLE[{dims}]) AS vec FROM summed),
f AS MATERIALIZED (SELECT ts, s, o, txt, [min(doc)] AS ev FROM raw GROUP BY ts, s, o, txt),
s1 AS MATERIALIZED (SELECT s, o, txt, ev FROM f WHERE ts = '{stamps[0]}')"""]
    for i, ts in enumerate(stamps[1:], 2):
        out.append(f"""
n{i} AS MATERIALIZED (SELECT new, old FROM (SELECT f.txt AS new, s.txt AS old, round(array_cosine_similarity(a.vec, b.vec), 9) AS score
   FROM f JOIN e a ON a.txt = f.txt, s{i - 1} s JOIN e b ON b.txt = s.txt WHERE f.ts = '{ts}') WHERE score >= 0.6
   QUALIFY row_number() OVER (PARTITION BY new ORDER BY score DESC, md5(old)) <= 20),
g{i} AS MATERIALIZED (SELECT n.new, o.txt AS old, o.ev FROM n{i} n JOIN s{i - 1} o ON o.txt = n.old JOIN f ON f.ts = '{ts}' AND f.txt = n.new AND f.s = o.s),
s{i} AS MATERIALIZED (SELECT s, o, txt, ev FROM s{i - 1} WHERE txt NOT IN (SELECT old FROM g{i})
   UNION ALL SELECT s, o, txt, list_sort(list_distinct(list_concat(ev, coalesce((SELECT flatten(list(g.ev)) FROM g{i} g WHERE g.new = f.txt), [])))) FROM f WHERE ts = '{ts}')""")
    tail = " UNION ALL ".join(f"SELECT '{ts}' AS ts, count(*) AS n, count(DISTINCT s) AS n_subjects, CAST(sum(len(ev)) AS BIGINT) AS n_evidence FROM s{i}"
                              for i, ts in enumerate(stamps, 1))
    return ",".join(out) + f"\nSELECT * FROM ({tail}) WHERE n > 0"


@query("consolidate_fold", consolidate_sql(["1", "2", "3", "4", "5"]))
def consolidate_fold(t: Tables) -> DataFrame:
    """Facts of five order priorities, consolidated in their order; counts per snapshot."""
    raw = (V.triples(t).join(t.orders.select(F.col("o_orderkey").alias("doc"), "o_orderpriority"), "doc")
           .select(F.substring("o_orderpriority", 1, 1).alias("ts"), "s", F.lit("made by").alias("p"), "o",
                   F.array(F.col("doc").cast("string")).alias("evidence")))
    # Only the sizes of evidence lists are written, not the lists.
    versions, _ = saved(C.consolidate_versions(raw).withColumn("size", F.size("evidence")).drop("evidence"), "triple-versions")
    snaps = C.snapshots(versions, versions.select(F.col("valid_from").alias("ts")))
    return snaps.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("n_subjects"),
                                   F.sum("size").cast("bigint").alias("n_evidence"))


@query("retrieval_rounds", study_sql("""
, q AS (SELECT qid * 1000003 + qno AS qid, qvec FROM ask_vecs),
v6 AS (SELECT qid * 1000003 + qno AS qid, clip AS item, score FROM placed WHERE arm = 'full' AND pos <= 6),
v AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(item AS VARCHAR)) AS r FROM v6),
s6 AS (SELECT qid, vec_id AS item, round(list_cosine_similarity(qvec, vec), 9) AS score FROM q, vecs
       QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 6),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(item AS VARCHAR)) AS r FROM s6),
hits AS (SELECT qid, '1:' || r || ':visual:' || item AS hit FROM v WHERE r <= 3
  UNION ALL SELECT qid, '2:' || r || ':semantic:' || item FROM s WHERE r <= 3 AND qid % 4 >= 1
  UNION ALL SELECT qid, '3:' || (r - 3) || ':visual:' || item FROM v WHERE r > 3 AND qid % 4 >= 2),
seen_items AS (SELECT qid, count(*) AS n_hits, count(DISTINCT hit[5:]) AS n_items, string_agg(hit, ',' ORDER BY hit) AS hits FROM hits GROUP BY qid)
SELECT qid, 'answer' AS action, CAST(least(qid % 4 + 1, 3) AS INTEGER) AS rounds, n_hits, n_items, hits FROM q LEFT JOIN seen_items USING (qid)"""))
def retrieval_rounds(t: Tables) -> DataFrame:
    """All asks, each one its own question. Rule for the agent: clips first, then facts, then further clips; a quarter of
    the asks answers after each of the first two rounds."""
    asks = ask_vectors(t).select((F.col("qid") * 1000003 + F.col("qno")).alias("qid"), "qt", "qvec")
    clips = arm_clips(t).where("arm = 'full'").select(F.col("clip").alias("item"), "ce", "vec_id")
    vecs = V.vecs(t).select(F.col("vec_id").alias("item"), "vec")

    def decide(open_, history, i):
        memory = {1: "visual", 2: "semantic", 3: "visual"}.get(i)
        action = F.when(F.col("qid") % 4 < i - 1, "answer").otherwise("search" if memory else "answer")
        return open_.withColumn("action", action).withColumn("memory", F.lit(memory)).withColumn("search", F.lit("question"))

    def visual(q, n):
        return shared.topk(q, clips, V.vecs(t).select("vec_id", "vec"), n, ["qid"], "item", before=("qt", "ce"))

    def semantic(q, n):
        return topk(q, vecs, n, ["qid"], "item")

    final, history = R.retrieval_rounds(asks, decide, {"visual": visual, "semantic": semantic}, 3)
    hit = F.concat_ws(":", F.col("round").cast("string"), F.col("rank").cast("string"), "memory", "item")
    seen = history.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("memory", "item").alias("n_items"),
                                      F.array_join(F.array_sort(F.collect_list(hit)), ",").alias("hits"))
    return final.select("qid", "action", "rounds").join(seen, "qid", "left")
