"""Theta, range, as-of, nearest, fallback and anti joins over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timekeys as K
from ..operators import intervals as I
from ..operators import lookups as L
from ..operators.ordered import row_numbers
from ..operators.vectors import topk
from . import views as V
from .registry import Tables, query

PC = V.with_views("captions", "clips", "points")


@query("visible_join", PC + """
SELECT p.qid, count(c.clip) AS n_visible, max(c.ce) AS last_end
FROM points p LEFT JOIN clips c ON c.ce <= p.qt GROUP BY p.qid""")
def visible_join(t: Tables) -> DataFrame:
    return I.visible_counts(V.points(t), V.clips(t), "qt", "ce").select("qid", "n_visible", "last_end")


@query("visible_pairs", PC + """
, people AS (SELECT count(DISTINCT clip_stream) AS n FROM clips), names AS (SELECT clip_stream AS stream, row_number() OVER (ORDER BY clip_stream) - 1 AS no FROM (SELECT DISTINCT clip_stream FROM clips))
SELECT p.qid, c.clip, p.qt - c.ce AS gap FROM points p JOIN names ON no = cust % (SELECT n FROM people)
JOIN clips c ON c.clip_stream = names.stream AND c.ce <= p.qt AND c.ce >= p.qt - 86400""")
def visible_pairs(t: Tables) -> DataFrame:
    """Each point belongs to one person's stream and sees the clips of that stream that ended within the day before."""
    clips = V.clips(t).select("clip", "ce", F.col("clip_stream").alias("stream"))
    names = row_numbers(clips.select("stream").distinct(), [], ["stream"], "no")
    n = names.count()
    points = V.points(t).select("qid", "qt", (F.col("cust") % n + 1).alias("no")).join(names, "no")
    pairs = I.visible_join(points, clips, "qt", "ce", 3600.0, 86400.0, ["stream"])
    return pairs.select("qid", "clip", (F.col("qt") - F.col("ce")).alias("gap"))


@query("asof_snapshot", PC + """
, snaps AS (SELECT cs // 21600 * 21600 AS snap, clip_text, count(*) AS n FROM clips GROUP BY ALL),
latest AS (SELECT p.qid, max(s.snap) AS snap FROM points p JOIN snaps s ON s.snap <= p.qt GROUP BY p.qid)
SELECT l.qid, l.snap, CAST(sum(s.n) AS BIGINT) AS n_rows, count(*) AS n_kinds
FROM latest l JOIN snaps s ON s.snap = l.snap GROUP BY l.qid, l.snap""")
def asof_snapshot(t: Tables) -> DataFrame:
    snaps = (V.clips(t).groupBy((F.floor(F.col("cs") / 21600) * 21600).alias("snap"), "clip_text")
             .agg(F.count(F.lit(1)).alias("n")))
    asked = I.as_of(V.points(t).select("qid", "qt"), snaps, "qt", "snap", name="snap")
    per = snaps.groupBy("snap").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_kinds"))
    return asked.join(per, "snap").select("qid", "snap", "n_rows", "n_kinds")


@query("overlap_join", PC + """
SELECT p.qid, c.clip FROM points p JOIN clips c ON p.target <= c.ce AND p.target + 120 >= c.cs""")
def overlap_join(t: Tables) -> DataFrame:
    p = V.points(t).select("qid", "target", (F.col("target") + 120).alias("until"))
    return I.overlap_join(p, V.clips(t).select("clip", "cs", "ce"), ("target", "until"), ("cs", "ce"),
                          300).select("qid", "clip")


@query("tolerance_overlap", PC + """
SELECT p.qid, c.clip, 'span' AS source FROM points p JOIN clips c ON c.cs <= p.target + 60 AND c.ce >= p.target - 60
WHERE p.status <> 'P'
UNION ALL SELECT p.qid, c.clip, 'stored' FROM points p JOIN clips c ON c.clip = p.qid WHERE p.status = 'P'""")
def tolerance_overlap(t: Tables) -> DataFrame:
    p, c = V.points(t).select("qid", "status", "target"), V.clips(t).select("clip", "cs", "ce")
    found = I.tolerance_join(p.where("status <> 'P'"), c, "target", ("cs", "ce"), 60, 300)
    stored = c.select(F.col("clip").alias("qid"), "clip")
    return L.with_fallback(found.select("qid", "clip"), p.where("status = 'P'"), stored, "qid")


@query("point_in_segment", PC + """
SELECT p.qid, min(c.clip) AS first_clip, count(*) AS n_clips FROM points p JOIN clips c ON p.target BETWEEN c.cs AND c.ce
GROUP BY p.qid""")
def point_in_segment(t: Tables) -> DataFrame:
    pairs = I.tolerance_join(V.points(t).select("qid", "target"), V.clips(t).select("clip", "cs", "ce"),
                             "target", ("cs", "ce"), 0, 300)
    return pairs.groupBy("qid").agg(F.min("clip").alias("first_clip"), F.count(F.lit(1)).alias("n_clips"))


@query("snap_nearest", PC + """
, d AS (SELECT p.qid, c.clip, greatest(c.cs - p.target, p.target - c.ce, 0) AS distance,
               least(greatest(p.target - c.cs, 0), 30) AS "offset"
        FROM points p JOIN clips c ON p.target BETWEEN c.cs - 15 AND c.ce + 15)
SELECT qid, clip, distance, "offset" FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, clip) = 1""")
def snap_nearest(t: Tables) -> DataFrame:
    return L.nearest_span(V.points(t).select("qid", "target"), V.clips(t).select("clip", "cs", "ce"),
                          "target", ("cs", "ce"), "qid", "clip", 15, 300)


FRAMES = V.with_views("gaze") + """
, ends AS (SELECT clip, min(t) AS a, max(t) AS b FROM gaze GROUP BY clip),
frames AS (SELECT clip, unnest(range(0, CAST(floor((b - a) * 4) AS BIGINT) + 1)) AS frame_id, a FROM ends),
f AS (SELECT clip, frame_id, a + frame_id * 0.25::DOUBLE AS ft FROM frames)
"""


def frames(t: Tables) -> DataFrame:
    """A frame every quarter of a second over each recording."""
    ends = V.gaze(t).groupBy("clip").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    n = F.floor((F.col("b") - F.col("a")) * 4)
    grid = ends.select("clip", "a", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("frame_id"))
    return grid.select("clip", "frame_id", (F.col("a") + F.col("frame_id") * F.lit(0.25)).alias("ft"))


@query("nearest_sample", FRAMES + """
, near AS (SELECT f.clip, frame_id, x, y FROM f JOIN gaze g ON g.clip = f.clip AND abs(g.t - ft) <= 0.05
   QUALIFY row_number() OVER (PARTITION BY f.clip, frame_id ORDER BY abs(g.t - ft), g.t, x, y) = 1),
ordered AS (SELECT clip, list_sort(list(x)) AS xs, list_sort(list(y)) AS ys FROM gaze GROUP BY clip)
SELECT f.clip, f.frame_id, coalesce(n.x, o.xs[len(o.xs) // 2 + 1]) AS x, coalesce(n.y, o.ys[len(o.ys) // 2 + 1]) AS y,
  CASE WHEN n.x IS NULL THEN 'median' ELSE 'near' END AS how
FROM f LEFT JOIN near n ON n.clip = f.clip AND n.frame_id = f.frame_id JOIN ordered o ON o.clip = f.clip""")
def nearest_sample(t: Tables) -> DataFrame:
    return L.nearest_sample(frames(t), V.gaze(t), 0.05).drop("ft")


@query("fixation_of", FRAMES + """
, s AS (SELECT clip, t AS s0, t + 0.15 AS s1 FROM gaze WHERE x < 0.53)
SELECT f.clip, f.frame_id, min(s0) AS inside_start FROM f LEFT JOIN s ON s.clip = f.clip AND ft BETWEEN s0 AND s1
GROUP BY f.clip, f.frame_id""")
def fixation_of(t: Tables) -> DataFrame:
    steady = V.gaze(t).where("x < 0.53").select("clip", F.col("t").alias("s0"), (F.col("t") + 0.15).alias("s1"))
    return L.interval_of(frames(t), steady, "ft", ("s0", "s1"), ["clip", "frame_id"], 0.5, ["clip"]).drop("ft")


@query("segment_transcripts", V.with_views("captions") + """
, d AS (SELECT DISTINCT stream, day FROM captions),
g AS (SELECT stream, day, unnest(range(0, 4)) AS segment FROM d),
s AS (SELECT stream, day, segment, segment * 21700 AS a, least(segment * 21700 + 21700, 86400) AS b FROM g)
SELECT s.stream, s.day, s.segment, count(c.id) AS n,
       coalesce(string_agg(c.text, '|' ORDER BY c.start_sec, c.id), '') AS said
FROM s LEFT JOIN captions c ON c.stream = s.stream AND c.day = s.day AND c.start_sec < b AND c.start_sec + 30 > a
GROUP BY s.stream, s.day, s.segment""")
def segment_transcripts(t: Tables) -> DataFrame:
    c = V.captions(t).select("stream", "day", "id", "text", "start_sec", (F.col("start_sec") + 30).alias("end_sec"))
    lengths = c.select("stream", "day").distinct().withColumn("duration", F.lit(86400))
    grid = L.segment_grid(lengths, ["stream", "day"], "duration", 21700)
    out = L.attach_texts(grid, c, ("seg_start", "seg_end"), ("start_sec", "end_sec"),
                         ["stream", "day", "segment"], ["start_sec", "id"], F.col("text"), 21700,
                         ["stream", "day"], strict=True)
    return out.select("stream", "day", "segment", F.size("texts").alias("n"), F.array_join("texts", "|").alias("said"))


@query("sync_windows", V.with_views("captions") + """
, files AS (SELECT day, start_sec // 30 AS w, arg_min(id, (start_sec, id)) AS file FROM captions WHERE text = 'view' GROUP BY ALL),
r AS (SELECT day, start_sec // 30 AS w, id, text FROM captions WHERE start_sec % 30 + 10 <= 30)
SELECT r.day, r.w * 30 AS window_start, any_value(f.file) AS file, count(*) AS n FROM r JOIN files f ON f.day = r.day AND f.w = r.w
GROUP BY r.day, r.w""")
def sync_windows(t: Tables) -> DataFrame:
    c = V.captions(t)
    files = c.where("text = 'view'").select("day", F.col("start_sec").alias("f_start"), F.col("id").alias("file"))
    rows = c.select("day", F.col("start_sec").alias("r_start"), (F.col("start_sec") + 10).alias("r_end"))
    out = L.synced_windows(files, rows, 30, ["day"])
    return out.groupBy("day", (F.col("window") * 30).alias("window_start")).agg(
        F.max("file").alias("file"), F.count(F.lit(1)).alias("n"))


@query("action_overlap", PC + """
, a AS (SELECT clip, cs, ce, CASE WHEN value >= 50 THEN clip_text
        WHEN clip_text <> 'error' AND value >= 10 THEN clip_text || ' item' || CAST(floor(value) AS BIGINT)
        WHEN clip_text <> 'error' THEN clip_text
        WHEN value >= 10 THEN 'item' || CAST(floor(value) AS BIGINT) END AS txt FROM clips)
SELECT p.qid, count(a.txt) AS n, coalesce(string_agg(a.txt, '|' ORDER BY a.cs, a.clip), '') AS actions
FROM points p LEFT JOIN a ON p.target <= a.ce AND p.target + 20 >= a.cs GROUP BY p.qid""")
def action_overlap(t: Tables) -> DataFrame:
    noun = F.when(F.col("value") >= 10, F.concat(F.lit("item"), F.floor("value").cast("string"))).otherwise("none")
    verb = F.when(F.col("clip_text") == "error", "none").otherwise(F.col("clip_text"))
    label = L.action_text(F.when(F.col("value") >= 50, F.col("clip_text")), verb, noun)
    acts = V.clips(t).select("clip", "cs", "ce", label.alias("label"))
    segs = V.points(t).select("qid", "target", (F.col("target") + 20).alias("until"))
    out = L.attach_texts(segs, acts, ("target", "until"), ("cs", "ce"), ["qid"], ["cs", "clip"], F.col("label"), 300)
    return out.select("qid", F.size("texts").alias("n"), F.array_join("texts", "|").alias("actions"))


@query("stream_slice", V.with_views("captions") + """
SELECT c.id AS clip, count(*) AS n, CAST(sum(s.start_sec - c.start_sec) AS BIGINT) AS rel_sum
FROM captions c JOIN captions s ON s.day = c.day AND s.start_sec - c.start_sec BETWEEN 0 AND 31
WHERE c.text <> 'view' GROUP BY c.id""")
def stream_slice(t: Tables) -> DataFrame:
    c = V.captions(t)
    cut_out, _ = L.slice_streams(c.select("day", F.col("id").alias("clip"), F.col("start_sec").alias("c_start")),
                                 c.where("text = 'view'").select(F.col("id").alias("clip")),
                                 c.select("day", F.col("start_sec").alias("t")), ["day"])
    return cut_out.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.sum("rel").cast("bigint").alias("rel_sum"))


@query("rebase_clock", V.with_views("gaze") + """
, g AS (SELECT sid, clip, CASE WHEN sid % 17 = 0 THEN -1.0 WHEN clip % 3 = 0 THEN t ELSE t * 10 + clip END AS t FROM gaze),
e AS (SELECT clip, min(t) AS t0, max(t) AS t1 FROM g WHERE t >= 0 GROUP BY clip)
SELECT g.sid, CASE WHEN t0 IS NULL OR (t0 <= 35 AND t1 <= 40) THEN t WHEN t < 0 THEN -1 ELSE t - t0 END AS t
FROM g LEFT JOIN e ON e.clip = g.clip""")
def rebase_clock(t: Tables) -> DataFrame:
    mixed = (F.when(F.col("sid") % 17 == 0, -1.0).when(F.col("clip") % 3 == 0, F.col("t"))
             .otherwise(F.col("t") * 10 + F.col("clip")))
    return L.rebase_clock(V.gaze(t).select("sid", "clip", mixed.alias("t"))).select("sid", "t")


@query("lookup_fallback", V.with_views("captions", "clips") + """
, k AS (SELECT CASE label % 3 WHEN 0 THEN '' WHEN 1 THEN 'v/' ELSE 't' END || vec_id AS k FROM embeddings)
SELECT c.clip, coalesce(a.k, b.k, d.k) AS vec_key,
       CASE WHEN a.k IS NOT NULL THEN 0 WHEN b.k IS NOT NULL THEN 1 WHEN d.k IS NOT NULL THEN 2 END AS how
FROM clips c LEFT JOIN k a ON a.k = CAST(c.clip AS VARCHAR) LEFT JOIN k b ON b.k = 'v/' || (c.clip % 700)
LEFT JOIN k d ON d.k = 't' || (c.clip % 900)""")
def lookup_fallback(t: Tables) -> DataFrame:
    store = t.embeddings.select(F.concat(
        F.when(F.col("label") % 3 == 0, "").when(F.col("label") % 3 == 1, "v/").otherwise("t"),
        F.col("vec_id").cast("string")).alias("vec_key"))
    clip = F.col("clip")
    keys = [clip.cast("string"), F.concat(F.lit("v/"), (clip % 700).cast("string")),
            F.concat(F.lit("t"), (clip % 900).cast("string"))]
    return L.first_known_key(V.clips(t), "clip", keys, store, "vec_key")


@query("caption_triples", V.with_views("captions") + """
, last AS (SELECT * FROM captions QUALIFY row_number() OVER (PARTITION BY day, start_time ORDER BY id DESC) = 1),
res AS (SELECT DISTINCT md5(text) AS chunk, length(text) AS n FROM captions WHERE text <> 'error')
SELECT CAST(day || start_time AS BIGINT) AS ts, id, coalesce(n, 0) AS n_triples, n IS NULL AS missing
FROM last LEFT JOIN res ON chunk = md5(text)""")
def caption_triples(t: Tables) -> DataFrame:
    c = V.captions(t).select("id", K.ts_key("date", "start_time").alias("ts"), F.md5("text").alias("chunk"))
    res = (V.captions(t).where("text <> 'error'").groupBy(F.md5("text").alias("chunk"))
           .agg(F.first(F.length("text")).alias("n")))
    out = L.caption_results(c, res, "chunk", "ts", "id")
    return out.select("ts", "id", F.coalesce("n", F.lit(0)).alias("n_triples"), "missing")


@query("incremental_anti", """
SELECT doc_id, md5(text) AS chunk FROM documents
WHERE md5(text) NOT IN (SELECT md5(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id)""")
def incremental_anti(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.md5("text").alias("chunk"))
    done = docs.join(t.labels.select("doc_id"), "doc_id").select("chunk")
    return L.pending(docs, done, ["chunk"]).select("doc_id", "chunk")


PAIRS = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
s AS (SELECT a.vec_id AS qid, b.vec_id AS rid, a.label AS ql, b.label AS rl,
             round(list_cosine_similarity(a.vec, b.vec), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id)
"""


@query("exclude_seen", PAIRS + """
, top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) <= 10)
SELECT qid, rid, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank
FROM top WHERE ql <> rl QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) <= 5""")
def exclude_seen(t: Tables) -> DataFrame:
    """Hits of the query's own label count as returned in an earlier round."""
    v = V.vecs(t)
    q = v.select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec"))
    r = v.select(F.col("vec_id").alias("rid"), "vec")
    hits = topk(q, r, 10, ["qid"], "rid", not_same="qid")
    labels = t.embeddings.select(F.col("vec_id").alias("rid"), F.col("label").alias("rl"))
    ql = labels.select(F.col("rid").alias("qid"), F.col("rl").alias("ql"))
    seen = hits.join(labels, "rid").join(ql, "qid").where("ql = rl").select("qid", "rid")
    out = L.unseen_top(hits, seen, ["qid"], "rid", 5)
    return out.select("qid", "rid", F.round("score", 6).alias("score"), "rank")


@query("text_reverse_lookup", """
SELECT doc_id, max(doc_id) OVER (PARTITION BY md5(text)) AS last_id FROM documents""")
def text_reverse_lookup(t: Tables) -> DataFrame:
    last = L.last_with_text(t.documents, "text", "doc_id").withColumnRenamed("last", "last_id")
    hits = t.documents.select("doc_id", F.sha2("text", 256).alias("text_key"))
    return hits.join(last, "text_key").select("doc_id", "last_id")


@query("rekey_vectors", V.with_views("captions", "clips") + """
, pool AS (SELECT clip * 2 AS vec_id, date || '_' || start_time || '_' || clip AS new_key FROM clips)
SELECT e.vec_id, coalesce(p.new_key, '-') AS new_key, p.new_key IS NOT NULL AS known
FROM embeddings e LEFT JOIN pool p ON p.vec_id = e.vec_id""")
def rekey_vectors(t: Tables) -> DataFrame:
    pool = V.clips(t).select((F.col("clip") * 2).alias("vec_id"), F.concat_ws(
        "_", "date", "start_time", F.col("clip").cast("string")).alias("new_key"))
    known, unknown = L.rekeyed(t.embeddings.select("vec_id"), pool, "vec_id", "new_key")
    return known.withColumn("known", F.lit(True)).unionByName(
        unknown.withColumn("new_key", F.lit("-")).withColumn("known", F.lit(False)))
