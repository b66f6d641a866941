"""Sources and sinks: a view of the tables is written in each format and read back through its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timekeys as K
from ..session import scratch
from ..sources import captions as C
from ..sources import corpora as Q
from ..sources import gaze as Z
from ..sources import sinks as W
from . import views as V
from .registry import Tables, query

CAP, GAZE = V.with_views("captions"), V.with_views("gaze")
SCALE = {"click": "30sec", "view": "3min", "purchase": "10min", "error": "1h"}


@query("src_captions", CAP + """
, s AS (SELECT *, CASE text WHEN 'click' THEN '30sec' WHEN 'view' THEN '3min' WHEN 'purchase' THEN '10min' WHEN 'error' THEN '1h' END AS scale,
   row_number() OVER (PARTITION BY text, day ORDER BY start_sec, id) - 1 AS pos FROM captions)
SELECT scale || '_' || pos AS id, scale AS granularity, pos, date, start_time, 'u' || stream || '.mp4' AS video_path FROM s WHERE scale IS NOT NULL""")
def src_captions(t: Tables) -> DataFrame:
    """One array file per scale and day; event types without a scale become an unknown scale, which is skipped."""
    c = V.captions(t)
    scale = F.lit("other")
    for text, name in SCALE.items():
        scale = F.when(F.col("text") == text, name).otherwise(scale)
    item = F.to_json(F.struct("start_sec", "id", "text", "start_time", F.col("start_time").alias("end_time"), "date",
                              F.concat(F.lit("u"), F.col("stream").cast("string"), F.lit(".mp4")).alias("video_path")))
    of_file = Window.partitionBy("scale", "day").orderBy("start_sec", "id")     # the order in which the lines are written, too
    first, last = F.lag(F.lit(1)).over(of_file).isNull(), F.lead(F.lit(1)).over(of_file).isNull()
    lines = c.withColumn("scale", scale).select(
        F.concat(F.when(first, "[").otherwise(""), item, F.when(last, "]").otherwise(",")).alias("value"), "scale", "day")
    path = scratch(t.spark, "captions")
    lines.write.partitionBy("scale", "day").text(path)
    read = C.read_captions(t.spark, {s: f"{path}/scale={s}" for s in (*SCALE.values(), "other")})
    return read.select("id", "granularity", "pos", "date", "start_time", "video_path")


@query("src_semantic_snapshots", V.with_views("captions", "clips") + """
, s AS (SELECT day * 1000 AS ts, clip, clip_text, value, row_number() OVER (PARTITION BY day ORDER BY cs, clip) - 1 AS pos FROM clips)
SELECT ts, 'semantic_' || ts || '_' || pos AS id, 'u' || clip AS s, clip_text AS p, CAST(floor(value) AS BIGINT) || '' AS o FROM s WHERE value >= 10""")
def src_semantic_snapshots(t: Tables) -> DataFrame:
    """Daily snapshots in one file per day; triples of small values have two parts only."""
    c = V.clips(t)
    subject, value = F.concat(F.lit("u"), F.col("clip").cast("string")), F.floor("value").cast("string")
    triple = F.when(F.col("value") >= 10, F.array(subject, "clip_text", value)).otherwise(F.array(subject, "clip_text"))
    days = c.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("cs", "clip", triple.alias("t")))).alias("a"))
    body = F.struct(F.transform("a", lambda x: x["t"]).alias("consolidated_semantic_triples"))
    path = scratch(t.spark, "snapshots")
    days.select(F.to_json(F.create_map((F.col("day") * 1000).cast("string"), body)).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return C.read_snapshots(t.spark, path)


@query("src_caption_jsonl", CAP + """
SELECT 'cap-' || stream || '-' || start_sec || '-' || (start_sec + 30) AS custom_id, CAST(start_sec AS INTEGER) AS "start", CAST(start_sec + 30 AS INTEGER) AS "end", text, 'caption' AS type FROM captions""")
def src_caption_jsonl(t: Tables) -> DataFrame:
    c = V.captions(t)
    path = scratch(t.spark, "dense")
    c.select(F.concat_ws("-", F.lit("cap"), F.col("stream").cast("string"), F.col("start_sec").cast("string"),
                         (F.col("start_sec") + 30).cast("string")).alias("custom_id"), F.col("text").alias("translated_text")).write.json(path)
    return C.read_dense_captions(t.spark, path)


@query("src_srt", CAP + """
, s AS (SELECT *, start_sec % 3600 AS a, start_sec // 3600 AS h FROM captions)
SELECT CAST(h * 10000 + a // 60 * 100 + a % 60 AS INTEGER) AS "start", 'said ' || text || ' ' || id AS last_line, round(a + (id % 1000) / 1000.0, 3) AS start_sec,
  CASE WHEN value < 100 THEN 'zh' || id || ' ' ELSE '' END || 'said ' || text || ' ' || id AS joined FROM s""")
def src_srt(t: Tables) -> DataFrame:
    """Hourly subtitle files named by their hour; small values have a second language above the last line."""
    c = V.captions(t).withColumn("a", F.col("start_sec") % 3600).withColumn("hour", F.lpad(F.floor(F.col("start_sec") / 3600).cast("string"), 2, "0"))
    said = F.concat(F.lit("said "), "text", F.lit(" "), F.col("id").cast("string"))

    def clock(sec):
        return F.concat(K.clock_text(sec), F.lit(","), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"))

    above = F.when(F.col("value") < 100, F.concat(F.lit("zh"), F.col("id").cast("string"), F.lit("\n"))).otherwise("")
    block = F.concat(F.col("id").cast("string"), F.lit("\n"), clock(F.col("a")), F.lit(" --> "), clock(F.col("a") + 2), F.lit("\n"), above, said)
    path = scratch(t.spark, "srt")
    c.select(block.alias("value"), F.concat(F.lit("rec_"), "hour", F.lit("000000")).alias("file")).write.partitionBy("file").option("lineSep", "\n\n").text(path)
    blocks = C.read_srt(t.spark, path)
    hour = F.regexp_extract("file", r"_(\d{2})\d{6}", 1).cast("int")
    # Both text rules on the same blocks; the text of the block ties them together.
    key = F.element_at(F.split(F.element_at("lines", -1), " "), -1)
    keyed = blocks.withColumn("key", key)
    last = C.srt_last_line(keyed.withColumn("file", F.concat("file", F.lit("#"), "key")), hour)
    joined = C.srt_joined(keyed.withColumn("file", F.concat("file", F.lit("#"), "key")))
    out = last.select("file", "start", F.col("text").alias("last_line")).join(joined.select("file", "start_sec", F.col("text").alias("joined")), "file")
    return out.select("start", "last_line", F.round("start_sec", 3).alias("start_sec"), "joined")


@query("src_gaze_csv", GAZE + """
, p AS (SELECT sid, t, sec, x * 3 - 1.2 AS x, y * 3 - 1 AS y, clip % 3 AS g FROM gaze)
SELECT CAST(sid AS VARCHAR) AS sid, CASE g WHEN 0 THEN 'us' WHEN 1 THEN 'pixels' ELSE 'angles' END AS header_group,
  CASE g WHEN 0 THEN sec WHEN 1 THEN -1 ELSE t END AS t,
  round(least(greatest(CASE WHEN g = 2 THEN 0.5 + 416.590909090909::DOUBLE * tan(x - 0.5) / 960 ELSE x END, 0), 1), 6) AS x,
  round(least(greatest(CASE WHEN g = 2 THEN 0.5 + 416.590909090909::DOUBLE * tan(y - 0.5) / 720 ELSE y END, 0), 1), 6) AS y FROM p""")
def src_gaze_csv(t: Tables) -> DataFrame:
    """Three header groups: microseconds, pixels by frame number, viewing angles."""
    g = V.gaze(t).withColumn("x", F.col("x") * 3 - 1.2).withColumn("y", F.col("y") * 3 - 1)
    base = scratch(t.spark, "gaze-csv")
    part = [g.where(F.col("clip") % 3 == i) for i in range(3)]
    part[0].select("sid", (F.col("sec") * 1000000).alias("tracking_timestamp_us"), F.col("x").alias("Gaze_X"), F.col("y").alias("Gaze_Y"), F.lit("n/a").alias("note")).write.option("header", True).csv(f"{base}/us")
    part[1].select("sid", F.col("sid").alias("frame"), (F.col("x") * 960).alias("X_Pixel"), (F.col("y") * 720).alias("Y_Pixel")).write.option("header", True).csv(f"{base}/pixels")
    part[2].select("sid", F.col("t").alias("t_in_clip_sec"), (F.col("x") - 0.5).alias("yaw_rad"), (F.col("y") - 0.5).alias("pitch_rad")).write.option("header", True).csv(f"{base}/angles")
    out = Z.read_csv(t.spark, {n: f"{base}/{n}" for n in ("us", "pixels", "angles")}, 960, 720, ["sid"])
    return out.select("sid", "header_group", "t", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("src_gaze_json", GAZE + """
SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY t, sid) - 1 AS pos, CASE WHEN clip % 4 = 2 THEN -1 ELSE t END AS t, x, y FROM gaze""")
def src_gaze_json(t: Tables) -> DataFrame:
    """Four shapes: object with objects, bare list of [t, x, y], object with [x, y] pairs, other field names. A file holds many clips."""
    g = V.gaze(t)
    pts = F.array_sort(F.collect_list(F.struct("t", "sid", "x", "y")))
    docs = g.groupBy("clip").agg(pts.alias("p"))

    def shape(fn):
        return F.transform("p", fn)

    forms = [F.to_json(F.struct(shape(lambda v: F.struct(v["t"].alias("t"), v["x"].alias("x"), v["y"].alias("y"))).alias("gaze"))),
             F.to_json(shape(lambda v: F.array(v["t"], v["x"], v["y"]))),
             F.to_json(F.struct(shape(lambda v: F.array(v["x"], v["y"])).alias("points"))),
             F.to_json(F.struct(shape(lambda v: F.struct(v["t"].alias("time"), v["x"].alias("gaze_x"), v["y"].alias("gaze_y"))).alias("samples")))]
    text = forms[3]
    for i in range(3):
        text = F.when(F.col("clip") % 4 == i, forms[i]).otherwise(text)
    path = scratch(t.spark, "gaze-json")
    key = F.coalesce(F.col("clip").cast("string"), F.lit(""))
    docs.select(F.concat(key, F.lit("\t"), text).alias("value")).write.text(path)
    out = Z.read_keyed_json(t.spark, path, 960, 720)
    return out.select(F.col("clip").try_cast("bigint").alias("clip"), "pos", "t", "x", "y")


@query("src_gaze_vendor", GAZE + """
, p AS (SELECT clip, sid, t, CASE WHEN sid % 11 = 0 THEN NULL ELSE x * 3 - 1.2 END AS x, y * 3 - 1 AS y, (sid % 100) / 100.0::DOUBLE AS c FROM gaze),
n AS (SELECT clip, CAST(floor(max(t) * 5) AS BIGINT) AS last FROM p GROUP BY clip),
g AS (SELECT clip, unnest(range(0, last + 1)) AS frame FROM n),
f AS (SELECT clip, CAST(floor(t * 5) AS BIGINT) AS frame, list_reduce(list(x ORDER BY sid), lambda a, b: (a + b) / 2) AS x, list_reduce(list(y ORDER BY sid), lambda a, b: (a + b) / 2) AS y,
   arg_max(CASE WHEN c >= 0.9 THEN 1 WHEN c >= 0.5 THEN 2 ELSE 3 END, sid) AS k FROM p WHERE x IS NOT NULL GROUP BY clip, frame),
j AS (SELECT g.clip, g.frame, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(k, 0) AS k FROM g LEFT JOIN f ON f.clip = g.clip AND f.frame = g.frame)
SELECT 'confidence' AS vendor, clip, frame, least(greatest(x, 0), 1) AS px, least(greatest(y, 0), 1) AS py, CASE WHEN x < 0 OR x > 1 OR y < 0 OR y > 1 THEN 4 ELSE k END AS gaze_type FROM j
UNION ALL SELECT 'pixels', clip, sid, CASE WHEN x IS NULL THEN 0.5 ELSE x * 896 / 896 END, CASE WHEN x IS NULL THEN 0.5 ELSE y * 504 / 504 END,
  CASE WHEN sid % 7 = 0 OR x IS NULL THEN 0 WHEN x < 0 OR x > 1 OR y < 0 OR y > 1 THEN 4 ELSE 1 END FROM p
UNION ALL SELECT 'flags', clip, sid, least(greatest(x, 0), 1), least(greatest(y, 0), 1), CASE WHEN sid % 7 = 0 THEN 0 WHEN x < 0 OR x > 1 OR y < 0 OR y > 1 THEN 4 ELSE 1 END FROM p WHERE x IS NOT NULL
UNION ALL SELECT 'tracker', clip, frame, least(greatest(tx, 0), 1279) / 1280, least(greatest(ty, 0), 959) / 960, k FROM
  (SELECT clip, CAST(floor(t * 5) AS BIGINT) AS frame, list_reduce(list(x * 1280 ORDER BY sid), lambda a, b: (a + b) / 2) AS tx, list_reduce(list(y * 960 ORDER BY sid), lambda a, b: (a + b) / 2) AS ty,
   arg_max(CASE sid % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END, sid) AS k FROM p WHERE x IS NOT NULL GROUP BY clip, frame)""")
def src_gaze_vendor(t: Tables) -> DataFrame:
    p = V.gaze(t).select("clip", "sid", "t", F.when(F.col("sid") % 11 != 0, F.col("x") * 3 - 1.2).alias("x"), (F.col("y") * 3 - 1).alias("y"),
                         ((F.col("sid") % 100) / F.lit(100.0)).alias("confidence"))
    path = scratch(t.spark, "gaze-device")
    p.write.parquet(path)
    p = t.spark.read.parquet(path)
    valid = F.col("sid") % 7 != 0
    inside = F.col("x").between(0, 1) & F.col("y").between(0, 1)
    conf = Z.confidence_frames(p, "clip", "sid", 5).withColumn("vendor", F.lit("confidence"))
    px = Z.pixel_frames(p.select("clip", F.col("sid").alias("frame"), (F.col("x") * 896).alias("u"), F.when(F.col("x").isNotNull(), F.col("y") * 504).alias("v"),
                                 valid.alias("valid"), F.coalesce(inside, F.lit(False)).alias("in_frame")), 896, 504).withColumn("vendor", F.lit("pixels"))
    known = p.where("x IS NOT NULL")
    fl = Z.flagged_frames(known.select("clip", F.col("sid").alias("frame"), "x", "y", valid.cast("int").alias("validity"))).withColumn("vendor", F.lit("flags"))
    label = F.when(F.col("sid") % 3 == 0, "Fixation").when(F.col("sid") % 3 == 1, "Saccade").otherwise("Blink")
    tr = Z.tracker_frames(known.select("clip", F.floor(F.col("t") * 5).alias("frame"), "sid", (F.col("x") * 1280).alias("x"), (F.col("y") * 960).alias("y"), label.alias("label")),
                          "clip", "sid", 1280, 960).withColumn("vendor", F.lit("tracker"))
    columns = ["vendor", "clip", "frame", "px", "py", "gaze_type"]
    return conf.select(*columns).unionByName(px.select(*columns)).unionByName(fl.select(*columns)).unionByName(tr.select(*columns))


@query("src_event_links", """
WITH c AS (SELECT o_orderkey AS k, o_orderkey % 20 + 5 AS day, o_orderkey * 7919 % 80000 AS s, o_custkey % 3 AS back, o_custkey * 13 % 70000 AS ps, o_orderpriority AS pr, o_orderstatus AS st FROM orders),
e AS (SELECT 0 AS part, k, 0 AS i, CASE WHEN pr = '1-URGENT' THEN 'task_reminder' ELSE 'memory_recall' END AS type, day, s, day - back AS pday, ps, CASE WHEN pr = '2-HIGH' THEN 'speakers_say' ELSE 'i_do_steps' END AS source, 'saw ' || k AS q FROM c
  UNION ALL SELECT 1, k, CAST(l_i AS INT), 'long_term_link', day, s, day - back - l_i, ps, 'unknown', 'link ' || k || '/' || l_i FROM (SELECT *, unnest(range(0, 2)) AS l_i FROM c WHERE st = 'P')),
g AS (SELECT *, (day - pday) * 86400 + s - (ps + 2) AS gap FROM e)
SELECT row_number() OVER (ORDER BY part, k, i) AS "ID", type, q AS question, source = 'speakers_say' AS need_audio, CAST(gap AS BIGINT) AS gap_sec,
  CASE WHEN day - pday <= 0 THEN '0' WHEN day - pday = 1 THEN '1' ELSE '2+' END AS gap_bin,
  CASE WHEN type = 'long_term_link' THEN 'long_ago' WHEN type = 'task_reminder' THEN CASE WHEN gap < 120 THEN 'just_before' ELSE 'minutes_before' END WHEN source = 'i_do_steps' THEN 'own_action' ELSE 'heard_speech' END AS "group" FROM g""")
def src_event_links(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    day, s, ps = k % 20 + 5, k * 7919 % 80000, F.col("o_custkey") * 13 % 70000

    def window(d, a, b):
        return F.concat(F.lit("DAY"), d.cast("string"), F.lit(" "), K.clock_text(a), F.lit("-"), K.clock_text(b))

    back = F.col("o_custkey") % 3
    now = window(day, s, s + 2)
    links = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.struct(
        window(day - back - i, ps, ps + 2).alias("past_time_window"),
        F.concat(F.lit(" link "), k.cast("string"), F.lit("/"), i.cast("string"), F.lit(" ")).alias("memory_key")))
    base = scratch(t.spark, "event-links")
    t.orders.select(k.alias("key"), now.alias("current_time_window"), window(day - back, ps, ps + 2).alias("past_time_window"),
                    F.concat(F.lit("saw "), k.cast("string")).alias("past_observation"),
                    F.when(F.col("o_orderpriority") == "2-HIGH", "speakers_say").otherwise("i_do_steps").alias("past_supporting_source"),
                    F.when(F.col("o_orderpriority") != "1-URGENT", "memory_recall").alias("recall_type")).write.json(f"{base}/episodic")
    t.orders.where("o_orderstatus = 'P'").select(k.alias("key"), now.alias("current_time_window"), links.alias("linked_past_events")).write.json(f"{base}/long_term")
    ep = t.spark.read.schema("key bigint, current_time_window string, past_time_window string, past_observation string, past_supporting_source string, recall_type string").json(f"{base}/episodic")
    lt = t.spark.read.schema("key bigint, current_time_window string, linked_past_events array<struct<past_time_window: string, memory_key: string>>").json(f"{base}/long_term")
    return Q.linked_questions(ep, lt, "key").select("ID", "type", "question", "need_audio", F.col("gap_sec").cast("bigint").alias("gap_sec"), "gap_bin", "group")


@query("src_mcq_reformat", """
SELECT p_partkey AS "ID", p_name AS choice_a, p_brand AS choice_b, CASE WHEN p_size > 20 THEN p_type ELSE '' END AS choice_c, '' AS choice_d FROM part WHERE p_type <> 'PROMO'""")
def src_mcq_reformat(t: Tables) -> DataFrame:
    two = F.array(F.concat(F.lit("A. "), "p_name"), F.concat(F.lit("B) "), "p_brand"))
    options = F.when(F.col("p_size") > 20, F.concat(two, F.array(F.concat(F.lit("C.  "), "p_type")))).otherwise(two)
    path = scratch(t.spark, "mcq")
    t.part.select(F.col("p_partkey").alias("ID"), F.when(F.col("p_type") == "PROMO", "short").otherwise("long").alias("duration"), options.alias("options")).write.parquet(path)
    out = Q.flat_choices(t.spark.read.parquet(path), "long")
    return out.select("ID", "choice_a", "choice_b", "choice_c", "choice_d")


@query("src_qrels", """
SELECT l_orderkey AS qid, l_partkey AS docid, max(CAST(floor(l_discount * 100) AS BIGINT) % 4) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE CAST(floor(l_discount * 100) AS BIGINT) % 4 > 0 AND o_orderstatus = 'F' GROUP BY ALL""")
def src_qrels(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("docid"), (F.floor(F.col("l_discount") * 100) % 4).alias("score"))
    queries = t.orders.select(F.col("o_orderkey").alias("qid"), F.col("o_orderstatus").alias("language"))
    return Q.qrels(rows, "qid", "docid", "score", queries, "F")


@query("src_multihop_gold", """
WITH d AS (SELECT conv_id, turn, role AS title, text FROM conversations),
a AS (SELECT DISTINCT 'facts' AS layout, conv_id, title || chr(10) || text || ' end' AS doc FROM d WHERE title = 'user'),
b AS (SELECT DISTINCT 'contexts', conv_id, title || chr(10) || text FROM d WHERE turn % 2 = 1),
c AS (SELECT DISTINCT 'paragraphs', conv_id, title || chr(10) || text FROM d WHERE turn % 3 <> 1)
SELECT layout, conv_id, md5(doc) AS doc FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def src_multihop_gold(t: Tables) -> DataFrame:
    """Conversations in the three nested layouts, through JSON files."""
    c = t.conversations
    n = F.col("turn")
    facts = F.collect_list(F.struct(F.col("role").alias("title"), F.array("text", F.lit("end")).alias("sentences")))
    ctx = F.collect_list(F.struct(F.col("role").alias("title"), "text", (n % 2 == 1).alias("is_supporting")))
    mark = F.when(n % 3 == 1, F.lit(False)).when(n % 3 == 2, F.lit(True))
    par = F.collect_list(F.struct(F.col("role").alias("title"), F.when(n % 2 == 0, F.col("text")).alias("text"), F.when(n % 2 == 1, F.col("text")).alias("paragraph_text"), mark.alias("is_supporting")))
    path = scratch(t.spark, "multihop")
    c.groupBy("conv_id").agg(facts.alias("context"), ctx.alias("contexts"), par.alias("paragraphs")).write.json(path)
    schema = ("conv_id bigint, context array<struct<title: string, sentences: array<string>>>, contexts array<struct<title: string, text: string, is_supporting: boolean>>, "
              "paragraphs array<struct<title: string, text: string, paragraph_text: string, is_supporting: boolean>>")
    r = t.spark.read.schema(schema).json(path)
    parts = [("facts", Q.gold_from_facts("context", F.array(F.lit("user")), " ")), ("contexts", Q.gold_from_contexts("contexts")), ("paragraphs", Q.gold_from_paragraphs("paragraphs"))]
    layouts = F.array(*[F.struct(F.lit(name).alias("layout"), docs.alias("docs")) for name, docs in parts])
    return r.select("conv_id", F.explode(layouts).alias("l")).select("l.layout", "conv_id", F.explode("l.docs").alias("doc")).withColumn("doc", F.md5("doc"))


@query("src_subset_union", "SELECT doc_id, 'sub_' || lang AS subset FROM documents WHERE lang IN ('en', 'fr', 'de')")
def src_subset_union(t: Tables) -> DataFrame:
    return Q.subset_union({f"sub_{lang}": t.documents.where(F.col("lang") == lang).select("doc_id") for lang in ("en", "fr", "de")})


@query("src_keep_list", """
WITH f AS (SELECT p_partkey, 'v/' || (p_partkey % 1500) || CASE p_size % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MKV' ELSE '.txt' END AS path, p_size % 3 < 2 AS ok FROM part),
w AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P')
SELECT p_partkey, path, ok AND (p_partkey % 1500) IN (SELECT id FROM w) AS kept FROM f""")
def src_keep_list(t: Tables) -> DataFrame:
    form = F.col("p_size") % 3
    path = F.concat(F.lit("v/"), (F.col("p_partkey") % 1500).cast("string"), F.when(form == 0, ".mp4").when(form == 1, ".MKV").otherwise(".txt"))
    wanted = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    keep, drop = Q.keep_list(t.part.select("p_partkey", path.alias("path")), "path", wanted, "id", [".mp4", ".mkv"])
    return keep.withColumn("kept", F.lit(True)).unionByName(drop.withColumn("kept", F.lit(False)))


@query("sink_partitioned", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def sink_partitioned(t: Tables) -> DataFrame:
    path = scratch(t.spark, "by-source")
    W.write_partitioned(t.documents.select("doc_id", "source", "n_chars", "text"), "source", path)
    return t.spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("sink_results", """
SELECT 'json' AS kind, l.doc_id AS qid, CAST(quality AS INT) AS ok FROM labels l UNION ALL SELECT 'csv', l.doc_id, CAST(quality AS INT) FROM labels l
UNION ALL SELECT 'predictions', l.doc_id, CAST(toxic AS INT) FROM labels l UNION ALL SELECT 'scores', count(*), CAST(sum(quality) AS INT) FROM labels""")
def sink_results(t: Tables) -> DataFrame:
    rows = t.labels.select(F.col("doc_id").alias("qid"), F.col("quality").cast("int").alias("ok"))
    preds = t.labels.select(F.col("doc_id").alias("qid"), F.col("toxic").cast("int").alias("ok"))
    scores = rows.agg(F.count(F.lit(1)).alias("qid"), F.sum("ok").cast("int").alias("ok"))
    at = W.write_results(rows, scores, preds, scratch(t.spark, "results"))
    schema = "qid bigint, ok int"
    read = {"json": t.spark.read.schema(schema).json(at["questions_json"]), "csv": t.spark.read.schema(schema).option("header", True).csv(at["questions_csv"]),
            "predictions": t.spark.read.schema(schema).json(at["predictions_jsonl"]), "scores": t.spark.read.schema(schema).json(at["scores_json"])}
    out = None
    for kind, df in read.items():
        part = df.select(F.lit(kind).alias("kind"), "qid", "ok")
        out = part if out is None else out.unionByName(part)
    return out
