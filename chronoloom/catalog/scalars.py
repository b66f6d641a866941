"""Projections, predicates and scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gaze as G
from ..functions import grading as M
from ..functions import text as X
from ..functions import timekeys as K
from . import views as V
from .registry import Tables, query

CAP = V.with_views("captions")


@query("ts_key", CAP + """
SELECT id, CAST(day || start_time AS BIGINT) AS ts_start,
       CAST(day || '00' || substr(start_time, 1, 6) AS BIGINT) AS ts_short FROM captions""")
def ts_key(t: Tables) -> DataFrame:
    return V.captions(t).select("id", K.ts_key("date", "start_time").alias("ts_start"),
                                K.ts_key("date", F.substring("start_time", 1, 6)).alias("ts_short"))


@query("ts_display", CAP + """
SELECT id, 'DAY' || day || ' ' || substr(start_time, 1, 2) || ':' || substr(start_time, 3, 2) || ':'
           || substr(start_time, 5, 2) AS shown, CAST(id AS VARCHAR) AS short FROM captions""")
def ts_display(t: Tables) -> DataFrame:
    return V.captions(t).select("id", K.ts_display(K.ts_key("date", "start_time")).alias("shown"),
                                K.ts_display("id").alias("short"))


@query("ts_to_seconds", CAP + """
SELECT id, start_sec AS clock, day * 86400 + start_sec + (id % 100) / 100.0 AS week,
       substr(start_time, 1, 6) || '00' AS back FROM captions""")
def ts_to_seconds(t: Tables) -> DataFrame:
    fine = F.concat(F.substring("start_time", 1, 6), F.lpad((F.col("id") % 100).cast("string"), 2, "0"))
    clock = K.clock_seconds(fine)
    return V.captions(t).select("id", clock.cast("bigint").alias("clock"),
                                K.week_seconds("date", fine).alias("week"),
                                K.seconds_to_clock(clock).alias("back"))


@query("clock_carry", CAP + """
, g AS (SELECT id, start_sec // 30 * 30 AS s0, start_sec // 30 * 30 + 30 AS s1 FROM captions)
SELECT id, CAST(s1 // 3600 * 1000000 + s1 % 3600 // 60 * 10000 + s1 % 60 * 100 AS BIGINT) AS next_stamp FROM g""")
def clock_carry(t: Tables) -> DataFrame:
    stamp = K.seconds_to_clock(F.floor(F.col("start_sec") / 30) * 30).cast("bigint")
    return V.captions(t).select("id", K.clock_carry(stamp + 3000).alias("next_stamp"))


@query("caption_time_format", CAP + """
, s AS (SELECT id, start_sec + value AS sec FROM captions),
w AS (SELECT id, sec, CAST(floor(sec + 1e-9) AS BIGINT) AS a, CAST(ceil(sec - 1e-9) AS BIGINT) AS b,
             CAST(round_even(sec * 1000, 0) AS BIGINT) AS ms FROM s)
SELECT id, printf('%02d%02d%02d00', a // 3600, a % 3600 // 60, a % 60) AS start_text,
       printf('%02d%02d%02d00', b // 3600, b % 3600 // 60, b % 60) AS end_text,
       printf('%02d:%02d:%02d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000)
         || CASE WHEN ms % 1000 = 0 THEN '' ELSE printf('.%03d', ms % 1000) END AS clock FROM w""")
def caption_time_format(t: Tables) -> DataFrame:
    sec = F.col("start_sec") + F.col("value")
    return V.captions(t).select("id", K.caption_start(sec).alias("start_text"),
                                K.caption_end(sec).alias("end_text"), K.clock_text(sec).alias("clock"))


@query("parse_time_range", CAP + """
, q AS (SELECT id, day, start_time, text, substr(start_time, 1, 2) || ':' || substr(start_time, 3, 2) || ':'
          || substr(start_time, 5, 2) AS clock FROM captions)
SELECT id, CASE text WHEN 'click' THEN 'parsed' WHEN 'error' THEN 'parsed' WHEN 'purchase' THEN 'rejected'
            ELSE 'plain' END AS status,
       CASE WHEN text IN ('click', 'error') THEN CAST(day || start_time AS BIGINT) END AS range_start,
       CASE WHEN text IN ('click', 'error') THEN CAST((day + 1) || start_time AS BIGINT) END AS range_end
FROM q""")
def parse_time_range(t: Tables) -> DataFrame:
    c = V.captions(t)
    day, later = F.col("day").cast("string"), (F.col("day") + 1).cast("string")
    clock = K.clock_text("start_sec")
    ask = (F.when(F.col("text") == "click", F.concat(F.lit("what at DAY "), day, F.lit(" "), clock,
                                                     F.lit(" - day"), later, F.lit(" "), clock, F.lit("?")))
           .when(F.col("text") == "error", F.concat(F.lit("DAY"), day, F.lit(" "), clock, F.lit("-DAY"), later,
                                                    F.lit(" "), clock))
           .when(F.col("text") == "purchase", F.concat(F.lit("at DAY"), day, F.lit(" "), clock))
           .otherwise(F.col("text")))
    asked = c.select("id", ask.alias("ask")).withColumn("r", K.time_range("ask"))
    stamps = F.regexp_count("ask", F.lit(K.RANGE_STAMP))
    status = (F.when(K.is_time_range("ask") & F.col("r").isNotNull(), "parsed")
              .when(stamps > 0, "rejected").otherwise("plain"))
    return asked.select("id", status.alias("status"), F.col("r.start").alias("range_start"),
                        F.col("r.end").alias("range_end"))


@query("parse_window", CAP + """
SELECT id, CASE WHEN value >= 5 THEN CAST(day AS INTEGER) END AS day,
       CASE WHEN value >= 5 THEN CAST(start_sec AS INTEGER) END AS start_sec,
       CASE WHEN value >= 5 THEN CAST((start_sec + 2) % 86400 AS INTEGER) END AS end_sec FROM captions""")
def parse_window(t: Tables) -> DataFrame:
    text = F.concat(F.when(F.col("value") >= 5, F.lit("")).otherwise(F.lit("at ")), F.col("date"), F.lit(" "),
                    K.clock_text("start_sec"), F.lit("-"), K.clock_text((F.col("start_sec") + 2) % 86400))
    return V.captions(t).select("id", K.window_parts(text).alias("w")).select(
        "id", "w.day", "w.start_sec", "w.end_sec")


POINTS = V.with_views("points") + """
, marks AS (SELECT qid, status, target, 1 + target // 86400 AS tday, target % 86400 AS ts,
                   1 + (target + cust * 10) // 86400 AS t2day, (target + cust * 10) % 86400 AS ts2 FROM points)
"""


def annotated(t: Tables) -> DataFrame:
    """Annotations of the three shapes: one stamp, a chain of two, an explicit list."""
    p = V.points(t)
    second = F.col("target") + F.col("cust") * 10
    stamp1, stamp2 = K.seconds_to_clock(F.col("target") % 86400), K.seconds_to_clock(second % 86400)
    day1 = (F.floor(F.col("target") / 86400) + 1).cast("bigint")
    day2 = (F.floor(second / 86400) + 1).cast("bigint")
    chain = F.concat(stamp1, F.lit("DAY"), day2.cast("string"), F.lit("_"), stamp2)
    return p.select(
        "qid", "status", F.concat(F.lit("DAY"), day1.cast("string")).alias("date"),
        F.when(F.col("status") == "O", stamp1).when(F.col("status") == "F", chain).alias("time"),
        F.when(F.col("status") == "P", F.array(stamp1, stamp2)).otherwise(
            F.array().cast("array<string>")).alias("time_list"))


@query("target_spans", POINTS + """
SELECT qid, CAST(tday * 86400 + ts AS DOUBLE) AS sec FROM marks
UNION ALL SELECT qid, CAST(t2day * 86400 + ts2 AS DOUBLE) FROM marks WHERE status = 'F'
UNION ALL SELECT qid, CAST(tday * 86400 + ts2 AS DOUBLE) FROM marks WHERE status = 'P'""")
def target_spans(t: Tables) -> DataFrame:
    return annotated(t).select("qid", F.explode(K.target_points("date", "time", "time_list")).alias("sec"))


@query("target_time_legacy", POINTS + """
SELECT qid, CAST(tday * 86400 + ts AS DOUBLE) AS start_sec,
       CAST(CASE status WHEN 'F' THEN t2day * 86400 + ts2 ELSE tday * 86400 + ts END AS DOUBLE) AS end_sec
FROM marks WHERE status <> 'P'""")
def target_time_legacy(t: Tables) -> DataFrame:
    span = annotated(t).select("qid", K.target_span_legacy("date", "time").alias("s"))
    return span.where("s IS NOT NULL").select("qid", F.col("s.start").alias("start_sec"),
                                              F.col("s.end").alias("end_sec"))


@query("gap_bin", V.with_views("points") + """
, g AS (SELECT qid, qt // 86400 - target // 86400 AS days, qt - target AS gap,
        CASE qtype WHEN '1-URGENT' THEN 'long_term_link' WHEN '2-HIGH' THEN 'task_reminder' ELSE 'memory_recall' END AS kind,
        CASE status WHEN 'F' THEN 'i_do_steps' ELSE 'speakers_say' END AS source FROM points)
SELECT qid, CASE WHEN days <= 0 THEN '0' WHEN days = 1 THEN '1' ELSE '2+' END AS gap_bin, gap AS gap_sec,
  CASE WHEN kind = 'long_term_link' THEN 'long_ago'
       WHEN kind = 'task_reminder' THEN CASE WHEN gap < 120 THEN 'just_before' ELSE 'minutes_before' END
       WHEN source = 'i_do_steps' THEN 'own_action' ELSE 'heard_speech' END AS link_group FROM g""")
def gap_bin(t: Tables) -> DataFrame:
    kind = (F.when(F.col("qtype") == "1-URGENT", "long_term_link").when(F.col("qtype") == "2-HIGH", "task_reminder")
            .otherwise("memory_recall"))
    source = F.when(F.col("status") == "F", "i_do_steps").otherwise("speakers_say")
    gap = F.col("qt") - F.col("target")
    return V.points(t).select(
        "qid", K.gap_bin(F.floor(F.col("qt") / 86400), F.floor(F.col("target") / 86400)).alias("gap_bin"),
        gap.alias("gap_sec"), K.link_group(kind, gap, source).alias("link_group"))


@query("md5_id", "SELECT doc_id, 'chunk-' || md5(text) AS chunk_id FROM documents")
def md5_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.hash_id("text", "chunk-").alias("chunk_id"))


@query("entity_normalize", """
SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^A-Za-z0-9 ]', ' ', 'g'))) AS entity FROM documents""")
def entity_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.entity_normalize("text")).alias("entity"))


ARTICLE = r"(^|[^\p{L}\p{M}\p{N}_])(a|an|the)($|[^\p{L}\p{M}\p{N}_])"
DUCK_ANSWER = (r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), "
               r"'[!-/:-@\[-`{{-~]', '', 'g'), '" + ARTICLE.replace("{", "{{").replace("}", "}}")
               + r"', '\1 \3', 'g'), '" + ARTICLE.replace("{", "{{").replace("}", "}}")
               + r"', '\1 \3', 'g'), '\s+', ' ', 'g'))")


@query("answer_normalize", f"SELECT doc_id, md5({DUCK_ANSWER.format(c='text')}) AS answer FROM documents")
def answer_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.answer_normalize("text")).alias("answer"))


def _duck_unicode(column: str) -> str:
    out = column
    for ch in X.CONTROLS + X.SOFT_HYPHEN:
        out = f"replace({out}, chr({ord(ch)}), '')"
    for chars, to in ((X.TO_SPACE, " "), (X.TO_HYPHEN, "-"), (X.TO_DOUBLE_QUOTE, '"'), (X.TO_SINGLE_QUOTE, "''"),
                      (X.TO_SLASH, "/")):
        for ch in chars:
            out = f"replace({out}, chr({ord(ch)}), '{to}')"
    for old, to in X.TO_STRING:
        quoted = to.replace("'", "''")
        out = f"replace({out}, '{old}', '{quoted}')"
    return out


@query("unicode_normalize", f"SELECT doc_id, md5({_duck_unicode('text')}) AS clean FROM documents")
def unicode_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.unicode_normalize("text")).alias("clean"))


@query("nfkc_squeeze")
def nfkc_squeeze(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.nfkc_squeeze("text")).alias("clean"))


NOT_WORD = r"(^|[^\p{L}\p{M}\p{N}_])"
END_WORD = r"($|[^\p{L}\p{M}\p{N}_])"


@query("first_person_rewrite", rf"""
WITH d AS (SELECT doc_id, regexp_extract(text, '^[\p{{L}}\p{{N}}]+') AS name, text FROM documents),
a AS (SELECT doc_id, name, name || ': ' || lower(name) || '''s ' || text || ' ' || name AS said FROM d WHERE name <> ''),
b AS (SELECT doc_id, name, regexp_replace(said, '{NOT_WORD}' || name || ':\s*', '\1', 'gi') AS said FROM a),
c AS (SELECT doc_id, name, regexp_replace(said, '{NOT_WORD}' || name || '''s{END_WORD}', '\1my\2', 'gi') AS said FROM b),
e AS (SELECT doc_id, name, regexp_replace(said, '{NOT_WORD}' || name || '{END_WORD}', '\1I\2', 'gi') AS said FROM c)
SELECT doc_id, md5(regexp_replace(said, '{NOT_WORD}' || name || '{END_WORD}', '\1I\2', 'gi')) AS said FROM e""")
def first_person_rewrite(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text", F.regexp_extract("text", r"^[\p{L}\p{N}]+", 0).alias("name"))
    said = F.concat(F.col("name"), F.lit(": "), F.lower("name"), F.lit("'s "), F.col("text"), F.lit(" "), F.col("name"))
    return d.where("name <> ''").select("doc_id", F.md5(X.first_person(said, "name")).alias("said"))


@query("title_text", r"""
WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title,
                  substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents)
SELECT doc_id, md5(CASE WHEN title = '' THEN body ELSE rtrim(title, '. ') || '. ' || body END) AS passage FROM d""")
def title_text(t: Tables) -> DataFrame:
    title = F.split("text", "\n", 2)[0]
    body = F.coalesce(F.get(F.split("text", "\n", 2), F.lit(1)), F.lit(""))
    return t.documents.select("doc_id", F.md5(X.title_text(title, body)).alias("passage"))


@query("path_keys", CAP + """
SELECT id, date || '_P' || stream || '_' || start_time AS clip_key, CAST(start_sec AS DOUBLE) AS start_second,
       CASE WHEN text = 'view' THEN '/old/' ELSE '/mnt/' END || stream || '/' || date || '_P' || stream || '_'
         || start_time || '.mp4' AS new_path FROM captions""")
def path_keys(t: Tables) -> DataFrame:
    c = V.captions(t)
    root = F.when(F.col("text") == "view", "/old/").otherwise("/media/raw/")
    path = F.concat(root, F.col("stream").cast("string"), F.lit("/"), F.col("date"), F.lit("_P"),
                    F.col("stream").cast("string"), F.lit("_"), F.col("start_time"), F.lit(".mp4"))
    return c.select("id", X.file_stem(path).alias("clip_key"), X.clip_start_seconds(path).alias("start_second"),
                    X.remap_prefix(path, "/media/raw/", "/mnt/").alias("new_path"))


MCQ = """
WITH mcq AS (SELECT p_partkey AS qid, p_brand AS ca, p_type AS cb, p_name AS cc,
  CASE WHEN p_size < 10 THEN '' ELSE 'size ' || p_size END AS cd,
  CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS gold,
  CASE p_size % 8 WHEN 0 THEN lower(p_brand) || '.' WHEN 1 THEN '(b) ' || p_type WHEN 2 THEN 'C. ' || p_name
    WHEN 3 THEN 'I think about A, but I will pick B because' WHEN 4 THEN 'Let me see: **C. ' || p_name || '** fits'
    WHEN 5 THEN 'Not sure.' || chr(10) || 'B) maybe' || chr(10) || 'A. yes'
    WHEN 6 THEN 'Surely the ' || p_name || ' thing' ELSE 'No idea' END AS response FROM part),
graded AS (SELECT *, CASE gold WHEN 'A' THEN ca WHEN 'B' THEN cb ELSE cc END AS text,
  regexp_replace(trim(lower(response)), '[.,)]+$', '') AS said,
  upper(nullif(regexp_extract(response, '^\\(?([A-Za-z])[.\\)]?\\s*', 1), '')) AS lead FROM mcq),
strict AS (SELECT *, coalesce(said = regexp_replace(lower(text), '[.,)]+$', '') OR coalesce(lead = gold, false)
    OR said = lower(gold || '. ' || text) OR said = lower('(' || gold || ') ' || text), false) AS ok FROM graded)
""".replace("\\\\", "\\")


def mcq(t: Tables) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    form = size % 8
    response = (F.when(form == 0, F.concat(F.lower("p_brand"), F.lit(".")))
                .when(form == 1, F.concat(F.lit("(b) "), F.col("p_type")))
                .when(form == 2, F.concat(F.lit("C. "), name))
                .when(form == 3, "I think about A, but I will pick B because")
                .when(form == 4, F.concat(F.lit("Let me see: **C. "), name, F.lit("** fits")))
                .when(form == 5, "Not sure.\nB) maybe\nA. yes")
                .when(form == 6, F.concat(F.lit("Surely the "), name, F.lit(" thing"))).otherwise("No idea"))
    last = F.when(size < 10, "").otherwise(F.concat(F.lit("size "), size.cast("string")))
    gold = F.when(F.col("p_partkey") % 3 == 0, "A").when(F.col("p_partkey") % 3 == 1, "B").otherwise("C")
    return t.part.select(F.col("p_partkey").alias("qid"), gold.alias("gold"), response.alias("response"),
                         M.choice_map("p_brand", "p_type", "p_name", last).alias("choices"))


@query("mcq_choices", MCQ + """
SELECT qid, CASE WHEN cd = '' THEN 3 ELSE 4 END AS n, 'A. ' || ca || chr(10) || 'B. ' || cb || chr(10) || 'C. ' || cc
  || CASE WHEN cd = '' THEN '' ELSE chr(10) || 'D. ' || cd END AS prompt FROM mcq""")
def mcq_choices(t: Tables) -> DataFrame:
    return mcq(t).select("qid", F.size("choices").alias("n"), M.choice_prompt("choices").alias("prompt"))


@query("mcq_grade", MCQ + "SELECT qid, lead AS letter, ok AS correct FROM strict")
def mcq_grade(t: Tables) -> DataFrame:
    return mcq(t).select("qid", M.leading_letter("response").alias("letter"),
                         M.is_correct("response", "gold", "choices").alias("correct"))


@query("mcq_grade_lenient", MCQ + rf"""
, lenient AS (SELECT *, coalesce(
    CASE WHEN lead IN ('A', 'B', 'C') OR (lead = 'D' AND cd <> '') THEN lead END,
    upper(regexp_extract_all(response, '{M.DECISION}', 1)[-1]),
    upper(regexp_extract_all(response, '{M.BOLD}', 1)[-1]),
    upper(regexp_extract_all(response, '{M.LINE_START}', 1)[-1]),
    CASE WHEN CAST(contains(lower(response), lower(ca)) AS INT) + CAST(contains(lower(response), lower(cb)) AS INT)
            + CAST(contains(lower(response), lower(cc)) AS INT)
            + CAST(cd <> '' AND contains(lower(response), lower(cd)) AS INT) = 1
         THEN CASE WHEN contains(lower(response), lower(ca)) THEN 'A' WHEN contains(lower(response), lower(cb)) THEN 'B'
                   WHEN contains(lower(response), lower(cc)) THEN 'C' ELSE 'D' END END) AS letter FROM strict)
SELECT gold, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS n_strict,
  count(CASE WHEN ok OR letter = gold THEN 1 END) AS n_lenient,
  count(CASE WHEN NOT ok AND letter = gold THEN 1 END) AS n_gained,
  count(letter) AS n_letters FROM lenient GROUP BY gold""")
def mcq_grade_lenient(t: Tables) -> DataFrame:
    g = mcq(t).select("gold", M.is_correct("response", "gold", "choices").alias("ok"),
                      M.is_correct_lenient("response", "gold", "choices").alias("soft"),
                      M.lenient_letter("response", "choices").alias("letter"))
    return g.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_strict"),
                                 F.count_if("soft").alias("n_lenient"),
                                 F.count_if(F.col("soft") & ~F.col("ok")).alias("n_gained"),
                                 F.count("letter").alias("n_letters"))


ANGLES = """
WITH e AS (SELECT event_id AS id, (event_id % 101 - 50) / 80.0 AS yaw, (event_id % 67 - 33) / 90.0 AS pitch,
                  (event_id % 101 - 50) / 80.0 + 0.03 AS left_yaw, (event_id % 101 - 50) / 80.0 - (event_id % 7 - 2) / 100.0 AS right_yaw
           FROM events)"""


def angles(t: Tables) -> DataFrame:
    yaw = (F.col("event_id") % 101 - 50) / F.lit(80.0)
    return t.events.select(F.col("event_id").alias("id"), yaw.alias("yaw"),
                           ((F.col("event_id") % 67 - 33) / F.lit(90.0)).alias("pitch"), (yaw + 0.03).alias("left_yaw"),
                           (yaw - (F.col("event_id") % 7 - 2) / F.lit(100.0)).alias("right_yaw"))


FOCAL = G.focal_length(960)


@query("gaze_project", ANGLES + f"""
, v AS (SELECT *, tan(yaw) AS vx, tan(pitch) AS vy, (tan(left_yaw) + tan(right_yaw)) / 2 AS mean_tan,
               tan(right_yaw) - tan(left_yaw) AS den FROM e),
r AS (SELECT *, {FOCAL} * acos(1 / sqrt(vx * vx + vy * vy + 1)) AS r,
             CASE WHEN sqrt(vx * vx + vy * vy) = 0 THEN 1e-9 ELSE sqrt(vx * vx + vy * vy) END AS rho FROM v)
SELECT id, round(0.5 + {FOCAL} * vx / 960, 6) AS px, round(0.5 + {FOCAL} * vy / 720, 6) AS py,
       round(0.5 + r * (vx / rho) / 960, 6) AS ex, round(0.5 + r * (vy / rho) / 720, 6) AS ey,
       round(atan(mean_tan), 6) AS both_yaw,
       CASE WHEN abs(den) > 1e-9 AND 0.063 / den > 0 THEN round(0.063 / den, 6) END AS depth FROM r""")
def gaze_project(t: Tables) -> DataFrame:
    px, py = G.project("yaw", "pitch", 960, 720, FOCAL)
    ex, ey = G.project("yaw", "pitch", 960, 720, FOCAL, "equidistant")
    both, depth = G.combine_eyes("left_yaw", "right_yaw")
    return angles(t).select("id", *[F.round(c, 6).alias(n) for n, c in (
        ("px", px), ("py", py), ("ex", ex), ("ey", ey), ("both_yaw", both), ("depth", depth))])


@query("gaze_transform", ANGLES + """
, p AS (SELECT yaw + 0.5 AS x, pitch + 0.5 AS y FROM e),
q AS (SELECT 'rot90cw+flipx' AS how, 1 - (1 - y) AS tx, x AS ty FROM p
      UNION ALL SELECT 'rot90ccw', y, 1 - x FROM p
      UNION ALL SELECT 'flipx+flipy', 1 - x, 1 - y FROM p)
SELECT how, count(*) AS n, round(avg(least(greatest(tx, 0), 1)), 6) AS mean_x, round(avg(least(greatest(ty, 0), 1)), 6) AS mean_y,
  count(CASE WHEN tx < 0 OR tx > 1 OR ty < 0 OR ty > 1 THEN 1 END) AS n_clamped FROM q GROUP BY how""")
def gaze_transform(t: Tables) -> DataFrame:
    p = angles(t).select((F.col("yaw") + 0.5).alias("x"), (F.col("pitch") + 0.5).alias("y"))
    variants = []
    for how in ("rot90cw+flipx", "rot90ccw", "flipx+flipy"):
        x, y = G.turn("x", "y", how)
        variants.append(F.struct(F.lit(how).alias("how"), x.alias("tx"), y.alias("ty")))
    v = p.select(F.explode(F.array(*variants)).alias("v")).select("v.*")
    cx, cy = G.clamp01("tx"), G.clamp01("ty")
    return v.groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(cx), 6).alias("mean_x"),
                                F.round(F.avg(cy), 6).alias("mean_y"),
                                F.count_if((cx != F.col("tx")) | (cy != F.col("ty"))).alias("n_clamped"))


GAZE = V.with_views("gaze")


@query("crop_box", GAZE + """
, b AS (SELECT sid, CAST(round_even(least(greatest(x * 1280 - 288, 0), 1280 - 576), 0) AS BIGINT) AS x0,
               CAST(round_even(least(greatest(y * 720 - 288, 0), 720 - 576), 0) AS BIGINT) AS y0 FROM gaze)
SELECT sid, x0, y0, x0 + 576 AS x1, y0 + 576 AS y1 FROM b""")
def crop_box(t: Tables) -> DataFrame:
    box = G.crop_box(1280, 720, "x", "y", 0.8)
    return V.gaze(t).select("sid", *[c.alias(n) for n, c in box.items()])


@query("linspace_pick", """
WITH c AS (SELECT c_custkey AS id, c_custkey % 50 + c_nationkey AS total FROM customer),
p AS (SELECT id, total, unnest(range(0, CASE WHEN total <= 16 THEN total ELSE 16 END)) AS pos FROM c)
SELECT id, pos, CAST(CASE WHEN total <= 16 THEN pos WHEN pos = 15 THEN total - 1
                          ELSE floor(pos * ((total - 1) / 15.0::DOUBLE)) END AS BIGINT) AS frame FROM p""")
def linspace_pick(t: Tables) -> DataFrame:
    total = F.col("c_custkey") % 50 + F.col("c_nationkey")
    picked = t.customer.select(F.col("c_custkey").alias("id"), F.posexplode(G.linspace_indices(total, 16)))
    return picked.select("id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("frame"))


@query("frame_grid", V.with_views("captions") + """
, f AS (SELECT id, CAST(floor(least(value, 300.0) * 30) AS BIGINT) AS a,
               least(CAST(floor(least(greatest(least(value, 300.0), value * 2), 300.0) * 30) AS BIGINT), 8999) AS b FROM captions),
g AS (SELECT id, a, b, (b - a) // 30 + 1 AS n FROM f WHERE a < b),
p AS (SELECT id, a, b, n, unnest(range(0, least(n, 32))) AS pos FROM g)
SELECT id, pos, CAST(CASE WHEN n <= 32 THEN a + 30 * pos WHEN pos = 31 THEN b
  ELSE floor(pos * ((b - a) / 31.0::DOUBLE) + a) END AS BIGINT) AS frame FROM p""")
def frame_grid(t: Tables) -> DataFrame:
    grid = G.frame_grid("value", F.col("value") * 2, F.lit(300.0), 30, 1, 32)
    p = V.captions(t).select("id", F.posexplode(grid))
    return p.select("id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("frame"))


@query("off_center", GAZE + f"""
SELECT clip, count(*) AS n, round(avg(CAST(sqrt((x * 2 - .8 - .5) * (x * 2 - .8 - .5) + (y * 2 - .9 - .5) * (y * 2 - .9 - .5)) >= {G.OFF_CENTER_RADIUS} AS INTEGER)), 6) AS share_far,
  round(avg(CAST(abs(x * 2 - .8 - .5) > .2 OR abs(y * 2 - .9 - .5) > .2 AS INTEGER)), 6) AS share_outside,
  round(avg(x * 2 - .8), 6) AS mean_x, round(avg(y * 2 - .9), 6) AS mean_y FROM gaze GROUP BY clip""")
def off_center(t: Tables) -> DataFrame:
    g = V.gaze(t).withColumn("x", F.col("x") * 2 - 0.8).withColumn("y", F.col("y") * 2 - 0.9)
    far = (G.center_distance("x", "y") >= G.OFF_CENTER_RADIUS).cast("int")
    outside = ((F.abs(F.col("x") - 0.5) > 0.2) | (F.abs(F.col("y") - 0.5) > 0.2)).cast("int")
    return g.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(far), 6).alias("share_far"),
                                 F.round(F.avg(outside), 6).alias("share_outside"),
                                 F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.avg("y"), 6).alias("mean_y"))


@query("label_head", """
SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS first, split_part(replace(p_type || '.' || p_brand, '-', '.'), '.', 1) AS top
FROM part""")
def label_head(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), X.first_label("p_name").alias("first"),
                         X.top_category(F.concat("p_type", F.lit("."), "p_brand")).alias("top"))


@query("openie_clean", V.with_views("triples") + """
SELECT doc, s, p, o FROM (SELECT DISTINCT doc, s, p, o FROM triples WHERE p <> 'N')""")
def openie_clean(t: Tables) -> DataFrame:
    """Responses hold triples, some of two items, some twice; whole answers that do not parse are rejected."""
    from ..operators.extraction import clean_triples
    item = F.when(F.col("p") == "N", F.array("s", "o")).otherwise(F.array("s", "p", "o"))
    raw = V.triples(t).groupBy("doc").agg(F.collect_list(item).alias("triples"))
    raw = raw.select("doc", F.to_json(F.struct(F.concat("triples", "triples").alias("triples"))).alias("response"))
    good, _ = clean_triples(raw, "doc", "response")
    return good.select("doc", "s", "p", "o")


@query("response_repair", V.with_views("triples") + """
, d AS (SELECT doc, max(p) AS flag, count(*) AS n FROM triples GROUP BY doc)
SELECT doc, CASE WHEN flag = 'R' THEN 'repaired' ELSE 'clean' END AS outcome, n AS n_triples FROM d""")
def response_repair(t: Tables) -> DataFrame:
    """Responses of every order, those of returned items cut off half way; what became of each."""
    from ..operators.extraction import repaired
    raw = V.triples(t).groupBy("doc").agg(F.collect_list(F.array("s", "p", "o")).alias("triples"),
                                          F.max("p").alias("flag"))
    text = F.to_json(F.struct("triples"))
    cutoff = F.substring(text, F.lit(1), F.length(text) - 5)
    raw = raw.select("doc", F.when(F.col("flag") == "R", cutoff).otherwise(text).alias("response"))
    out = repaired(raw, "doc", "response", "triples array<array<string>>")
    return out.select("doc", "outcome", F.size("parsed.triples").cast("bigint").alias("n_triples"))


#: What an agent may answer, by kind of turn; {q} stands for the words that it searches.
DECISIONS = ("""{"decision": "search", "selected_memory": {"memory_type": "Visual", "search_query": "{q}"}}""",
             """{"decision": "answer", "memory": "semantic"}""",
             """Let me look: ```json {"decision": "Search", "memory": "semantic", "query": "{q}"} ``` as asked.""",
             """{"decision": "search", "memory": "episodic", "query": "{q}", "why": "cut off""",
             """I do not know.""",
             """{"decision": "wait", "memory": "visual", "query": "{q}"}""")


@query("decision_parse", """
WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS kind, 'what did ' || role || ' say in turn ' || turn AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN kind IN (0, 2, 3) THEN 'search' ELSE 'answer' END AS decision,
  CASE kind WHEN 0 THEN 'visual' WHEN 2 THEN 'semantic' WHEN 3 THEN 'episodic' END AS memory, CASE WHEN kind IN (0, 2, 3) THEN q END AS query FROM c""")
def decision_parse(t: Tables) -> DataFrame:
    """Every turn as an agent's answer: nested, plain, inside other text, cut off, without JSON, or with an unknown decision."""
    from ..operators.extraction import decision
    q = F.concat(F.lit("what did "), "role", F.lit(" say in turn "), F.col("turn").cast("string"))
    form = F.element_at(F.array(*[F.lit(d) for d in DECISIONS]), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    said = t.conversations.select("conv_id", "turn", decision(F.replace(form, F.lit("{q}"), q)).alias("d"))
    return said.select("conv_id", "turn", "d.decision", "d.memory", "d.query")


@query("id_list", """
SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN '7,' || CASE WHEN conv_id = 7 THEN '' ELSE conv_id || ',' END || (conv_id * 3000000000 + 1)
  WHEN 1 THEN CASE WHEN conv_id = turn THEN '' || turn ELSE turn || ',' || conv_id END ELSE '' END AS ids FROM conversations""")
def id_list(t: Tables) -> DataFrame:
    """Every turn as a response that names ids: a fenced list with one id twice and a very large one, a sentence, or none."""
    from ..operators.extraction import id_list as ids
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    large = (F.col("conv_id") * F.lit(3000000000).cast("bigint") + 1).cast("string")
    kind = (F.col("conv_id") + F.col("turn")) % 3
    said = (F.when(kind == 0, F.concat(F.lit("```json\n[7, "), conv, F.lit(", 7, "), large, F.lit("]\n```")))
            .when(kind == 1, F.concat(F.lit("clips "), turn, F.lit(" and "), conv, F.lit(", then "), turn)).otherwise(F.lit("none of them")))
    return t.conversations.select("conv_id", "turn", F.array_join(ids(said).cast("array<string>"), ",").alias("ids"))
