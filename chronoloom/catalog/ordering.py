"""Windows, ordered analyses, selections and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gaze as G
from ..functions import timekeys as K
from ..operators import graph_build as B
from ..operators import selection as S
from ..operators import sequences as Q
from ..operators import sets as Z
from ..operators.ordered import exact_percentile, row_numbers
from ..operators.vectors import topk
from . import views as V
from .registry import Tables, query
from .study import ask_vectors

CAP, GAZE = V.with_views("captions"), V.with_views("gaze")


@query("rank_candidates", """
SELECT l_returnflag AS qid, l_orderkey, l_linenumber, l_extendedprice AS score,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem""")
def rank_candidates(t: Tables) -> DataFrame:
    """Three queries share all candidates, so each key holds a third of the rows."""
    rows = t.lineitem.select(F.col("l_returnflag").alias("qid"), "l_orderkey", "l_linenumber",
                             F.col("l_extendedprice").alias("score"))
    return row_numbers(rows, ["qid"], [F.desc("score"), "l_orderkey", "l_linenumber"])


@query("minmax_normalize", """
WITH r AS (SELECT o_orderpriority AS qid, o_orderkey, o_totalprice AS v, min(o_totalprice) OVER (PARTITION BY o_orderpriority) AS lo,
  max(o_totalprice) OVER (PARTITION BY o_orderpriority) AS hi FROM orders UNION ALL
  SELECT 'flat', n_nationkey, 7.0, 7.0, 7.0 FROM nation)
SELECT qid, o_orderkey, round(CASE WHEN hi = lo THEN 1 ELSE (v - lo) / (hi - lo) END, 6) AS scaled FROM r""")
def minmax_normalize(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("qid"), "o_orderkey", F.col("o_totalprice").alias("v")).unionByName(
        t.nation.select(F.lit("flat").alias("qid"), F.col("n_nationkey").cast("bigint").alias("o_orderkey"), F.lit(7.0).alias("v")))
    return Q.minmax(rows, ["qid"], "v", "scaled").select("qid", "o_orderkey", F.round("scaled", 6).alias("scaled"))


@query("episode_islands", GAZE + """
, f AS (SELECT clip, sid AS fixation_id, t * 10 AS a, t * 10 + 0.3 AS b, x * 1000 AS cx, y * 1000 AS cy,
   CASE WHEN sid % 5 <> 0 THEN 'obj' || (sid % 4) END AS obj, ['o' || (sid % 3), 'o' || (sid % 7)] AS others FROM gaze),
l AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(b) OVER w AS pe FROM f WINDOW w AS (PARTITION BY clip ORDER BY a, fixation_id)),
i AS (SELECT *, sum(CASE WHEN px IS NOT NULL AND sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) < 50 AND a - pe < 2 THEN 0 ELSE 1 END)
      OVER (PARTITION BY clip ORDER BY a, fixation_id) AS episode FROM l),
base AS (SELECT clip, episode, min(a) AS s, max(b) AS e, string_agg(CAST(fixation_id AS VARCHAR), ',' ORDER BY a, fixation_id) AS ids FROM i GROUP BY clip, episode),
oc AS (SELECT clip, episode, obj, count(*) AS n, min((a, fixation_id)) AS first FROM i WHERE obj IS NOT NULL GROUP BY clip, episode, obj),
best AS (SELECT clip, episode, obj FROM oc QUALIFY row_number() OVER (PARTITION BY clip, episode ORDER BY n DESC, first) = 1),
u AS (SELECT clip, episode, a, fixation_id, unnest(others) AS name, unnest(range(0, 2)) AS pos FROM i),
u1 AS (SELECT clip, episode, name, min((a, fixation_id, pos)) AS first FROM u GROUP BY clip, episode, name),
oth AS (SELECT clip, episode, string_agg(name, ',' ORDER BY first) AS others FROM u1 GROUP BY clip, episode)
SELECT base.clip, CAST(base.episode AS BIGINT) AS episode, s AS "start", e AS "end", ids, obj AS object, oth.others
FROM base LEFT JOIN best ON best.clip = base.clip AND best.episode = base.episode LEFT JOIN oth ON oth.clip = base.clip AND oth.episode = base.episode""")
def episode_islands(t: Tables) -> DataFrame:
    sid = F.col("sid")
    f = V.gaze(t).select(
        "clip", sid.alias("fixation_id"), (F.col("t") * 10).alias("start"), (F.col("t") * 10 + 0.3).alias("end"),
        (F.col("x") * 1000).alias("cx"), (F.col("y") * 1000).alias("cy"),
        F.when(sid % 5 != 0, F.concat(F.lit("obj"), (sid % 4).cast("string"))).alias("object"),
        F.array(F.concat(F.lit("o"), (sid % 3).cast("string")), F.concat(F.lit("o"), (sid % 7).cast("string"))).alias("others"),
        F.lit("").alias("caption"))
    e = Q.episodes(f, "clip", 50.0, 2.0)
    return e.select("clip", F.col("episode").cast("bigint").alias("episode"), "start", "end",
                    F.array_join("fixation_ids", ",").alias("ids"), "object", F.array_join("others", ",").alias("others"))


@query("saccade_segments", GAZE + """
, l AS (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM gaze WINDOW w AS (PARTITION BY clip ORDER BY t, sid)),
f AS (SELECT *, coalesce(t - pt > 0 AND sqrt((x - px) * (x - px) + (y - py) * (y - py)) / (t - pt) > 0.4, false) AS fast FROM l),
r AS (SELECT *, sum(CAST(NOT fast AS INT)) OVER (PARTITION BY clip ORDER BY t, sid) AS run FROM f)
SELECT clip, min(t) AS "start", max(t) AS "end", round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n FROM r WHERE fast GROUP BY clip, run
HAVING max(t) - min(t) >= 0.05 AND greatest(max(x) - min(x), max(y) - min(y)) > 0.03""")
def saccade_segments(t: Tables) -> DataFrame:
    s = Q.saccades(V.gaze(t).select("clip", "sid", "t", "x", "y"), "clip", 0.4, 0.05, 0.03)
    return s.select("clip", "start", "end", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "n")


@query("entry_runs", CAP + """
, r AS (SELECT *, text <> 'error' AS ok, sum(CAST(text = 'error' AS INT)) OVER (PARTITION BY stream ORDER BY day, start_sec, id) AS run FROM captions)
SELECT stream, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM r WHERE ok GROUP BY stream, run""")
def entry_runs(t: Tables) -> DataFrame:
    runs = Q.valid_runs(V.captions(t), ["stream"], ["day", "start_sec", "id"], F.col("text") != "error")
    return runs.groupBy("stream", "run").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"),
                                             F.max("id").alias("last_id")).drop("run")


PAGED = """
WITH d AS (SELECT doc_id, 1 + n_chars // 500 AS n_pages, n_chars % (1 + n_chars // 500) AS page FROM documents),
o AS (SELECT *, CAST(sum(n_pages) OVER (ORDER BY doc_id) - n_pages AS BIGINT) AS first_page FROM d)
"""


def paged(t: Tables) -> DataFrame:
    n = (F.floor(F.col("n_chars") / 500) + 1).cast("bigint")
    d = t.documents.select("doc_id", n.alias("n_pages"), (F.col("n_chars") % n).alias("page"))
    return Q.page_offsets(d, ["doc_id"], "n_pages")


@query("page_offsets", PAGED + "SELECT doc_id, n_pages, first_page, first_page + page AS evidence_page FROM o")
def page_offsets(t: Tables) -> DataFrame:
    return paged(t).select("doc_id", "n_pages", "first_page", (F.col("first_page") + F.col("page")).alias("evidence_page"))


@query("graded_page_qrels", PAGED + """
, p AS (SELECT doc_id, first_page, page, unnest(range(first_page, first_page + n_pages)) AS page_id FROM o WHERE page > 0)
SELECT doc_id, page_id, CASE WHEN page_id = first_page + page THEN 3 ELSE 2 END AS score FROM p""")
def graded_page_qrels(t: Tables) -> DataFrame:
    """Documents whose evidence number is 0 have no evidence page."""
    d = paged(t)
    return Q.graded_pages(d.select("doc_id", "first_page", "n_pages"), d.where("page > 0").select("doc_id", "page"),
                          "doc_id", "first_page", "n_pages")


@query("running_correct", """
WITH r AS (SELECT o_orderkey, count(*) OVER w AS n_done, sum(CAST(o_totalprice > 200000 AS INT)) OVER w AS n_right FROM orders WINDOW w AS (ORDER BY o_orderkey))
SELECT o_orderkey, n_done, CAST(n_right AS BIGINT) AS n_right, n_right / n_done AS accuracy FROM r""")
def running_correct(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_totalprice") > 200000).cast("int").alias("ok"))
    return Q.running_accuracy(rows, ["o_orderkey"], "ok").drop("ok")


@query("average_ranks", """
WITH v AS (SELECT o_orderstatus AS g, CAST(floor(o_totalprice / 500) AS BIGINT) AS v FROM orders),
r AS (SELECT g, v, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS avg_rank FROM v)
SELECT g, v, count(*) AS n, CAST(any_value(avg_rank) AS DOUBLE) AS avg_rank FROM r GROUP BY g, v""")
def average_ranks(t: Tables) -> DataFrame:
    v = t.orders.select(F.col("o_orderstatus").alias("g"), F.floor(F.col("o_totalprice") / 500).alias("v"))
    return Q.average_ranks(v, ["g"], "v")


@query("holm_adjust", """
WITH p AS (SELECT source, avg(n_chars % 97) / 4000 AS p FROM documents GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY p, source) AS i, count(*) OVER () AS m FROM p)
SELECT source, round(p, 6) AS p, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY p, source), 6) AS p_holm FROM r""")
def holm_adjust(t: Tables) -> DataFrame:
    p = t.documents.groupBy("source").agg((F.avg(F.col("n_chars") % 97) / 4000).alias("p"))
    return Q.holm(p, "p", "source").select("source", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


@query("representative_frames", GAZE + """
, s AS (SELECT clip, sid, t, (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) AS dist, row_number() OVER (PARTITION BY clip ORDER BY t, sid) AS rn,
   count(*) OVER (PARTITION BY clip) AS n FROM gaze),
near AS (SELECT clip, sid, 0 AS prio FROM s QUALIFY row_number() OVER (PARTITION BY clip ORDER BY abs(t - 3), t, sid) = 1),
far AS (SELECT clip, sid, row_number() OVER (PARTITION BY clip ORDER BY dist DESC, t, sid) AS prio FROM s WHERE dist > 0.004
        QUALIFY row_number() OVER (PARTITION BY clip ORDER BY dist DESC, t, sid) <= 2),
k AS (SELECT unnest(range(0, 6)) AS k),
even AS (SELECT s.clip, s.sid, k + 3 AS prio FROM s JOIN k ON s.rn = CAST(round_even(k * (n - 1) / 5.0::DOUBLE, 0) AS BIGINT) + 1),
a AS (SELECT clip, sid, min(prio) AS prio FROM (SELECT * FROM near UNION ALL SELECT * FROM far UNION ALL SELECT * FROM even) GROUP BY clip, sid)
SELECT clip, sid, prio FROM a QUALIFY row_number() OVER (PARTITION BY clip ORDER BY prio) <= 6""")
def representative_frames(t: Tables) -> DataFrame:
    dx, dy = F.col("x") - 0.5, F.col("y") - 0.5
    s = V.gaze(t).select("clip", "sid", "t", (dx * dx + dy * dy).alias("dist")).withColumn("off", F.col("dist") > 0.004)
    targets = s.select("clip").distinct().withColumn("target", F.lit(3.0))
    return S.representative(s, targets, "clip", "sid").select("clip", "sid", "prio")


@query("topk_per_query", """
WITH r AS (SELECT l_suppkey AS qid, l_returnflag AS scale, l_orderkey, l_linenumber, l_extendedprice AS score,
  row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)
SELECT qid, scale, score, rank FROM r WHERE rank <= CASE scale WHEN 'A' THEN 10 WHEN 'R' THEN 3 ELSE 5 END""")
def topk_per_query(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("qid"), F.col("l_returnflag").alias("scale"), "l_orderkey", "l_linenumber",
                             F.col("l_extendedprice").alias("score"))
    return S.topk_by_scale(rows, ["qid"], "scale", {"A": 10, "R": 3}, 5,
                           [F.desc("score"), "l_orderkey", "l_linenumber"]).select("qid", "scale", "score", "rank")


@query("scale_merge", """
WITH c AS (SELECT l_orderkey AS qid, l_partkey AS item, max(l_extendedprice) AS score, max(CASE WHEN l_tax > 0.05 AND l_orderkey % 2 = 0 THEN l_partkey END) AS choice,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem GROUP BY l_orderkey, l_partkey)
SELECT qid, item, score, row_number() OVER w AS rank FROM c
WINDOW w AS (PARTITION BY qid ORDER BY CASE WHEN n > 4 THEN choice END NULLS LAST, score DESC, item) QUALIFY row_number() OVER w <= 4""")
def scale_merge(t: Tables) -> DataFrame:
    """The chooser picks heavily taxed parts for even orders and fails for odd ones."""
    pick = F.when((F.col("l_tax") > 0.05) & (F.col("l_orderkey") % 2 == 0), F.col("l_partkey"))
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("item")).agg(
        F.max("l_extendedprice").alias("score"), F.max(pick).alias("choice"))
    return S.merge_scales(c, "qid", "item", 4, "score", "choice").select("qid", "item", "score", "rank")


@query("uniform_thin", CAP + """
, r AS (SELECT id, stream, row_number() OVER (PARTITION BY stream ORDER BY day, start_sec, id) - 1 AS pos, count(*) OVER (PARTITION BY stream) AS n FROM captions),
k AS (SELECT unnest(range(0, 32)) AS i),
s AS (SELECT DISTINCT stream, n FROM r),
w AS (SELECT DISTINCT stream, CAST(CASE WHEN i = 31 THEN n - 1 ELSE floor(i * ((n - 1) / 31.0::DOUBLE)) END AS BIGINT) AS pos FROM s, k WHERE n > 32),
a AS (SELECT r.stream, r.id FROM r LEFT JOIN w ON w.stream = r.stream AND w.pos = r.pos WHERE n <= 32 OR w.pos IS NOT NULL),
g AS (SELECT id, text, row_number() OVER (PARTITION BY text ORDER BY day, start_sec, id) - 1 AS pos, count(*) OVER (PARTITION BY text) AS n, count(*) OVER () AS total FROM captions),
gs AS (SELECT DISTINCT text, n, CAST(greatest(1, floor(n * (700.0::DOUBLE / total))) AS BIGINT) AS cap FROM g),
gw AS (SELECT text, cap, n, unnest(range(0, cap)) AS i FROM gs),
gp AS (SELECT DISTINCT text, CAST(CASE WHEN i = cap - 1 AND cap > 1 THEN n - 1 ELSE floor(i * ((n - 1) / greatest(cap - 1, 1)::DOUBLE)) END AS BIGINT) AS pos FROM gw)
SELECT 'list' AS how, CAST(stream AS VARCHAR) AS key, id FROM a
UNION ALL SELECT 'group', g.text, g.id FROM g JOIN gp ON gp.text = g.text AND gp.pos = g.pos""")
def uniform_thin(t: Tables) -> DataFrame:
    c = V.captions(t).select("id", "stream", "text", "day", "start_sec")
    a = S.thin(c, ["stream"], ["day", "start_sec", "id"], 32)
    b = S.thin_groups(c.withColumn("all", F.lit(1)), ["all"], "text", ["day", "start_sec", "id"], 700)
    return a.select(F.lit("list").alias("how"), F.col("stream").cast("string").alias("key"), "id").unionByName(
        b.select(F.lit("group").alias("how"), F.col("text").alias("key"), "id"))


@query("head_sample", "SELECT doc_id, source, md5(text) AS h FROM documents ORDER BY doc_id LIMIT 100")
def head_sample(t: Tables) -> DataFrame:
    return t.documents.orderBy("doc_id").limit(100).select("doc_id", "source", F.md5("text").alias("h"))


STRATA = """
WITH o AS (SELECT o_orderkey, o_orderpriority AS qtype, o_orderstatus AS status, o_custkey % 20 AS gap, o_totalprice > 450000 AS single FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY qtype, status, gap ORDER BY CAST(single AS INT) DESC, md5('s1|' || o_orderkey), o_orderkey) AS pick,
      count(*) OVER (PARTITION BY qtype, status, gap) AS available FROM o)"""


@query("stratified_quota", STRATA + """
SELECT qtype, status, gap, o_orderkey, pick, greatest(45 - available, 0) AS shortfall FROM r WHERE pick <= 45""")
def stratified_quota(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("qtype"), F.col("o_orderstatus").alias("status"),
                        (F.col("o_custkey") % 20).alias("gap"), (F.col("o_totalprice") > 450000).cast("int").alias("single"))
    strata = ["qtype", "status", "gap"]
    taken, short = S.quota(o, strata, 45, F.col("single"), "s1", "o_orderkey")
    return taken.join(short, strata).select(*strata, "o_orderkey", "pick", "shortfall")


@query("distractor_pool", V.with_views("captions", "clips") + """
, tg AS (SELECT clip FROM clips WHERE value > 200), d AS (SELECT DISTINCT day FROM clips WHERE value > 200),
x AS (SELECT clip FROM clips WHERE value <= 200 AND day IN (SELECT day FROM d) ORDER BY md5('pool|' || clip), clip LIMIT 500)
SELECT clip, true AS is_target FROM tg UNION ALL SELECT clip, false FROM x""")
def distractor_pool(t: Tables) -> DataFrame:
    c = V.clips(t).select("clip", "day", "value")
    return S.with_distractors(c, c.where("value > 200"), 500, "pool", "clip", "day").select("clip", "is_target")


@query("cluster_cap_sample", """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('c|' || doc_id), doc_id) AS pick FROM documents),
f AS (SELECT doc_id FROM r WHERE pick <= 43),
x AS (SELECT doc_id FROM r WHERE pick > 43 ORDER BY md5('c|' || doc_id), doc_id LIMIT greatest(0, 850 - (SELECT count(*) FROM f)))
SELECT doc_id, false AS filled FROM f UNION ALL SELECT doc_id, true FROM x""")
def cluster_cap_sample(t: Tables) -> DataFrame:
    """20 sources, 850 documents wanted: 43 per source at most, then a top-up."""
    return S.cluster_sample(t.documents.select("doc_id", "source"), "source", 850, "c", "doc_id").select("doc_id", "filled")


@query("mixture_interleave", """
WITH n AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang),
s0 AS (SELECT unnest(range(0, (SELECT CAST(ceil(count(*) / 4) AS BIGINT) + 4 FROM documents))) AS slot),
s1 AS (SELECT slot, CAST('0x' || substr(md5('m|' || slot), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM s0),
s2 AS (SELECT slot, CASE WHEN u < 0.5 THEN 'en' WHEN u < 0.5 + 0.2 THEN 'fr' WHEN u < 0.5 + 0.2 + 0.2 THEN 'de' ELSE 'es' END AS lang FROM s1),
s3 AS (SELECT slot, s2.lang, size, (row_number() OVER (PARTITION BY s2.lang ORDER BY slot) - 1) * 4 AS b FROM s2 JOIN n ON n.lang = s2.lang),
s4 AS (SELECT * FROM s3 WHERE slot < coalesce((SELECT min(slot) FROM s3 WHERE b >= size), 1000000000)),
s5 AS (SELECT slot, lang, b, unnest(range(b, least(b + 4, size))) AS at FROM s4),
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('m|' || doc_id), doc_id) - 1 AS at FROM documents)
SELECT slot, s5."at" - b AS pos, s5.lang, doc_id FROM s5 JOIN d ON d.lang = s5.lang AND d."at" = s5."at\"""".replace(" AS at", ' AS "at"'))
def mixture_interleave(t: Tables) -> DataFrame:
    return S.mixture(t.documents.select("doc_id", "lang"), "lang", "doc_id", {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}, 4, "m")


@query("mixture_wrapped", """
WITH n AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang),
s0 AS (SELECT unnest(range(0, (SELECT 4 * count(*) + 64 FROM documents))) AS slot),
s1 AS (SELECT slot, CAST('0x' || substr(md5('m|' || slot), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM s0),
s2 AS (SELECT slot, CASE WHEN u < 0.5 THEN 'en' WHEN u < 0.5 + 0.2 THEN 'fr' WHEN u < 0.5 + 0.2 + 0.2 THEN 'de' ELSE 'es' END AS lang FROM s1),
s3 AS (SELECT slot, s2.lang, size, (row_number() OVER (PARTITION BY s2.lang ORDER BY slot) - 1) * 4 AS b FROM s2 JOIN n ON n.lang = s2.lang),
e AS (SELECT max(s) AS last FROM (SELECT lang, min(slot) AS s FROM s3 WHERE b + 4 >= size GROUP BY lang)),
s4 AS (SELECT slot, lang, size, unnest(range(b, b + 4)) AS place, b FROM s3 WHERE slot <= (SELECT last FROM e)),
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('m|' || doc_id), doc_id) - 1 AS place FROM documents)
SELECT slot, s4.place - b AS pos, s4.lang, doc_id FROM s4 JOIN d ON d.lang = s4.lang AND d.place = s4.place % size""")
def mixture_wrapped(t: Tables) -> DataFrame:
    """Sources start again until each was used up once."""
    return S.mixture(t.documents.select("doc_id", "lang"), "lang", "doc_id", {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}, 4, "m", "all_exhausted")


@query("case_selection", """
WITH p AS (SELECT o_orderkey, o_custkey % 300 + 1 AS a, o_orderkey % 280 + 1 AS b FROM orders)
SELECT o_orderkey, a, b, round(-ln(b / a), 6) AS gain FROM p WHERE b < a ORDER BY round(-ln(b / a), 9) DESC, o_orderkey LIMIT 25""")
def case_selection(t: Tables) -> DataFrame:
    p = t.orders.select("o_orderkey", (F.col("o_custkey") % 300 + 1).alias("a"), (F.col("o_orderkey") % 280 + 1).alias("b"))
    gain = -F.log(F.col("b") / F.col("a"))
    return (p.where("b < a").withColumn("gain", F.round(gain, 9)).orderBy(F.desc("gain"), "o_orderkey").limit(25)
            .withColumn("gain", F.round("gain", 6)))


@query("variation_cases", """
WITH r AS (SELECT l_orderkey AS qid, l_returnflag AS cond, max(CAST(l_quantity > 25 AS INT)) AS ok FROM lineitem GROUP BY ALL),
g AS (SELECT qid, count(*) AS n, sum(ok) AS n_right, string_agg(CASE WHEN ok = 1 THEN cond END, '+' ORDER BY cond) AS winners FROM r GROUP BY qid)
SELECT qid, n, CAST(n_right AS BIGINT) AS n_right, winners FROM g WHERE n_right > 0 AND n_right < n""")
def variation_cases(t: Tables) -> DataFrame:
    r = t.lineitem.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_returnflag").alias("cond")).agg(
        F.max((F.col("l_quantity") > 25).cast("int")).alias("ok"))
    return Z.varying(r, "qid", "cond", "ok")


@query("pseudo_control", GAZE + """
, c AS (SELECT clip, greatest(1, CAST(round_even(greatest(max(t) - min(t), 1.0) * 10, 0) AS BIGINT)) AS n FROM gaze GROUP BY clip),
p AS (SELECT clip, unnest(range(0, n)) AS i FROM c),
x AS (SELECT clip, i, 0.15::DOUBLE + 0.7::DOUBLE * (CAST('0x' || substr(md5('ctlx|' || clip || '|' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS x,
  0.15::DOUBLE + 0.7::DOUBLE * (CAST('0x' || substr(md5('ctly|' || clip || '|' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS y FROM p)
SELECT clip, count(*) AS n, round(median(x), 6) AS mx, round(median(y), 6) AS my FROM x GROUP BY clip""")
def pseudo_control(t: Tables) -> DataFrame:
    c = V.gaze(t).groupBy("clip").agg((F.max("t") - F.min("t")).alias("seconds"))
    pts = S.uniform_points(c, "clip", F.col("seconds"), 10.0, "ctl")
    n = pts.groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    mx, my = exact_percentile(pts, ["clip"], "x", 0.5, "mx"), exact_percentile(pts, ["clip"], "y", 0.5, "my")
    return n.join(mx, "clip").join(my, "clip").select("clip", "n", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"))


FIX = GAZE + """
, fix AS (SELECT clip, floor(t) + 0.1::DOUBLE AS a, floor(t) + 0.1::DOUBLE + (0.3::DOUBLE + (count(*) % 3) * 0.2::DOUBLE) AS b FROM gaze GROUP BY clip, floor(t)),
clipn AS (SELECT clip, CAST(ceil(max(t)) * 30 AS BIGINT) AS total FROM gaze GROUP BY clip),
k AS (SELECT unnest(range(0, 16)) AS j),
u AS (SELECT clip, total, CASE WHEN j = 15 THEN total - 1 ELSE CAST(floor(j * ((total - 1) / 15.0::DOUBLE)) AS BIGINT) END AS frame FROM clipn, k),
sub AS (SELECT u.clip, frame, min(a) AS fs FROM u JOIN fix ON fix.clip = u.clip AND frame / 30.0::DOUBLE BETWEEN a AND b GROUP BY u.clip, frame),
run AS (SELECT *, b - a AS len, sum(b - a) OVER (PARTITION BY clip ORDER BY a) AS upto, sum(b - a) OVER (PARTITION BY clip) AS covered FROM fix),
ref0 AS (SELECT run.clip, a, len, upto - len AS before, covered * (j + 0.5::DOUBLE) / 16 AS uu FROM run, k
         WHERE covered * (j + 0.5::DOUBLE) / 16 <= upto AND (covered * (j + 0.5::DOUBLE) / 16 > upto - len)),
ref AS (SELECT r.clip, CAST(least(greatest(round_even((a + least(uu - before, len)) * 30, 0), 0), total - 1) AS BIGINT) AS frame, min(a) AS fs
        FROM ref0 r JOIN clipn c ON c.clip = r.clip GROUP BY ALL)
"""


@query("fixation_frame_pick", FIX + """
SELECT 'subset' AS how, clip, count(*) AS n, CAST(sum(frame) AS BIGINT) AS frames, round(sum(fs), 4) AS starts FROM sub GROUP BY clip
UNION ALL SELECT 'refill', clip, count(*), CAST(sum(frame) AS BIGINT), round(sum(fs), 4) FROM ref GROUP BY clip
UNION ALL SELECT 'control', c.clip, any_value(s.n), CAST(sum(f) AS BIGINT), 0 FROM (SELECT clip, count(*) AS n FROM sub GROUP BY clip) s
  JOIN (SELECT s2.clip, unnest(range(0, s2.n)) AS j, s2.n, total FROM (SELECT clip, count(*) AS n FROM sub GROUP BY clip) s2 JOIN clipn ON clipn.clip = s2.clip) c ON c.clip = s.clip,
  LATERAL (SELECT CASE WHEN j = c.n - 1 AND c.n > 1 THEN total - 1 ELSE CAST(floor(j * ((total - 1) / greatest(c.n - 1, 1)::DOUBLE)) AS BIGINT) END AS f) GROUP BY c.clip""")
def fixation_frame_pick(t: Tables) -> DataFrame:
    g = V.gaze(t)
    start = F.floor("t") + F.lit(0.1)
    fix = g.groupBy("clip", start.alias("start")).agg((F.count(F.lit(1)) % 3).alias("n"))
    fix = fix.select("clip", "start", (F.col("start") + (F.lit(0.3) + F.col("n") * F.lit(0.2))).alias("end"))
    clips = g.groupBy("clip").agg((F.ceil(F.max("t")) * 30).cast("bigint").alias("total"))
    frames = clips.select("clip", F.explode(G.linspace_indices("total", 16)).alias("frame"))
    subset = S.frames_in_fixations(frames.withColumn("ft", F.col("frame") / F.lit(30.0)), fix)
    refill = S.refill_frames(fix, clips, 16, 30.0)
    counts = subset.groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    control = clips.join(counts, "clip").select("clip", F.explode(G.linspace_indices("total", F.col("n"))).alias("frame"))

    def summed(df, how, starts):
        return df.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("frames"), starts.alias("starts")).select(
            F.lit(how).alias("how"), "clip", "n", "frames", "starts")

    return (summed(subset, "subset", F.round(F.sum("fix_start"), 4)).unionByName(summed(refill, "refill", F.round(F.sum("fix_start"), 4)))
            .unionByName(summed(control, "control", F.max(F.lit(0.0)))))


@query("union_sorted", CAP + """
SELECT start_sec AS "start", text, 'caption' AS kind, id FROM captions WHERE text <> 'click'
UNION ALL SELECT start_sec, text, 'transcript', id FROM captions WHERE text = 'click'""")
def union_sorted(t: Tables) -> DataFrame:
    c = V.captions(t).select(F.col("start_sec").alias("start"), "text", "id")
    return Z.tagged_union({"caption": c.where("text <> 'click'"), "transcript": c.where("text = 'click'")}, "kind", ["start", "id"])


@query("candidate_corpus", """
WITH c AS (SELECT l_orderkey AS qid, l_linenumber AS pos, p_name AS name, l_partkey AS item FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT 9000000000, row_number() OVER (ORDER BY p_partkey), p_name, p_partkey FROM part)
SELECT name, arg_min(item, (qid, pos, item)) AS item, min(qid) AS first_query FROM c GROUP BY name""")
def candidate_corpus(t: Tables) -> DataFrame:
    part = t.part.select("p_partkey", F.col("p_name").alias("name"))
    lists = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("qid"), F.col("l_linenumber").cast("bigint").alias("pos"), "name", F.col("l_partkey").alias("item"))
    corpus = part.select("name", F.col("p_partkey").alias("item"), F.col("p_partkey").alias("pos"))
    return Z.candidate_corpus(lists, corpus, "qid", "pos", "name", "item", 9000000000)


@query("topk_union", V.with_views("asks", "vecs") + """
, q AS (SELECT DISTINCT qid, trim(text) AS text, min(qno) OVER (PARTITION BY qid, trim(text)) AS qno, arg_min(vkey, qno) OVER (PARTITION BY qid, trim(text)) AS vkey FROM asks WHERE trim(text) <> ''),
s AS (SELECT q.qid, q.qno, b.vec_id AS rid, round(list_cosine_similarity(a.vec, b.vec), 9) AS score FROM q JOIN vecs a ON q.vkey % a.n_vec = a.vec_id CROSS JOIN vecs b),
top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid, qno ORDER BY score DESC, rid) <= 5)
SELECT qid, rid, count(*) AS n_queries, min(qno) AS first_query FROM top GROUP BY qid, rid""")
def topk_union(t: Tables) -> DataFrame:
    q = Z.distinct_queries(ask_vectors(t).select("qid", "qno", "text", "qvec"), "qid", "qno", "text")
    hits = topk(q, V.vecs(t).select(F.col("vec_id").alias("rid"), "vec"), 5, ["qid", "qno"], "rid")
    return hits.groupBy("qid", "rid").agg(F.count(F.lit(1)).alias("n_queries"), F.min("qno").alias("first_query"))


TRI = V.with_views("triples") + """
, gone AS (SELECT o_orderkey AS doc FROM orders WHERE o_orderstatus = 'P'),
tr AS (SELECT doc, s, p || (doc % 40) AS p, o FROM triples)
"""


def order_facts(t: Tables) -> DataFrame:
    return V.triples(t).withColumn("p", F.concat("p", (F.col("doc") % 40).cast("string"))).select("doc", "s", "p", "o")


@query("set_difference_facts", TRI + """
SELECT s, p, o FROM tr WHERE doc IN (SELECT doc FROM gone) EXCEPT SELECT s, p, o FROM tr WHERE doc NOT IN (SELECT doc FROM gone)""")
def set_difference_facts(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc"))
    return Z.only_in_deleted(order_facts(t), gone, "doc", ["s", "p", "o"])


@query("snapshot_remove", TRI + """
, acc AS (SELECT s, p, o, CAST(doc AS VARCHAR) AS evidence FROM tr), rm AS (SELECT DISTINCT s, p, o, evidence FROM acc WHERE p LIKE 'R1%'),
kept AS (SELECT * FROM acc WHERE NOT EXISTS (SELECT 1 FROM rm WHERE rm.s = acc.s AND rm.p = acc.p AND rm.o = acc.o AND rm.evidence = acc.evidence)
         UNION ALL SELECT s, 'merged', o, evidence FROM rm)
SELECT p, count(*) AS n, count(DISTINCT evidence) AS n_evidence FROM kept GROUP BY p""")
def snapshot_remove(t: Tables) -> DataFrame:
    acc = order_facts(t).withColumn("evidence", F.col("doc").cast("string")).drop("doc")
    named = acc.where(F.col("p").startswith("R1")).distinct()
    kept = Z.replace_pairs(acc, named, named.withColumn("p", F.lit("merged")), ["s", "p", "o", "evidence"])
    return kept.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("evidence").alias("n_evidence"))
