"""Training-pair preparation and paired statistics over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import stats as S
from ..operators.ordered import exact_percentile
from ..operators.vectors import topk
from . import views as V
from .registry import Tables, query

U = "CAST('0x' || substr(md5({s}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("hard_negative_mining", f"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
s AS (SELECT a.vec_id AS qid, b.vec_id AS rid, a.label AS ql, b.label AS rl, round(list_cosine_similarity(a.vec, b.vec), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rk FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) <= 50),
p AS (SELECT qid, max(CASE WHEN ql = rl THEN score END) AS pos FROM h GROUP BY qid),
f AS (SELECT h.qid, 'd' || rl || '-' || rid AS id, row_number() OVER (PARTITION BY h.qid ORDER BY rk) AS i FROM h JOIN p ON p.qid = h.qid
      WHERE ql <> rl AND score < 0.35 AND (pos IS NULL OR score < pos - 0.02) AND (pos IS NULL OR score < pos * 0.9) AND rk > 3),
c AS (SELECT qid, id, i FROM f UNION ALL SELECT qid, 'p' || k, k FROM p, (SELECT unnest(range(1, 8)) AS k) WHERE qid % 5 = 0 AND qid NOT IN (SELECT qid FROM f)),
r AS (SELECT qid, id, i - 3 AS i, count(*) OVER (PARTITION BY qid) AS n FROM c WHERE i > 2 AND i <= 42),
a AS (SELECT qid, n, id, row_number() OVER (PARTITION BY qid ORDER BY md5('hn|' || qid || '|' || id || '|' || i), i) - 1 AS j FROM r WHERE n >= 5),
b AS (SELECT qid, max(n) AS n, unnest(range(0, 5)) AS j FROM r WHERE n >= 4 AND n < 5 GROUP BY qid)
SELECT qid, n, j, id FROM a WHERE j < 5
UNION ALL SELECT b.qid, b.n, b.j, r.id FROM b JOIN r ON r.qid = b.qid AND r.i = CAST(floor({U.format(s="'hn|' || b.qid || '|' || b.j")} * b.n) AS BIGINT)""")
def hard_negative_mining(t: Tables) -> DataFrame:
    v = V.vecs(t)
    hits = topk(v.select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec")), v.select(F.col("vec_id").alias("rid"), "vec"),
                50, ["qid"], "rid", not_same="qid")
    labels = t.embeddings.select(F.col("vec_id").alias("rid"), F.col("label").alias("rl"))
    hits = hits.join(labels, "rid").join(labels.select(F.col("rid").alias("qid"), F.col("rl").alias("ql")), "qid")
    docid = F.concat(F.lit("d"), F.col("rl").cast("string"), F.lit("-"), F.col("rid").cast("string"))
    packed = F.array_sort(F.collect_list(F.struct("rank", docid.alias("id"), "score")))
    rows = hits.groupBy("qid", "ql").agg(packed.alias("h"), F.max(F.when(F.col("ql") == F.col("rl"), F.col("score"))).alias("pos_score"))
    prev = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("p"), i.cast("string")))
    rows = rows.select(
        "qid", "pos_score", F.transform("h", lambda x: x["id"]).alias("neg_ids"), F.transform("h", lambda x: x["score"]).alias("neg_scores"),
        F.transform("h", lambda x: x["id"]).alias("posbased_ids"), F.transform("h", lambda x: x["score"]).alias("posbased_scores"),
        F.concat(F.lit("d"), F.col("ql").cast("string"), F.lit("-")).alias("prefix"), F.when(F.col("qid") % 5 == 0, prev).alias("prev_neg"))
    out = P.mine_negatives(rows, 5, "qid", "hn", threshold=0.35, margin=0.02, ratio=0.9, same_prefix="prefix",
                           near_positive=(0, 3), keep_range=(2, 42))
    return out.select("qid", F.col("n_candidates").alias("n"), F.posexplode("negatives").alias("j", "id"))


@query("label_contrast_pairs", f"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('lc|' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS size FROM documents),
n AS (SELECT source, any_value(size) AS size, row_number() OVER (ORDER BY source) AS li, count(*) OVER () AS many FROM r WHERE size > 1 GROUP BY source),
p AS (SELECT r.doc_id, r.source, q.doc_id AS pos_id, li, many FROM r JOIN n ON n.source = r.source JOIN r q ON q.source = r.source AND q.rn = r.rn % r.size + 1),
j AS (SELECT *, unnest(range(1, 4)) AS j FROM p),
k AS (SELECT j.*, CAST((j.li + floor({U.format(s="'lcl|' || doc_id || '|' || j")} * (many - 1))) % many + 1 AS BIGINT) AS l2 FROM j),
m AS (SELECT k.doc_id, k.pos_id, k.j, n.source AS s2, CAST(floor({U.format(s="'lcp|' || doc_id || '|' || j")} * n.size) + 1 AS BIGINT) AS at2 FROM k JOIN n ON n.li = k.l2)
SELECT m.doc_id, pos_id, j, r.doc_id AS neg_id FROM m JOIN r ON r.source = m.s2 AND r.rn = m.at2""")
def label_contrast_pairs(t: Tables) -> DataFrame:
    return P.label_contrast(t.documents, "doc_id", "source", 3, "lc")


@query("prompted_pairs", f"""
WITH q AS (SELECT conv_id * 100 + turn AS key, role, text, CAST(turn % 4 AS INT) AS n_hard FROM conversations),
c AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn, count(*) OVER () AS total FROM benchmark),
g AS (SELECT key, unnest(range(n_hard + 1, 4)) AS j FROM q WHERE n_hard < 3),
x AS (SELECT key, string_agg(CAST(c.item_id AS VARCHAR), ',' ORDER BY j) AS more FROM g JOIN c ON c.rn = CAST(floor({U.format(s="'ppn|' || key || '|' || j")} * c.total) + 1 AS BIGINT) GROUP BY key),
h AS (SELECT q.key, coalesce(string_agg('h' || i, ',' ORDER BY i), '') AS hard FROM q LEFT JOIN (SELECT unnest(range(0, 3)) AS i) k ON k.i < q.n_hard GROUP BY q.key)
SELECT q.key, md5(CASE WHEN {U.format(s="'ppq|' || q.key")} < 0.4 THEN 'as ' || role || ' ' || trim(text) ELSE trim(text) END) AS query_text,
  concat_ws(',', nullif(hard, ''), more) AS negatives FROM q JOIN h ON h.key = q.key LEFT JOIN x ON x.key = q.key""")
def prompted_pairs(t: Tables) -> DataFrame:
    c = t.conversations
    n_hard = (F.col("turn") % 4).cast("int")
    hard = F.slice(F.array(*[F.lit(f"h{i}") for i in range(4)]), F.lit(1), n_hard)
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("key"),
                    F.concat(F.lit("as "), "role", F.lit("[SEP]"), "text").alias("query"), hard.alias("hard"))
    out = P.prompted(rows, "key", "query", "hard", t.benchmark, "item_id", 3, 0.4, "pp")
    return out.select("key", F.md5("query_text").alias("query_text"), F.array_join("neg_text", ",").alias("negatives"))


@query("pair_schema_align", """
SELECT 'docs' AS name, md5(lang) AS query, md5(text) AS pos, 0 AS n_neg, false AS has_image FROM documents
UNION ALL SELECT 'turns', md5(role), md5(text), 1, false FROM conversations
UNION ALL SELECT 'pages', NULL, md5(html), 0, true FROM pages""")
def pair_schema_align(t: Tables) -> DataFrame:
    image = F.struct(F.array("url").alias("paths"), F.lit(None).cast("array<binary>").alias("bytes"), F.lit(None).cast("array<array<int>>").alias("resolutions"))
    out = P.align({"docs": t.documents.select(F.col("lang").alias("query_text"), F.col("text").alias("pos_text")),
                   "turns": t.conversations.select(F.col("role").alias("query_text"), F.col("text").alias("pos_text"), F.array("role").alias("neg_text")),
                   "pages": t.pages.select(image.alias("query_image"), F.col("html").alias("pos_text"))})
    return out.select(F.col("global_dataset_name").alias("name"), F.md5("query_text").alias("query"), F.md5("pos_text").alias("pos"),
                      F.coalesce(F.size("neg_text"), F.lit(0)).alias("n_neg"), F.col("query_image").isNotNull().alias("has_image"))


@query("multimodal_pairs", V.with_views("captions") + """
, r AS (SELECT stream, id, text, row_number() OVER (PARTITION BY stream ORDER BY day, start_sec, id) - 1 AS pos, count(*) OVER (PARTITION BY stream) AS n FROM captions),
w AS (SELECT DISTINCT stream, n, CAST(CASE WHEN i = 7 THEN n - 1 ELSE floor(i * ((n - 1) / 7.0::DOUBLE)) END AS BIGINT) AS pos FROM (SELECT DISTINCT stream, n FROM r WHERE n > 8), (SELECT unnest(range(0, 8)) AS i)
      UNION SELECT stream, n, pos FROM r WHERE n <= 8)
SELECT r.stream, string_agg('f' || r.id || '.jpg', ',' ORDER BY r.pos) AS paths, any_value(l.text) AS pos_text FROM r JOIN w ON w.stream = r.stream AND w.pos = r.pos
JOIN (SELECT stream, text FROM r WHERE pos = n - 1) l ON l.stream = r.stream GROUP BY r.stream""")
def multimodal_pairs(t: Tables) -> DataFrame:
    c = V.captions(t)
    path = F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".jpg"))
    frames = c.select("stream", "day", "start_sec", "id", path.alias("path"))
    texts = c.groupBy("stream").agg(F.max_by("text", F.struct("day", "start_sec", "id")).alias("pos_text"))
    out = P.video_pairs(frames, texts, "stream", ["day", "start_sec", "id"], "path", 8, "What is shown?")
    return out.select("stream", F.array_join("query_image.paths", ",").alias("paths"), "pos_text")


@query("conversation_pairs", """
WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT a.conv_id, a.text AS a, b.text AS b FROM r a JOIN r b ON b.conv_id = a.conv_id AND a.i = 1 AND b.i = 2)
SELECT conv_id, 'answer' AS mode, md5(a) AS query, md5(b) AS pos FROM p UNION ALL SELECT conv_id, 'caption', md5('Find: ' || b), md5(a) FROM p""")
def conversation_pairs(t: Tables) -> DataFrame:
    parts = [P.conversation_pairs(t.conversations, "conv_id", "turn", "text", m, "Find: ").select(
        "conv_id", F.lit(m).alias("mode"), F.md5("query_text").alias("query"), F.md5("pos_text").alias("pos")) for m in ("answer", "caption")]
    return parts[0].unionByName(parts[1])


# --- statistics -----------------------------------------------------------------------------------

SPLITS = """
WITH w AS (SELECT source, CAST(quality AS INT) AS a, 1 - toxic AS b FROM labels JOIN documents USING (doc_id)),
d AS (SELECT source, count(*) AS n, count(CASE WHEN a = 1 AND b = 0 THEN 1 END) AS only_a, count(CASE WHEN a = 0 AND b = 1 THEN 1 END) AS only_b FROM w GROUP BY source
      UNION ALL SELECT 'ALL', count(*), count(CASE WHEN a = 1 AND b = 0 THEN 1 END), count(CASE WHEN a = 0 AND b = 1 THEN 1 END) FROM w)
"""


def splits(t: Tables) -> DataFrame:
    a, b = F.col("a") == 1, F.col("b") == 1
    return V.arms(t).rollup("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b")).withColumn(
        "source", F.coalesce("source", F.lit("ALL")))


@query("mcnemar_exact", SPLITS + """
, t AS (SELECT *, only_a + only_b AS m, least(only_a, only_b) AS k FROM d),
p AS (SELECT source, only_a, only_b, m, k, unnest(range(0, k + 1)) AS i FROM t)
SELECT source, only_a, only_b, round(CASE WHEN any_value(m) = 0 THEN 1 ELSE least(1.0, 2 * sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)))) END, 6) AS p
FROM p GROUP BY source, only_a, only_b""")
def mcnemar_exact(t: Tables) -> DataFrame:
    return splits(t).select("source", "only_a", "only_b", F.round(S.exact_paired_p("only_a", "only_b"), 6).alias("p"))


@query("wald_paired_ci", SPLITS + """
, e AS (SELECT *, (only_a - only_b) / n AS diff, sqrt(greatest(only_a + only_b - (only_a - only_b) * (only_a - only_b) / n, 0)) / n AS se, (only_a + only_b) / n AS pr FROM d)
SELECT source, round(diff, 6) AS diff, round(diff - 1.96::DOUBLE * se, 6) AS low, round(diff + 1.96::DOUBLE * se, 6) AS high,
  round(pr - 1.96::DOUBLE * sqrt(pr * (1 - pr) / n), 6) AS p_low, round(pr + 1.96::DOUBLE * sqrt(pr * (1 - pr) / n), 6) AS p_high FROM e""")
def wald_paired_ci(t: Tables) -> DataFrame:
    ci = S.paired_interval(F.col("n"), F.col("only_a"), F.col("only_b"))
    pr = S.proportion_interval((F.col("only_a") + F.col("only_b")) / F.col("n"), F.col("n"))
    return splits(t).select("source", *[F.round(c, 6).alias(n) for n, c in ci.items()],
                            F.round(pr["low"], 6).alias("p_low"), F.round(pr["high"], 6).alias("p_high"))


@query("chance_recall", """
WITH q AS (SELECT o_orderkey, o_custkey % 25 AS t, o_orderkey % 3000 AS v FROM orders),
m AS (SELECT *, list_product(list_transform(range(0, least(50, v)), lambda i: greatest(v - t - i, 0) / (v - i)::DOUBLE)) AS miss FROM q),
c AS (SELECT t, v, CASE WHEN t <= 0 OR v <= 0 THEN 0 WHEN t >= v THEN 1 ELSE 1 - miss END AS c FROM m)
SELECT t, count(*) AS n, round(avg(c), 6) AS chance_50, CAST(floor(median((v + 1) / (t + 1))) AS BIGINT) AS best_rank FROM c GROUP BY t""")
def chance_recall(t: Tables) -> DataFrame:
    q = t.orders.select((F.col("o_custkey") % 25).alias("t"), (F.col("o_orderkey") % 3000).alias("v"))
    q = q.withColumn("c", S.chance_recall("t", "v", 50)).withColumn("e", S.expected_best_rank("t", "v"))
    mean = q.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("chance_50"))
    return mean.join(exact_percentile(q, ["t"], "e", 0.5, "m"), "t").select("t", "n", "chance_50", F.floor("m").alias("best_rank"))


def _diffs(t: Tables) -> DataFrame:
    return V.arms(t).select((F.col("a") - F.col("b")).alias("d"))


@query("sign_flip_test")
def sign_flip_test(t: Tables) -> DataFrame:
    return S.sign_flip_p(_diffs(t), "d", n=50000, seed=1)


@query("bootstrap_ci")
def bootstrap_ci(t: Tables) -> DataFrame:
    return S.bootstrap_interval(_diffs(t), "d", draws=10000, seed=1)


def signed_rank_sql(group: str) -> str:
    """Sums of signed ranks; `d` counts the sign patterns for every number of ranks up to 50, one rank more in each step."""
    poly = "0"
    for term in reversed(S.ERF_TERMS):
        poly = f"t * ({term} + {poly})"
    return f"""
WITH RECURSIVE p AS (SELECT {group} AS g, round(ln((o_custkey % 300 + 1) / (o_orderkey % 280 + 1)), 12) AS d FROM orders),
r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY g, abs(d)) AS tie FROM p WHERE d <> 0),
s AS (SELECT g, count(*) AS n, count(CASE WHEN d > 0 THEN 1 END) AS better, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w, sum(tie * tie - 1) AS ties FROM r GROUP BY g),
z AS (SELECT *, CASE WHEN n >= 10 THEN (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) END AS z,
  CASE WHEN n >= 10 THEN CASE WHEN n <= 50 AND ties = 0 THEN 'exact' ELSE 'normal' END END AS method FROM s),
d(k, c) AS (SELECT 0::BIGINT, [1::DOUBLE] UNION ALL
  SELECT k + 1, list_transform(range(0, (k + 1) * (k + 2) // 2 + 1), lambda i: coalesce(c[i + 1], 0) + CASE WHEN i > k THEN coalesce(c[i - k], 0) ELSE 0 END) FROM d WHERE k < 50),
e AS (SELECT *, 1 / (1 + {S.ERF_SCALE} * abs(z) / sqrt(2)) AS t FROM z LEFT JOIN d ON d.k = z.n AND method = 'exact')
SELECT g, n, better, n - better AS worse, CAST(w AS DOUBLE) AS w, round(z, 6) AS z, method,
  round(CASE method WHEN 'exact' THEN least(1, 2 * least(list_sum(c[1:CAST(w AS BIGINT) + 1]), list_sum(c[CAST(w AS BIGINT) + 1:])) / 2 ** n)
    WHEN 'normal' THEN {poly} * exp(-z * z / 2) END, 6) AS p FROM e"""


def _signed_rank(t: Tables, group: str) -> DataFrame:
    p = t.orders.select(F.col(group).alias("g"), (F.col("o_custkey") % 300 + 1).alias("a"), (F.col("o_orderkey") % 280 + 1).alias("b"))
    return S.signed_rank(p, "g", "a", "b").withColumns({c: F.round(c, 6) for c in ("z", "p")})


@query("signed_rank_test", signed_rank_sql("o_orderpriority"))
def signed_rank_test(t: Tables) -> DataFrame:
    return _signed_rank(t, "o_orderpriority")


@query("signed_rank_exact", signed_rank_sql("o_custkey"))
def signed_rank_exact(t: Tables) -> DataFrame:
    """A test per customer: few orders each, so that sign patterns are counted out where no sizes tie."""
    return _signed_rank(t, "o_custkey")


@query("correlation", """
SELECT o_orderpriority AS g, round(corr(o_totalprice, o_custkey), 6) AS r, count(*) AS n FROM orders GROUP BY 1""")
def correlation(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("g")).agg(
        F.round(F.corr("o_totalprice", "o_custkey"), 6).alias("r"), F.count(F.lit(1)).alias("n"))
