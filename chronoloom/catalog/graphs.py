"""Vector search, graph retrieval and near-duplicate removal over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import graph as P
from ..operators import graph_build as B
from ..operators import neighbours as N
from ..operators import vectors as X
from . import views as V
from .aggregates import ring
from .registry import Tables, query

VEC = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)\n"
COS = VEC + """, s AS (SELECT a.vec_id AS qid, b.vec_id AS rid, a.label AS ql, b.label AS rl, round(list_cosine_similarity(a.vec, b.vec), 9) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id)\n"""
DOT = VEC + """, s AS (SELECT a.vec_id AS qid, b.vec_id AS rid, a.label AS ql, b.label AS rl, round(list_inner_product(a.vec, b.vec), 9) AS score
      FROM v a CROSS JOIN v b)\n"""


def both_sides(t: Tables):
    v = V.vecs(t)
    return (v.select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec"), F.col("label").alias("ql")),
            v.select(F.col("vec_id").alias("rid"), "vec", F.col("label").alias("rl")))


@query("cosine_topk", COS + """
SELECT qid, rid, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) <= 10""")
def cosine_topk(t: Tables) -> DataFrame:
    q, r = both_sides(t)
    return X.topk(q, r, 10, ["qid"], "rid", not_same="qid").withColumn("score", F.round("score", 6))


@query("dense_passage_retrieval", DOT + """
, e AS (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM s)
SELECT qid, rid, round(score, 6) AS score, round(CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END, 6) AS scaled,
  row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank FROM e
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) <= 20""")
def dense_passage_retrieval(t: Tables) -> DataFrame:
    q, r = both_sides(t)
    return X.dense_retrieval(q, r, 20, ["qid"], "rid").select(
        "qid", "rid", F.round("score", 6).alias("score"), F.round("scaled", 6).alias("scaled"), "rank")


@query("fact_scores", DOT + """
, e AS (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM s),
top AS (SELECT qid, rid, round((score - lo) / (hi - lo), 6) AS scaled, score FROM e QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) <= 5),
kept AS (SELECT * FROM top WHERE round(score, 6) >= 0.3 AND rid <> qid)
SELECT qid, rid, scaled, 'facts' AS route FROM kept
UNION ALL SELECT vec_id, NULL, NULL, 'passages' FROM v WHERE vec_id NOT IN (SELECT qid FROM kept)""")
def fact_scores(t: Tables) -> DataFrame:
    q, r = both_sides(t)
    kept, rest = N.fact_links(q, r, 5, (F.round("score", 6) >= 0.3) & (F.col("rid") != F.col("qid")), fact_id="rid")
    kept = kept.select("qid", "rid", F.round("scaled", 6).alias("scaled"), F.lit("facts").alias("route"))
    return kept.unionByName(rest.select("qid", F.lit(None).cast("bigint").alias("rid"), F.lit(None).cast("double").alias("scaled"),
                                        F.lit("passages").alias("route")))


@query("relevant_pairs", COS.replace("v a JOIN v b ON a.vec_id <> b.vec_id", "v a CROSS JOIN v b") + """
, top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) <= 20)
SELECT qid, rid, round(score, 6) AS score FROM top WHERE score >= 0.2""")
def relevant_pairs(t: Tables) -> DataFrame:
    """Every vector is a new row once, and an existing row; it counts among its own relevant rows."""
    q, r = both_sides(t)
    pairs = N.relevant_pairs(q, r, "qid", "rid", least=0.2)
    return pairs.select("qid", "rid", F.round("score", 6).alias("score"))


@query("synonym_edges", COS + """
, n AS (SELECT 'e' || qid AS src, 'e' || rid AS dst, score FROM s WHERE qid >= 10),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 101)
SELECT src, dst, round(score, 6) AS score FROM k WHERE score >= 0.25""")
def synonym_edges(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("entity"), F.col("embedding").alias("vec"))
    return N.synonym_edges(e, "entity", least=0.25).withColumn("score", F.round("score", 6))


def _ppr_sql(steps: int, damping: float) -> str:
    """`links(src, dst, share)` and `seeds(qid, node, r)` -> the state after a number of steps."""
    out = ["p0 AS MATERIALIZED (SELECT qid, node, r AS p FROM seeds)", "linked AS MATERIALIZED (SELECT DISTINCT src FROM links)"]
    for i in range(1, steps + 1):
        out.append(f"""p{i} AS MATERIALIZED (SELECT qid, node, sum(x) AS p FROM (
   SELECT a.qid, l.dst AS node, sum(a.p * l.share) * {damping} AS x FROM p{i - 1} a JOIN links l ON l.src = a.node GROUP BY ALL
   UNION ALL SELECT s.qid, s.node, s.r * ({1 - damping} + {damping} * coalesce(d.d, 0)) FROM seeds s LEFT JOIN
     (SELECT qid, sum(p) AS d FROM p{i - 1} WHERE node NOT IN (SELECT src FROM linked) GROUP BY qid) d ON d.qid = s.qid) GROUP BY qid, node)""")
    return ",\n".join(out)


TRI = V.with_views("triples") + """
, n AS (SELECT tid, doc, trim(regexp_replace(lower(s), '[^a-z0-9 ]', ' ', 'g')) AS s, trim(regexp_replace(lower(p), '[^a-z0-9 ]', ' ', 'g')) AS p,
   trim(regexp_replace(lower(o), '[^a-z0-9 ]', ' ', 'g')) AS o FROM triples)
"""


@query("fact_graph_ppr", TRI + """
, m AS (SELECT DISTINCT doc, unnest([s, o]) AS entity FROM n),
e0 AS (SELECT s AS src, o AS dst, count(*) AS w FROM n WHERE s <> o GROUP BY ALL UNION ALL SELECT o, s, count(*) FROM n WHERE s <> o GROUP BY ALL
  UNION ALL SELECT 'chunk-' || doc, entity, 1 FROM m UNION ALL SELECT entity, 'chunk-' || doc, 1 FROM m),
e1 AS (SELECT src, dst, CAST(sum(w) AS DOUBLE) AS w FROM e0 GROUP BY ALL),
links AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM e1),
r0 AS (SELECT n_regionkey AS qid, 'supplier  ' || s_suppkey AS node, CASE WHEN s_acctbal > 0 THEN s_acctbal / 1000 ELSE 0 END AS m FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT n_regionkey, 'chunk-' || o_orderkey, 0.05::DOUBLE * (o_totalprice / 100000) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
r1 AS (SELECT qid, node, sum(m) AS m FROM r0 GROUP BY ALL HAVING sum(m) > 0),
seeds AS MATERIALIZED (SELECT qid, node, m / sum(m) OVER (PARTITION BY qid) AS r FROM r1),
""" + _ppr_sql(45, 0.5) + """
SELECT CAST(qid AS BIGINT) AS qid, node, round(p, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(p, 9) DESC, node) AS rank FROM p45 WHERE node LIKE 'chunk-%'
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(p, 9) DESC, node) <= 20""")
def fact_graph_ppr(t: Tables) -> DataFrame:
    """One query per region: its suppliers are the phrases, its customers' orders the passages."""
    tri = V.normal_triples(t)
    passage = B.passage_edges(tri)
    edges = B.fact_edges(tri).unionByName(passage).unionByName(
        passage.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    nation = t.nation.select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("qid"))
    phrases = t.supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        "qid", F.concat(F.lit("supplier  "), F.col("s_suppkey").cast("string")).alias("node"), (F.col("s_acctbal") / 1000).alias("weight"))
    passages = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
                .select("qid", F.concat(F.lit("chunk-"), F.col("o_orderkey").cast("string")).alias("node"), (F.col("o_totalprice") / 100000).alias("score")))
    top = P.passages_by_ppr(edges, phrases, passages, 0.05, 20, tol=1e-9)
    return top.withColumn("score", F.round("score", 6))


@query("triple_graph_ppr", V.with_views("triples") + """
, e1 AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT s AS src, o AS dst FROM triples WHERE s <> o UNION ALL SELECT o, s FROM triples WHERE s <> o) GROUP BY ALL),
links AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM e1),
sim AS (SELECT o_custkey % 25 AS qid, tid FROM triples JOIN orders ON o_orderkey = doc WHERE p = 'R' QUALIFY row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY tid * 37 % 1009 DESC, tid, s, o) <= 10),
r1 AS (SELECT DISTINCT qid, unnest([s, o]) AS node FROM sim JOIN (SELECT DISTINCT tid, s, o FROM triples) t ON t.tid = sim.tid),
seeds AS MATERIALIZED (SELECT qid, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY qid) AS r FROM r1),
""" + _ppr_sql(150, 0.85) + """
, pr AS (SELECT DISTINCT s, o FROM triples),
sc AS (SELECT a.qid, pr.s, pr.o, a.p + b.p AS score FROM pr JOIN p150 a ON a.node = pr.s JOIN p150 b ON b.node = pr.o AND b.qid = a.qid)
SELECT CAST(qid AS BIGINT) AS qid, tid, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, tid) AS rank
FROM sc JOIN triples t ON t.s = sc.s AND t.o = sc.o QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, tid) <= 10""")
def triple_graph_ppr(t: Tables) -> DataFrame:
    from pyspark.sql import Window
    tri = V.triples(t).select("tid", "doc", "s", "p", "o")
    owner = t.orders.select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 25).alias("qid"))
    score = F.col("tid") * 37 % 1009
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "tid", "s", "o")
    sim = (tri.where("p = 'R'").join(owner, "doc").withColumn("score", score.cast("double"))
           .withColumn("r", F.row_number().over(w)).where("r <= 10").select("qid", "tid", "score"))
    top = P.triples_by_ppr(tri.select("tid", "s", "o"), sim, 10, tol=1e-9)
    return top.select("qid", "tid", F.round("score", 6).alias("score"), "rank")


@query("maxsim", V.with_views("asks", "vecs") + """
, q AS (SELECT qid, qno AS token, vec AS qvec FROM asks JOIN vecs ON vkey % n_vec = vec_id),
b AS (SELECT q.qid, token, v.vec_id % 23 AS passage, max(round(list_inner_product(qvec, v.vec), 9)) AS best FROM q CROSS JOIN vecs v GROUP BY ALL),
s AS (SELECT qid, passage, round(sum(best), 9) AS score FROM b GROUP BY ALL)
SELECT qid, passage, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, passage) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, passage) <= 5""")
def maxsim(t: Tables) -> DataFrame:
    from .study import ask_vectors
    q = ask_vectors(t).select("qid", F.col("qno").alias("token"), "qvec")
    r = V.vecs(t).select((F.col("vec_id") % 23).alias("passage"), F.col("vec_id").alias("row_id"), "vec")
    return N.maxsim(q, r, 5).withColumn("score", F.round("score", 6))


@query("eval_rank", VEC + """
, r AS (SELECT vec_id, label, vec, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS size FROM v),
g AS (SELECT a.vec_id AS qid, b.vec_id AS gold FROM r a JOIN r b ON a.label = b.label AND a.vec_id <> b.vec_id AND (b.rn - a.rn + a.size) % a.size = 1),
s AS (SELECT a.vec_id AS qid, b.vec_id AS rid, a.label = b.label AND a.vec_id <> b.vec_id AND (b.rn - a.rn + a.size) % a.size <= 20 AS own, round(list_cosine_similarity(a.vec, b.vec), 9) AS score FROM r a CROSS JOIN r b),
c AS (SELECT g.qid, s.score AS cut, g.gold FROM g JOIN s ON s.qid = g.qid AND s.rid = g.gold)
SELECT c.qid, count(CASE WHEN score > cut OR (score = cut AND rid < gold) THEN 1 END) + 1 AS rank_all,
  count(CASE WHEN own AND (score > cut OR (score = cut AND rid < gold)) THEN 1 END) + 1 AS rank_own, count(CASE WHEN own THEN 1 END) AS n_own
FROM c JOIN s ON s.qid = c.qid GROUP BY c.qid""")
def eval_rank(t: Tables) -> DataFrame:
    q, r = both_sides(t)
    own = ring(t, 20)
    gold, own = own.where("step = 1").select("qid", "rid"), own.select("qid", "rid")
    queries, rows = q.select("qid", "qvec"), r.select("rid", "vec")
    everyone = N.rank_among_all(queries, rows, gold).select("qid", F.col("rank").alias("rank_all"))
    mine = N.rank_among_own(own, queries, rows, gold).select("qid", F.col("rank").alias("rank_own"), F.col("n_seen").alias("n_own"))
    return everyone.join(mine, "qid")


def minhash_sql() -> str:
    """Signatures by whole numbers of 128 bits, bands as lists, clusters by a recursive walk. The permutations are drawn by the
    operator's rule."""
    a, b = D.coefficients()
    used = D.BANDS * D.BAND_ROWS
    draws = ", ".join(f"({i}, {x}::HUGEINT, {y}::HUGEINT)" for i, (x, y) in enumerate(zip(a[:used], b[:used], strict=True)))
    return rf"""
WITH RECURSIVE perm(i, a, b) AS (VALUES {draws}),
w AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{D.NOT_TOKEN}') AS t FROM documents),
g AS (SELECT doc_id, t, unnest(range(1, len(t) - {D.NGRAM} + 2)) AS i FROM w),
s AS (SELECT doc_id, sha1(array_to_string(t[i:i + {D.NGRAM} - 1], ' ')) AS x FROM g),
h AS (SELECT DISTINCT doc_id, CAST('0x' || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS BIGINT)::HUGEINT AS h FROM s),
m AS (SELECT doc_id, i, min((h * a + b) % 18446744073709551616::HUGEINT % {int(D.PRIME)}::HUGEINT % 4294967296::HUGEINT) AS m FROM h, perm GROUP BY doc_id, i),
k AS (SELECT doc_id, i // {D.BAND_ROWS} AS band, list(m ORDER BY i) AS k FROM m GROUP BY doc_id, band),
e AS (SELECT doc_id AS u, min(doc_id) OVER (PARTITION BY band, k) AS v FROM k),
l AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
reach AS (SELECT u AS node, u AS low FROM l UNION SELECT l.v, r.low FROM reach r JOIN l ON l.u = r.node)
SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id NOT IN (SELECT node FROM reach GROUP BY node HAVING min(low) < node)"""


@query("minhash_dedup", minhash_sql())
def minhash_dedup(t: Tables) -> DataFrame:
    kept = D.deduplicate(t.documents.select("doc_id", "text"), "doc_id", "text")
    return kept.select("doc_id", F.md5("text").alias("h"))


@query("connected_components", COS.replace("WITH v AS", "WITH RECURSIVE v AS") + """
, nn AS (SELECT qid AS u, rid AS v FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) = 1),
b AS (SELECT u, v FROM nn UNION SELECT v, u FROM nn),
reach AS (SELECT u AS node, u AS low FROM b UNION SELECT b.v, r.low FROM reach r JOIN b ON b.u = r.node)
SELECT node, min(low) AS component FROM reach GROUP BY node""")
def connected_components(t: Tables) -> DataFrame:
    q, r = both_sides(t)
    near = X.topk(q, r, 1, ["qid"], "rid", not_same="qid")
    return P.connected_components(near.select(F.col("qid").alias("u"), F.col("rid").alias("v")))


@query("delete_documents", TRI + """
, f AS (SELECT doc, s, p || (doc % 40) AS p, o || CASE WHEN doc % 200 = 7 THEN ' x' || doc ELSE '' END AS o FROM n),
kept AS (SELECT * FROM f WHERE doc NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))
SELECT (SELECT count(DISTINCT doc) FROM kept) AS n_docs, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM kept)) AS n_facts,
  (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM f EXCEPT SELECT s, p, o FROM kept)) AS n_facts_gone,
  (SELECT count(DISTINCT e) FROM (SELECT unnest([s, o]) AS e FROM kept)) AS n_entities,
  (SELECT count(*) FROM (SELECT DISTINCT unnest([s, o]) FROM f EXCEPT SELECT unnest([s, o]) FROM kept)) AS n_entities_gone,
  (SELECT count(*) FROM (SELECT DISTINCT doc, unnest([s, o]) FROM kept)) AS n_passage_edges""")
def delete_documents(t: Tables) -> DataFrame:
    from ..operators.incremental import delete_documents as delete
    tri = V.normal_triples(t)
    rare = F.when(F.col("doc") % 200 == 7, F.concat(F.lit(" x"), F.col("doc").cast("string"))).otherwise("")
    f = tri.select("doc", "s", F.concat("p", (F.col("doc") % 40).cast("string")).alias("p"), F.concat("o", rare).alias("o"))
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc"))
    return delete(f, gone)
