"""Operators on top of the blocked vector kernel: links, synonyms, facts, late interaction, eval ranks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small_side
from . import vectors as V
from .pivots import nearest_above

#: Fixed values of the graph index: neighbour count, least similarity, kept synonyms, name length.
SYNONYM_LIMIT = 101
SYNONYM_SCORE = 0.8
NAME_LENGTH = 2
RELEVANT_TOP = 20
RELEVANT_SCORE = 0.6


def relevant_pairs(new: DataFrame, old: DataFrame, new_id: str, old_id: str, top: int = RELEVANT_TOP,
                   least: float = RELEVANT_SCORE) -> DataFrame:
    """Existing rows per new row: first the `top` by cosine, then those of at least `least`."""
    return nearest_above(new, old, top, least, [new_id], old_id)


def relevant_by_vector(queries: DataFrame, vectors: DataFrame, members: DataFrame, old_id: str, top: int = RELEVANT_TOP,
                       least: float = RELEVANT_SCORE) -> DataFrame:
    """(query, old_id, score, rank): `relevant_pairs` where many rows share a vector.

    queries: query, qvec; vectors: key, vec, each different vector once; members: key, old_id. Equal vectors are multiplied once,
    and only the `top` smallest ids of each can be listed. Of the vectors only those stay that fewer than `top` ids outrank.
    """
    of_key = Window.partitionBy("key").orderBy(old_id)
    first = cut(members.select("key", old_id).withColumn("_r", F.dense_rank().over(of_key)).where(F.col("_r") <= top).drop("_r").distinct())
    sizes = cut(first.groupBy("key").agg(F.count(F.lit(1)).alias("_n")))
    near = nearest_above(queries, vectors.join(sizes.select("key"), "key"), top, least, ["query"], "key", ties=True).drop("rank").join(sizes, "key")
    upto = F.sum("_n").over(Window.partitionBy("query").orderBy(F.desc("score")))
    level = F.sum("_n").over(Window.partitionBy("query", "score"))
    listed = near.withColumn("_ahead", upto - level).where(F.col("_ahead") < top).select("query", "key", "score").join(first, "key")
    w = Window.partitionBy("query").orderBy(F.desc("score"), old_id)
    return listed.drop("key").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def synonym_edges(entities: DataFrame, entity: str, vec: str = "vec", least: float = SYNONYM_SCORE) -> DataFrame:
    """Directed (src, dst, score): up to 101 neighbours of at least `least` for names of 3+ letters or digits.

    Only the source's name length is tested; an empty name is never a neighbour.
    """
    long_name = F.length(F.regexp_replace(entity, "[^A-Za-z0-9]", "")) > NAME_LENGTH
    q = entities.where(long_name).select(F.col(entity).alias("src"), F.col(vec).alias("qvec"))
    r = entities.where(F.col(entity) != "").select(F.col(entity).alias("dst"), F.col(vec).alias("vec"))
    return nearest_above(q, r, SYNONYM_LIMIT, least, ["src"], "dst", not_same="src").select("src", "dst", "score")


def fact_links(queries: DataFrame, facts: DataFrame, k: int, keep: Column | None = None,
               query_id: str = "qid", fact_id: str = "fact") -> tuple[DataFrame, DataFrame]:
    """(top facts per query with min-max scores, queries left without any fact).

    `keep` stands for a model that rejects facts; queries it leaves empty go to passage retrieval only.
    """
    top = V.dense_retrieval(queries, facts, k, [query_id], fact_id)
    kept = top if keep is None else top.where(keep)
    return kept, queries.select(query_id).join(kept.select(query_id).distinct(), query_id, "left_anti")


def maxsim(query_tokens: DataFrame, passage_tokens: DataFrame, k: int, qid: str = "qid", token: str = "token",
           passage: str = "passage", row_id: str = "row_id", oversize: int = V.ROW_BLOCK) -> DataFrame:
    """Late interaction: per query token the best dot product in a passage, summed; k best passages.

    query_tokens: qid, token, qvec; passage_tokens: passage, row_id, vec. Blocks hold whole queries and whole passages, so
    sums are finished in the task and only the k best passages of a block leave it. A passage of more than `oversize`
    rows is dealt into pieces by hash; then each query sends one list of token maxima per piece, but only where an upper
    bound, from every piece's centre and radius, reaches the query's k-th best score so far.
    A query's own tokens fit a task.
    """
    q0, r0 = query_tokens.select(qid, token, "qvec"), passage_tokens.select(passage, row_id, "vec")
    sizes = cut(r0.groupBy(passage).agg(F.count(F.lit(1)).alias("_n")))
    total, n_large = sizes.agg(F.sum("_n"), F.count_if(F.col("_n") > oversize)).first()
    small, rank_by = r0, [F.desc("score"), F.col(passage)]
    if n_large:
        # At most total / oversize passages; the size check decides whether they are broadcast.
        large = small_side(sizes.where(F.col("_n") > oversize), 64)
        small = r0.join(large.select(passage), passage, "left_anti")
    nq = V._block_count(q0.count(), V.QUERY_BLOCK)
    nr = V._block_count(total or 0, V.ROW_BLOCK, q0.sparkSession.sparkContext.defaultParallelism)

    def paired(rows: DataFrame, deal: Sequence[str]):
        q = (q0.withColumn("_qb", V._hashed([qid], nq))
             .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)).cast("array<bigint>"))))
        r = (rows.withColumn("_rb", V._hashed(deal, nr))
             .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>"))))
        return V._cogrouped(*V._dealt(q, r, nq * nr), ())

    whole = paired(small, [passage]).applyInArrow(
        lambda q, r: _best_passages(q, r, k, qid, token, passage), f"{V._types(q0, [qid])}, {V._types(r0, [passage])}, score double")
    w = Window.partitionBy(qid).orderBy(*rank_by)
    best = whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if not n_large:
        return best
    best = cut(best)
    pieces = (r0.join(large, passage).withColumn("_piece", V._hashed([row_id], F.ceil(F.col("_n") / F.lit(oversize)).cast("bigint")))
              .drop("_n"))
    bounds = pieces.groupBy(passage, "_piece").applyInArrow(
        lambda p: _ball(p, [passage, "_piece"]), f"{V._types(r0, [passage])}, _piece bigint, vec array<double>, radius double")
    reached = best.groupBy(qid).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_least"))
    hopeful = (_upper_bounds(q0, cut(bounds), qid, token, passage, nq).join(reached, qid, "left")
               .where(F.col("_least").isNull() | (F.col("upper") >= F.col("_least") - F.lit(V.BAND))).select(qid, passage))
    both = best.drop("rank").unionByName(_summed_maxima(_piece_maxima(q0, pieces, cut(hopeful), qid, token, passage, nq), qid, passage))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _starts(column: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal values begin in a sorted column."""
    codes = column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1)).astype(np.int64) if len(codes) else np.empty(0, np.int64)


def _whole_queries(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Slices (first, last + 1) of whole queries of about V.SLICE tokens."""
    ends, out = np.append(starts[1:], n), []
    i = 0
    while i < len(starts):
        j = i + 1
        while j < len(starts) and ends[j] - starts[i] <= V.SLICE:
            j += 1
        out.append((i, j))
        i = j
    return out


def _passage_maxima(left: np.ndarray, right: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Best product of each row of `left` with the rows of `right` from each start in `names` on, in strips that stay in the processor's cache."""
    best = np.full((len(left), len(names)), -np.inf)
    for a in range(0, len(right), V.STRIP):
        b = min(a + V.STRIP, len(right))
        i, j = np.searchsorted(names, a, side="right") - 1, np.searchsorted(names, b)
        s = np.maximum.reduceat(left @ right[a:b].T, np.maximum(names[i:j] - a, 0), axis=1)
        np.maximum(best[:, i:j], s, out=best[:, i:j])
    return best


def _best_passages(q: pa.Table, r: pa.Table, k: int, qid: str, token: str, passage: str) -> pa.Table:
    """Sums of token maxima over the whole passages of a block, the k best of each query."""
    q, r = q.sort_by([(qid, "ascending"), (token, "ascending")]), r.sort_by(passage)
    picked, scores = [(np.empty(0, np.int64), np.empty(0, np.int64))], [np.empty(0)]
    firsts, names = _starts(q.column(qid)), _starts(r.column(passage))
    if len(firsts) and len(names):
        left, right = V._matrix(q.column("qvec"), False), V._matrix(r.column("vec"), False)
        for i, j in _whole_queries(firsts, len(q)):
            a, b = firsts[i], firsts[j] if j < len(firsts) else len(q)
            s = np.concatenate([np.round(_passage_maxima(left[x:min(x + V.SLICE, b)], right, names), V.DIGITS) + 0.0 for x in range(a, b, V.SLICE)])
            s = np.round(np.add.reduceat(s, firsts[i:j] - a, axis=0), V.DIGITS)
            row, col = V._best_columns(s, k)
            picked.append((firsts[i + row], names[col]))
            scores.append(s[row, col])
    at_q, at_r = (pa.array(np.concatenate([x[j] for x in picked])) for j in (0, 1))
    return pa.table({qid: q.column(qid).take(at_q), passage: r.column(passage).take(at_r), "score": pa.array(np.concatenate(scores))})


def _ball(piece: pa.Table, keys: Sequence[str]) -> pa.Table:
    """Centre and radius of a piece of a passage."""
    m = V._matrix(piece.column("vec"), False)
    centre = m.mean(axis=0)
    radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1)).max())
    return pa.table({c: piece.column(c).slice(0, 1) for c in keys} | {"vec": pa.array([centre.tolist()]), "radius": pa.array([radius])})


def _upper_bounds(queries: DataFrame, bounds: DataFrame, qid: str, token: str, passage: str, nq: int) -> DataFrame:
    """(qid, passage, upper): no passage scores more than the sum over tokens of the best piece's q.centre + |q| radius."""
    nr = V._block_count(bounds.count(), V.ROW_BLOCK)
    q = queries.withColumn("_qb", V._hashed([qid], nq)).withColumn(
        "_rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)).cast("array<bigint>")))
    r = bounds.withColumn("_rb", V._hashed([passage], nr)).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")))

    def bound(q: pa.Table, r: pa.Table) -> pa.Table:
        q, r = q.sort_by([(qid, "ascending"), (token, "ascending")]), r.sort_by(passage)
        firsts, names = _starts(q.column(qid)), _starts(r.column(passage))
        out, at_q, at_r = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(firsts) and len(names):
            left = V._matrix(q.column("qvec"), False)
            s = left @ V._matrix(r.column("vec"), False).T + np.sqrt((left * left).sum(axis=1))[:, None] * r.column("radius").to_numpy()[None, :]
            s = np.add.reduceat(np.maximum.reduceat(s, names, axis=1), firsts, axis=0)
            out, at_q, at_r = s.ravel(), np.repeat(firsts, len(names)), np.tile(names, len(firsts))
        return pa.table({qid: q.column(qid).take(pa.array(at_q)), passage: r.column(passage).take(pa.array(at_r)), "upper": pa.array(out)})

    return V._cogrouped(q, r, ()).applyInArrow(bound, f"{V._types(queries, [qid])}, {V._types(bounds, [passage])}, upper double")


def _piece_maxima(queries: DataFrame, pieces: DataFrame, hopeful: DataFrame, qid: str, token: str, passage: str, nq: int) -> DataFrame:
    """One list of token maxima, in token order, per hopeful (query, passage) and piece."""
    parts = pieces.select(passage, F.col("_piece").alias("_part")).distinct()
    q = queries.withColumn("_qb", V._hashed([qid], nq)).join(hopeful.join(parts, passage), qid)
    r = pieces.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")))

    def block(q: pa.Table, r: pa.Table) -> pa.Table:
        q = q.sort_by([(qid, "ascending"), (token, "ascending")])
        firsts = _starts(q.column(qid))
        rows, lists = [], []
        if len(firsts) and len(r):
            left, right = V._matrix(q.column("qvec"), False), V._matrix(r.column("vec"), False).T
            best = np.concatenate([np.round((left[i:i + V.SLICE] @ right).max(axis=1), V.DIGITS) + 0.0 for i in range(0, len(q), V.SLICE)])
            rows, lists = firsts, np.split(best, firsts[1:])
        at = pa.array(rows, pa.int64())
        return pa.table({qid: q.column(qid).take(at), passage: q.column(passage).take(at), "best": pa.array(list(lists), pa.list_(pa.float64()))})

    return q.groupBy(passage, "_part", "_qb").cogroup(r.groupBy(passage, "_piece", "_qb")).applyInArrow(
        block, f"{V._types(queries, [qid])}, {V._types(pieces, [passage])}, best array<double>")


def _summed_maxima(parts: DataFrame, qid: str, passage: str) -> DataFrame:
    """The score of each query and passage: element-wise maxima over the pieces' lists, summed."""
    lists = parts.groupBy(qid, passage).agg(F.collect_list("best").alias("_all"))
    best = F.aggregate("_all", F.get("_all", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return lists.select(qid, passage, (F.round(F.aggregate(best, F.lit(0.0), lambda a, x: a + x), V.DIGITS) + 0.0).alias("score"))


def rank_among_all(queries: DataFrame, rows: DataFrame, gold: DataFrame, qid: str = "qid", rid: str = "rid") -> DataFrame:
    """Rank of each gold row among all rows by cosine. queries: qid, qvec; gold: qid, rid."""
    vec = rows.select(F.col(rid), "vec")
    known = (gold.join(queries, qid).join(vec, rid)
             .select(qid, "qvec", F.col(rid).alias("_gold"), (F.round(V.cosine("qvec", "vec"), V.DIGITS) + 0.0).alias("_cut")))
    counts = V.count_better(known, rows, [qid], rid, "_cut", "_gold")
    return counts.select(qid, (F.col("n_better") + 1).alias("rank"), "n_seen")


def rank_among_own(candidates: DataFrame, queries: DataFrame, rows: DataFrame, gold: DataFrame, qid: str = "qid",
                   rid: str = "rid") -> DataFrame:
    """Rank of each gold row within the query's own candidate rows (qid, rid); counted, not sorted."""
    scored = (candidates.join(queries, qid).join(rows.select(rid, "vec"), rid)
              .select(qid, rid, (F.round(V.cosine("qvec", "vec"), V.DIGITS) + 0.0).alias("s")))
    best = scored.join(gold, [qid, rid]).select(qid, F.col(rid).alias("_g"), F.col("s").alias("_s"))
    ahead = (F.col("s") > F.col("_s")) | ((F.col("s") == F.col("_s")) & (F.col(rid) < F.col("_g")))
    return scored.join(best, qid).groupBy(qid).agg(
        (F.count_if(ahead) + 1).alias("rank"), F.count(F.lit(1)).alias("n_seen"))
