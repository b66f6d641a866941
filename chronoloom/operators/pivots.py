"""Exact neighbours above a least cosine, with blocks of vectors left out by the triangle bound on angles.

A few vectors are drawn as pivots; every vector belongs to its nearest one, and a cell's radius is the
largest angle between its pivot and a member. Two vectors whose cosine reaches `least` are at most
arccos(least) apart, so a query can only have neighbours in cells whose pivot is no farther from it than that plus
the radius, and a row only matters to cells of queries under the same bound. Each side is therefore listed
just for the pairs of cells where its own bound holds; all other pairs of blocks are never made. What is left is
multiplied as in `vectors`, so results are those of the full product.

The driver holds DRAWN * PIVOTS vectors at most, and one radius and count per cell. A cell with
more vectors than a block, such as very many equal ones, is dealt into parts by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as V

PIVOTS = 1024
CELLS = 4      # pivots for each block of rows
DRAWN = 8
SEED = 11
SLACK = 1e-6   # radians; more than the rounding errors of angles and scores
SURVEYED = 4096    # vectors of each side that tell what the bound leaves
MOST_LEFT = 0.5    # of all pairs; beyond that, lists per pair of cells cost more than they spare


def _directions(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors at length one, however short they are; null vectors stay null vectors."""
    m = V._matrix(vectors if isinstance(vectors, pa.ChunkedArray) else pa.chunked_array([vectors]), False)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _angles(vectors: pa.ChunkedArray | pa.Array, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_directions(vectors) @ pivots.T, -1.0, 1.0))


def draw_pivots(rows: DataFrame, row_id: str, vec: str, n: int) -> np.ndarray:
    """Up to `n` different directions; they decide the cost, never the result.

    Out of DRAWN times as many vectors, drawn by a seeded hash of the ids, each pivot is the one farthest from those before it,
    so that every cluster of some size gets one.
    """
    order = F.md5(F.concat(F.lit(f"{SEED}|"), F.col(row_id).cast("string")))
    drawn = rows.where(V.dot(vec, vec) > 0).select(vec, order.alias("_o")).orderBy("_o").limit(DRAWN * n).toArrow()
    if not drawn.num_rows:
        return np.zeros((0, 1))
    found = np.unique(_directions(drawn.column(vec)), axis=0)
    picked, closest = [0], found @ found[0]
    while len(picked) < n and closest.min() < 1 - SLACK:
        picked.append(int(closest.argmin()))
        closest = np.maximum(closest, found @ found[picked[-1]])
    return found[picked]


def cells(df: DataFrame, vec: str, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radius and number of members of each pivot's cell; the radius is -inf without members."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, members = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
        for b in batches:
            angle = _angles(b.column(0), pivots)
            own = angle.argmin(axis=1)
            np.maximum.at(radius, own, angle[np.arange(len(own)), own])
            members += np.bincount(own, minlength=len(pivots))
        at = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(radius[at]), pa.array(members[at])], names=["cell", "radius", "n"])

    parts = df.select(vec).mapInArrow(near, "cell bigint, radius double, n bigint")
    radius, members = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for cell, r, n in parts.groupBy("cell").agg(F.max("radius"), F.sum("n")).collect():
        radius[cell], members[cell] = r, n
    return radius, members


def share_left(df: DataFrame, ids: Sequence[str], vec: str, pivots: np.ndarray, reach: float, open_cells: np.ndarray,
               radius: np.ndarray, members: np.ndarray) -> float:
    """The share of the other side's vectors that the bound leaves to a vector of `df`, from about SURVEYED of them by hash."""
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle = _angles(b.column(0), pivots)
            meets = (angle - radius[None, :] <= reach) & open_cells[angle.argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array([int((meets @ members).sum())]), pa.array([b.num_rows])], names=["met", "n"])

    every = max(1, df.count() // SURVEYED)
    seen = df.where(F.pmod(F.xxhash64(F.lit(SEED), *ids), F.lit(every)) == 0).select(vec).mapInArrow(met, "met bigint, n bigint")
    n_met, n = seen.agg(F.sum("met"), F.sum("n")).first()
    return (n_met or 0) / max(1, (n or 0) * int(members.sum()))


def cell_pairs(queries: DataFrame, rows: DataFrame, query_ids: Sequence[str], row_id: str, query_vec: str, row_vec: str,
               least: float, pivots: np.ndarray) -> tuple[DataFrame, DataFrame] | None:
    """Both sides listed once per pair of blocks that the bound leaves, as `_qb` and `_rb`; None if it leaves most pairs."""
    reach = math.acos(min(1.0, least)) + SLACK
    between = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    (radius_q, n_q), (radius_r, n_r) = cells(queries, query_vec, pivots), cells(rows, row_vec, pivots)
    possible = between - radius_q[:, None] - radius_r[None, :] <= reach
    if all(share_left(*side) > MOST_LEFT for side in (
            (queries, query_ids, query_vec, pivots, reach, possible, radius_r, n_r),
            (rows, [row_id], row_vec, pivots, reach, possible.T, radius_q, n_q))):
        return None

    def parts(n: np.ndarray, per_block: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.maximum(1, -(-n // per_block))
        return own, np.cumsum(own) - own

    (own_q, first_q), (own_r, first_r) = parts(n_q, V.QUERY_BLOCK), parts(n_r, V.ROW_BLOCK)

    def listed(df: DataFrame, ids: Sequence[str], vec: str, open_cells: np.ndarray, radius: np.ndarray, own: tuple, other: tuple,
               mine: str, theirs: str) -> DataFrame:
        """Rows of `df` with their own block and the blocks of the other side that they may have to meet."""
        kept = df.schema
        schema = T.StructType([*kept.fields, T.StructField(mine, T.LongType()), T.StructField(theirs, T.ArrayType(T.LongType()))])
        place, hashed = kept.fieldNames().index(vec), len(kept)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 2048):
                    part = b.slice(i, 2048)
                    angle = _angles(part.column(place), pivots)
                    cell = angle.argmin(axis=1)
                    block = own[1][cell] + part.column(hashed).to_numpy() % own[0][cell]
                    meets = (angle - radius[None, :] <= reach) & open_cells[cell]
                    lists = [np.concatenate([np.arange(other[1][c], other[1][c] + other[0][c]) for c in np.flatnonzero(m)] or [np.empty(0, np.int64)])
                             for m in meets]
                    yield pa.RecordBatch.from_arrays([*part.columns[:hashed], pa.array(block, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                                                     names=schema.fieldNames())

        out = df.withColumn("_h", F.pmod(F.xxhash64(*ids), F.lit(1 << 40))).mapInArrow(run, schema)
        return out.withColumn(theirs, F.explode(theirs))

    q = listed(queries, query_ids, query_vec, possible, radius_r, (own_q, first_q), (own_r, first_r), "_qb", "_rb")
    r = listed(rows, [row_id], row_vec, possible.T, radius_q, (own_r, first_r), (own_q, first_q), "_rb", "_qb")
    return q, r


def nearest_above(queries: DataFrame, rows: DataFrame, k: int, least: float, query_ids: Sequence[str], row_id: str,
                  query_vec: str = "qvec", row_vec: str = "vec", not_same: str | None = None, ties: bool = False) -> DataFrame:
    """The k best rows per query by cosine among those of at least `least`, ties to the smaller row id.

    Equal to `vectors.topk` filtered by score, also with `ties`. Rows that fit one block, bounds of 0 or less, and vectors so far from
    each other that the bound leaves most pairs, take the full product: there is nothing to leave out that would pay for the pivots. Its blocks
    of rows are long, because what a block sends on is up to `k` rows per query, however many rows it has.
    """
    qcols = list(dict.fromkeys([*query_ids, query_vec, *([not_same] if not_same else [])]))
    q0, r0 = queries.select(*qcols), rows.select(row_id, row_vec)
    n = V._block_count(r0.count(), V.ROW_BLOCK)
    pivots = draw_pivots(r0, row_id, row_vec, min(PIVOTS, CELLS * n)) if n > 1 and least > 0 else np.zeros((0, 1))
    ids = list(query_ids)
    near = cell_pairs(q0, r0, ids, row_id, query_vec, row_vec, least, pivots) if len(pivots) > 1 else None
    blocks = V._cogrouped(*near, ()) if near else V._pairs_of_blocks(q0, r0, ids, row_id, (), long=True)
    partial = blocks.applyInArrow(
        lambda q, r: V.best_in_block(q, r, ids, row_id, k, query_vec, row_vec, True, None, not_same, least, ties),
        f"{V._types(q0, ids)}, {V._types(r0, [row_id])}, score double")
    return V._merged(partial, ids, row_id, k, ties)
