"""Vector scoring: exact blocked products with partial results per block, then one small merge.

Queries and rows are hashed into blocks of bounded size; each (query block, row block) pair is one
task that multiplies two dense matrices and hands back only its k best rows (or counts) per query.
No (query, row) score pair is ever shuffled. Block loads come from hashed unique ids, so no key can
be hot. Scores are rounded to nine decimals so that equal vectors tie exactly on any block layout.

Under a future guard blocks follow time: queries and rows share time edges, so a pair of blocks lies
wholly in the past (no mask), on the diagonal (masked), or in the future, where it is never made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 8192
ROW_BLOCK = 32768
LONG_BLOCK = 131072   # rows of a block whose queries keep many: each block sends its own k best of every query
SLICE = 256   # queries multiplied at once inside a task, which bounds its memory
STRIP = 1024  # rows multiplied at once with them
DIGITS = 9
BAND = 2e-9   # scores farther than this from a bound are on the same side of it after rounding
GRID = 256    # time edges are picked from so many quantiles


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two float arrays in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column | str, floor: float = 1e-12) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(floor))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _matrix(vectors: pa.ChunkedArray, unit: bool) -> np.ndarray:
    """One row per vector, straight from Arrow's flat values."""
    if not len(vectors):
        return np.zeros((0, 1))
    if vectors.null_count:
        raise ValueError("vectors must not be null")
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks])
    m = flat.astype(np.float64).reshape(len(vectors), -1)
    if unit:
        m /= np.clip(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12, None)
    return m


def _numbers(column: pa.ChunkedArray, null: float) -> np.ndarray:
    """A numeric column; integers stay exact."""
    if column.null_count:
        column = pc.fill_null(column.cast(pa.float64()), null)
    return column.to_numpy()


def _block_count(n: int, per_block: int, spread: int = 1) -> int:
    return max(1, math.ceil(n / per_block), min(spread, math.ceil(n / 1024)))


def _hashed(names: Sequence[str], n: Column | int) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(n) if isinstance(n, int) else n)


def _pairs_of_blocks(queries: DataFrame, rows: DataFrame, query_ids: Sequence[str], row_id: str, by: Sequence[str], long: bool = False):
    """Both sides keyed by (by, query block, row block), ready for a cogroup.

    With `long`, blocks of rows are as few as their size and the number of cores allow.
    """
    spread = queries.sparkSession.sparkContext.defaultParallelism
    nq = _block_count(queries.count(), QUERY_BLOCK)
    nr = _block_count(rows.count(), LONG_BLOCK, math.ceil(3 * spread / nq)) if long else _block_count(rows.count(), ROW_BLOCK, spread)
    q = (queries.withColumn("_qb", _hashed(query_ids, nq))
         .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)).cast("array<bigint>"))))
    r = (rows.withColumn("_rb", _hashed([row_id], nr))
         .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>"))))
    return _cogrouped(*_dealt(q, r, nq * nr, by), by) if long else _cogrouped(q, r, by)


def _dealt(q: DataFrame, r: DataFrame, pairs: int, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides in partitions of a given number, for pairs of blocks with few bytes and much work.

    Such partitions are not merged by their size, and with several for each pair few of them get more than one.
    """
    n = max(1, min(4 * pairs, 64 * q.sparkSession.sparkContext.defaultParallelism))
    return tuple(x.repartition(n, *by, "_qb", "_rb") for x in (q, r))


def _cogrouped(q: DataFrame, r: DataFrame, by: Sequence[str]):
    keys = [*by, "_qb", "_rb"]
    return q.groupBy(*keys).cogroup(r.groupBy(*keys))


def time_blocks(queries: DataFrame, rows: DataFrame, query_ids: Sequence[str], row_id: str, at: str, end: str
                ) -> tuple[DataFrame, DataFrame]:
    """Both sides listed once per pair of blocks that may hold a row with `end` <= `at`, as `_qb` and `_rb`.

    Block i of the rows holds the ends after edge i - 1 up to edge i. A query goes to the row blocks up to the one its
    own time falls into, and no others hold a row that it sees. Blocks of queries are unions of such steps, as few
    as their number asks for, because every one of them costs a copy of all rows before it. A time that many rows
    share cannot be split by edges, so a block is dealt by hash into as many parts as its share of the quantiles
    asks for. Rows without an end are never visible and go; queries without a time stay and see nothing.
    """
    rows = rows.where(F.col(end).isNotNull())
    grid = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])

    def shape(df: DataFrame, c: str):
        n, values = df.agg(F.count(F.lit(1)), F.percentile_approx(c, grid, 20 * GRID)).first()
        return n, values or []

    def quantiles(values: list, blocks: int) -> list:
        return [values[round(k * GRID / blocks) - 1] for k in range(1, blocks)] if values else []

    def parts(edges: list, n: int, values: list, per_block: int) -> tuple[list[int], list[int]]:
        """Parts of each block, and the number of parts before it."""
        share = np.bincount(np.searchsorted(edges, values), minlength=len(edges) + 1) + 1
        own = np.maximum(1, np.ceil(share * n / GRID / per_block)).astype(int)
        return own.tolist(), (np.cumsum(own) - own).tolist()

    def block(edges: list, c: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(c))) if edges else F.lit(0)

    def part(at_block: Column, own: list[int], before: list[int], ids: Sequence[str]) -> Column:
        sizes, starts = (F.array(*map(F.lit, x)) for x in (own, before))
        return (F.get(starts, at_block) + _hashed(ids, F.get(sizes, at_block))).cast("bigint")

    (n_q, ats), (n_r, ends) = shape(queries, at), shape(rows, end)
    spread = 3 * queries.sparkSession.sparkContext.defaultParallelism
    edges = sorted(set(quantiles(ends, min(GRID, _block_count(n_r, ROW_BLOCK, spread)))))
    wide = quantiles(ats, min(GRID, _block_count(n_q, QUERY_BLOCK)))
    coarse = sorted({edges[i] for i in np.searchsorted(edges, wide).tolist() if i < len(edges)})
    own_q, before_q = parts(coarse, n_q, ats, QUERY_BLOCK)
    own_r, before_r = parts(edges, n_r, ends, ROW_BLOCK)
    upto = F.array(*[F.lit(b + o - 1) for b, o in zip(before_r, own_r)])
    # The first part of queries that can see a row block: that of the query block with the times after the edge before it.
    first = F.array(F.lit(0), *[F.lit(before_q[i]) for i in np.searchsorted(coarse, edges, side="right").tolist()])
    q = (queries.withColumn("_block", block(coarse, at)).withColumn("_qb", part(F.col("_block"), own_q, before_q, query_ids))
         .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.get(upto, block(edges, at))).cast("array<bigint>"))).drop("_block"))
    r = (rows.withColumn("_block", block(edges, end)).withColumn("_rb", part(F.col("_block"), own_r, before_r, [row_id]))
         .withColumn("_qb", F.explode(F.sequence(F.get(first, F.col("_block")), F.lit(sum(own_q) - 1)).cast("array<bigint>"))).drop("_block"))
    return q, r


def _best_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest entries per row above -inf; ties go to the smaller column."""
    if s.shape[1] > k:
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        row, col = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
    else:
        row, col = np.nonzero(s > -np.inf)
    return _first_of_rows(row, col, s[row, col], col, k)[:2]


def _first_of_rows(row: np.ndarray, col: np.ndarray, score: np.ndarray, place: np.ndarray, k: int, ties: bool = False):
    """The k best entries of each row, in order of score and then of place; with `ties`, all that score like the k-th."""
    order = np.lexsort((place, -score, row))
    row, col, score = row[order], col[order], score[order]
    starts = np.searchsorted(row, row, side="left")
    taken = np.arange(len(row)) - starts < k
    if ties and len(row):
        last = np.minimum(starts + k, np.searchsorted(row, row, side="right")) - 1
        taken |= score == score[last]
    return row[taken], col[taken], score[taken]


def _own_columns(q: pa.Table, column: str, r: pa.Table, row_id: str) -> np.ndarray:
    """For each query the place of the row with its own id, -1 without one. Ids may repeat; the first is given."""
    found = pc.index_in(q.column(column).cast(r.schema.field(row_id).type), value_set=r.column(row_id).combine_chunks())
    return pc.fill_null(found, -1).to_numpy()


def _slice_best(left: np.ndarray, right: np.ndarray, k: int, seen: np.ndarray, own: np.ndarray | None, least: float,
                ends: tuple[np.ndarray, np.ndarray] | None):
    """(row, column, rounded score) of every entry that may be among the k best of its row. A row sees its first `seen` columns.

    Columns come in strips that stay in the processor's cache. The first strip sets a bound per row, and only entries from a
    band below the bound on are looked at again; the bound rises with what is found. `ends` gathers the extreme scores on the way.
    """
    n, most = len(left), int(seen.max(initial=0))
    floor, picked = np.full(n, least - BAND), []
    for a in range(0, most, STRIP):
        b = min(a + STRIP, most)
        s = left @ right[a:b].T
        if ends is not None:
            np.minimum(ends[0], s.min(axis=1), out=ends[0])
            np.maximum(ends[1], s.max(axis=1), out=ends[1])
        if b > seen.min():
            s[np.arange(a, b)[None, :] >= seen[:, None]] = -np.inf
        if own is not None:
            mine = np.flatnonzero((own >= a) & (own < b))
            s[mine, own[mine] - a] = -np.inf
        if not a and b > k:
            np.maximum(floor, np.partition(s, b - a - k, axis=1)[:, b - a - k] - BAND, out=floor)
        row, col = np.divmod(np.flatnonzero(s >= floor[:, None]), b - a)
        score = s[row, col]
        above = score > -np.inf
        picked.append((row[above], a + col[above], score[above]))
        if sum(len(x[0]) for x in picked) > 3 * k * n + STRIP:
            picked = [_raise_floor(*(np.concatenate([x[j] for x in picked]) for j in range(3)), k, floor)]
    if not picked:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row, col, score = (np.concatenate([x[j] for x in picked]) for j in range(3))
    score = np.round(score, DIGITS) + 0.0
    enough = score >= least
    return row[enough], col[enough], score[enough]


def _raise_floor(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int, floor: np.ndarray):
    """The entries that are still at or above their row's bound, after rows with k entries raised it."""
    order = np.lexsort((-score, row))
    firsts = np.searchsorted(row[order], np.arange(len(floor) + 1))
    full = np.flatnonzero(np.diff(firsts) >= k)
    floor[full] = np.maximum(floor[full], score[order[firsts[full] + k - 1]] - BAND)
    kept = score >= floor[row]
    return row[kept], col[kept], score[kept]


def best_in_block(q: pa.Table, r: pa.Table, ids: Sequence[str], row_id: str, k: int, query_vec: str, row_vec: str, unit: bool,
                  before: tuple[str, str] | None = None, not_same: str | None = None, least: float | None = None,
                  ties: bool = False, ends: bool = False) -> pa.Table:
    """The k best rows of a block for each of its queries: ids, row_id, score, and with `ends` the block's extremes lo, hi."""
    r = r.sort_by(row_id)
    place = np.arange(len(r))
    seen = np.full(len(q), len(r))
    if before is not None and len(q) and len(r):
        # Rows in time order: what a query sees is a prefix.
        end = _numbers(r.column(before[1]), np.inf)
        place = np.argsort(end, kind="stable")
        r = r.take(pa.array(place))
        at = _numbers(q.column(before[0]), -np.inf)
        order = np.argsort(at, kind="stable")
        q, seen = q.take(pa.array(order)), np.searchsorted(end[place], at[order], side="right")
    left, right = (_matrix(x.column(c), unit) for x, c in ((q, query_vec), (r, row_vec)))
    own = None if not_same is None or not len(r) else _own_columns(q, not_same, r, row_id)
    if own is not None and pc.count_distinct(r.column(row_id)).as_py() < len(r):
        raise ValueError("row ids must be unique where a query's own row is left out")
    picked, scores = [(np.empty(0, np.int64), np.empty(0, np.int64))], [np.empty(0)]
    lo, hi = np.full(len(q), np.inf), np.full(len(q), -np.inf)
    for i in range(0, len(q) if len(r) else 0, SLICE):
        part = slice(i, i + SLICE)
        row, col, score = _slice_best(left[part], right, k, seen[part], None if own is None else own[part],
                                      -np.inf if least is None else least, (lo[part], hi[part]) if ends else None)
        row, col, score = _first_of_rows(row, col, score, place[col], k, ties)
        picked.append((i + row, col))
        scores.append(score)
    at_q, at_r = (np.concatenate([x[j] for x in picked]) for j in (0, 1))
    columns = {c: q.column(c).take(pa.array(at_q)) for c in ids}
    out = columns | {row_id: r.column(row_id).take(pa.array(at_r)), "score": pa.array(np.concatenate(scores))}
    if ends:
        out |= {c: pa.array(np.round(x[at_q], DIGITS) + 0.0) for c, x in (("lo", lo), ("hi", hi))}
    return pa.table(out)


def _merged(partial: DataFrame, ids: Sequence[str], row_id: str, k: int, ties: bool = False) -> DataFrame:
    w = Window.partitionBy(*ids).orderBy(F.desc("score"), *([] if ties else [row_id]))
    return partial.withColumn("rank", (F.rank() if ties else F.row_number()).over(w)).where(F.col("rank") <= k)


def _types(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def topk(queries: DataFrame, rows: DataFrame, k: int, query_ids: Sequence[str], row_id: str,
         query_vec: str = "qvec", row_vec: str = "vec", unit: bool = True,
         before: tuple[str, str] | None = None, by: Sequence[str] = (),
         not_same: str | None = None, ties: bool = False) -> DataFrame:
    """k best rows per query by score, ties to the smaller row id.

    `before=(query time, row end)` applies the future guard inside the block, before ranking.
    `not_same` names a query column whose value is excluded as a row id (self matches).
    With `ties` all rows that score like the k-th stay, under equal ranks.
    """
    qcols = list(dict.fromkeys([*by, *query_ids, query_vec, *([before[0]] if before else []),
                                *([not_same] if not_same else [])]))
    rcols = list(dict.fromkeys([*by, row_id, row_vec, *([before[1]] if before else [])]))
    q0, r0 = queries.select(*qcols), rows.select(*rcols)
    ids = list(dict.fromkeys([*by, *query_ids]))
    blocks = _blocks(q0, r0, query_ids, row_id, by, before)
    partial = blocks.applyInArrow(
        lambda q, r: best_in_block(q, r, ids, row_id, k, query_vec, row_vec, unit, before, not_same, ties=ties),
        f"{_types(q0, ids)}, {_types(r0, [row_id])}, score double")
    return _merged(partial, ids, row_id, k, ties)


def _blocks(q: DataFrame, r: DataFrame, query_ids: Sequence[str], row_id: str, by: Sequence[str],
            before: tuple[str, str] | None):
    if before is None:
        return _pairs_of_blocks(q, r, query_ids, row_id, by)
    return _cogrouped(*time_blocks(q, r, query_ids, row_id, *before), by)


def count_better(queries: DataFrame, rows: DataFrame, query_ids: Sequence[str], row_id: str,
                 cut_score: str, cut_id: str, query_vec: str = "qvec", row_vec: str = "vec",
                 unit: bool = True, before: tuple[str, str] | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Per query: rows that outrank (cut_score, cut_id), and rows that are eligible at all.

    The rank of a known row is `n_better + 1`; a full ranking never has to be sorted or shuffled.
    """
    qcols = list(dict.fromkeys([*by, *query_ids, query_vec, cut_score, cut_id,
                                *([before[0]] if before else [])]))
    rcols = list(dict.fromkeys([*by, row_id, row_vec, *([before[1]] if before else [])]))
    q0, r0 = queries.select(*qcols), rows.select(*rcols)
    ids = list(dict.fromkeys([*by, *query_ids]))

    def tally(q: pa.Table, r: pa.Table) -> pa.Table:
        better, seen = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        if len(q) and len(r):
            # Rows in time order: what a query sees is a prefix, and its length needs no product.
            seen[:] = len(r)
            if before is not None:
                r = r.sort_by(before[1])
                at = _numbers(q.column(before[0]), -np.inf)
                order = np.argsort(at, kind="stable")
                q, at = q.take(pa.array(order)), at[order]
                seen[:] = np.searchsorted(_numbers(r.column(before[1]), np.inf), at, side="right")
            _count_above(_matrix(q.column(query_vec), unit), _matrix(r.column(row_vec), unit), _numbers(q.column(cut_score), np.nan),
                         q.column(cut_id), r.column(row_id), seen, better)
        return pa.table({c: q.column(c) for c in ids} | {"n_better": pa.array(better), "n_seen": pa.array(seen)})

    partial = _blocks(q0, r0, query_ids, row_id, by, before).applyInArrow(
        tally, f"{_types(q0, ids)}, n_better bigint, n_seen bigint")
    return partial.groupBy(*ids).agg(F.sum("n_better").alias("n_better"),
                                     F.sum("n_seen").alias("n_seen"))


def _count_above(left: np.ndarray, right: np.ndarray, cuts: np.ndarray, own: pa.ChunkedArray, keys: pa.ChunkedArray,
                 seen: np.ndarray, better: np.ndarray) -> None:
    """Adds to `better` how many of the first `seen` rows outrank (cut, own id). Queries come in order of `seen`.

    Scores are compared unrounded; only those within a band around the bound, a query's own row and
    near ties, are rounded and compared by id.
    """
    own, keys = own.to_pandas().to_numpy(), keys.to_pandas().to_numpy()
    for i in range(0, len(left), SLICE):
        j = min(i + SLICE, len(left))
        least, most = seen[i], seen[j - 1]
        if not most:
            continue
        s = left[i:j] @ right[:most].T
        cut = cuts[i:j, None]
        s[:, least:][np.arange(least, most)[None, :] >= seen[i:j, None]] = -np.inf
        above = s > cut + BAND
        n = np.count_nonzero(above, axis=1)
        close = s >= cut - BAND
        unsure = np.flatnonzero(np.count_nonzero(close, axis=1) > n)
        row, col = np.nonzero(close[unsure] & ~above[unsure])
        row = unsure[row]
        exact = np.round(s[row, col], DIGITS) + 0.0
        ahead = (exact > cuts[i + row]) | ((exact == cuts[i + row]) & (keys[col] < own[i + row]))
        better[i:j] += n + np.bincount(row[ahead], minlength=j - i)


def score_range(queries: DataFrame, rows: DataFrame, query_ids: Sequence[str], row_id: str,
                query_vec: str = "qvec", row_vec: str = "vec", unit: bool = False) -> DataFrame:
    """Smallest and largest score per query over all rows, for min-max scaling of a top list."""
    q0, r0 = queries.select(*query_ids, query_vec), rows.select(row_id, row_vec)

    def ends(q: pa.Table, r: pa.Table) -> pa.Table:
        q = q if len(r) else q.slice(0, 0)
        left, right = _matrix(q.column(query_vec), unit), _matrix(r.column(row_vec), unit).T
        lo, hi = np.empty(len(q)), np.empty(len(q))
        for i in range(0, len(q), SLICE):
            s = left[i:i + SLICE] @ right
            lo[i:i + SLICE], hi[i:i + SLICE] = s.min(axis=1), s.max(axis=1)
        rounded = [pa.array(np.round(x, DIGITS) + 0.0) for x in (lo, hi)]
        return pa.table({c: q.column(c) for c in query_ids} | dict(zip(("lo", "hi"), rounded)))

    partial = _pairs_of_blocks(q0, r0, query_ids, row_id, ()).applyInArrow(
        ends, f"{_types(q0, query_ids)}, lo double, hi double")
    return partial.groupBy(*query_ids).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def scaled(score: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Min-max scaling; a constant column becomes all ones."""
    score, lo, hi = (F.col(c) if isinstance(c, str) else c for c in (score, lo, hi))
    return F.when(hi == lo, F.lit(1.0)).otherwise((score - lo) / (hi - lo))


def dense_retrieval(queries: DataFrame, rows: DataFrame, k: int, query_ids: Sequence[str],
                    row_id: str, query_vec: str = "qvec", row_vec: str = "vec") -> DataFrame:
    """Dot-product retrieval with min-max scores over the whole row set; k best rows per query.

    Each block sends its extremes along with its best rows, so that every pair is multiplied once.
    """
    q0, r0 = queries.select(*query_ids, query_vec), rows.select(row_id, row_vec)
    ids = list(query_ids)
    partial = _pairs_of_blocks(q0, r0, ids, row_id, ()).applyInArrow(
        lambda q, r: best_in_block(q, r, ids, row_id, k, query_vec, row_vec, False, ends=True),
        f"{_types(q0, ids)}, {_types(r0, [row_id])}, score double, lo double, hi double")
    everything = Window.partitionBy(*ids)
    wide = partial.withColumn("lo", F.min("lo").over(everything)).withColumn("hi", F.max("hi").over(everything))
    return _merged(wide, ids, row_id, k).withColumn("scaled", scaled("score", "lo", "hi")).drop("lo", "hi")
