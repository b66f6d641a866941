"""Greedy walks over ordered rows as paths in a successor graph, so that one long stream spreads over all tasks.

A walk that restarts at every row it keeps (keep an episode unless it is like the last kept one; open a time bin when the
last one is full) is given by the next row that each row would keep if it were kept itself. Rows are numbered per
stream and cut into blocks. `find_successors` looks for that next row in the own block, then in the 1, 2, 4, ... blocks
after it, always with all rows of a block at once. `reached_from_first` finds which rows the walk from the first row passes:
inside a block every row's way out is found at once, the ways out of rows that are entered from another block are squared
until the walk's end is reached, and the blocks on the way are walked again from where they were entered.

Streams of up to one block (`by_length`) need none of this: `walk_short` walks many of them in one call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_side
from .vectors import SLICE, _types

BLOCK = 2048
SHORT_SLICE = 128     # rows matched at once where streams are short
KEY_BYTES = 64        # a stream's key as a broadcast row, about

#: (rows, later rows) -> matrix of bool: whether the later row would be the next one kept.
Match = Callable[[pa.Table, pa.Table], np.ndarray]


def _block(n: int) -> Column:
    return F.floor((F.col("rn") - 1) / F.lit(n)).cast("bigint")


def _first_matches(a: pa.Table, b: pa.Table, match: Match) -> pa.Array:
    """For each row of `a` the number of the first row of `b` behind it that matches, or null."""
    b = b.sort_by("rn")
    numbers, own = b.column("rn").to_numpy(), a.column("rn").to_numpy()
    out = np.zeros(len(a), np.int64)
    if len(b):
        for i in range(0, len(a), SLICE):
            hits = match(a.slice(i, SLICE), b) & (numbers[None, :] > own[i:i + SLICE, None])
            out[i:i + SLICE] = np.where(hits.any(axis=1), numbers[hits.argmax(axis=1)], 0)
    return pa.array(out, mask=out == 0)


def find_successors(rows: DataFrame, by: Sequence[str], match: Match, block: int = BLOCK) -> DataFrame:
    """(by, rn, next) for all rows; next is null where no later row matches. rows: by, rn from 1, and what `match` reads.

    `rows` is read once per round, and the rounds are as many as the logarithm of a stream's blocks: a round looks at
    twice as many blocks as the one before, for rows that are still open only.
    """
    by, schema = list(by), f"{_types(rows, by)}, rn bigint, next bigint"
    placed = rows.withColumn("_b", _block(block))

    def within(part: pa.Table) -> pa.Table:
        return pa.table({c: part.column(c) for c in [*by, "rn"]} | {"next": _first_matches(part, part, match)})

    def across(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table({c: a.column(c) for c in [*by, "rn"]} | {"next": _first_matches(a, b, match)})

    found = cut(placed.groupBy(*by, "_b").applyInArrow(within, schema))
    last = placed.groupBy(*by).agg(F.max("_b").alias("_last"))
    later = found.where("next IS NULL").select(*by, "rn")
    is_open = cut(placed.join(later, [*by, "rn"], "left_semi").join(last, by).where("_b < _last"))
    done, ahead, width = [found.where("next IS NOT NULL")], 1, 1
    while not is_open.isEmpty():
        target = F.sequence(F.col("_b") + ahead, F.least(F.col("_b") + (ahead + width - 1), F.col("_last")))
        asks = is_open.withColumn("_b", F.explode(target)).drop("_last")
        hits = (asks.groupBy(*by, "_b").cogroup(placed.groupBy(*by, "_b")).applyInArrow(across, schema)
                .groupBy(*by, "rn").agg(F.min("next").alias("next")))
        hits = cut(hits.where("next IS NOT NULL"))
        done.append(hits)
        ahead, width = ahead + width, 2 * width
        is_open = cut(is_open.join(hits.select(*by, "rn"), [*by, "rn"], "left_anti").where(F.col("_b") + ahead <= F.col("_last")))
    known = done[0]
    for part in done[1:]:
        known = known.unionByName(part)
    return found.select(*by, "rn").join(known, [*by, "rn"], "left")


def _ways_out(numbers: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Where each row's walk first leaves the block: a number beyond it, or 0 at the walk's end. Numbers are sorted."""
    last = numbers[-1]
    out = following.copy()
    while (inside := (out > 0) & (out <= last)).any():
        out[inside] = out[np.searchsorted(numbers, out[inside])]
    return out


def reached_from_first(successors: DataFrame, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(by, rn) of the rows on each stream's walk from its first row. successors: by, rn, next."""
    by = list(by)
    schema = f"{_types(successors, by)}, rn bigint"
    placed = cut(successors.withColumn("_b", _block(block)))

    def sorted_block(part: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        part = part.sort_by("rn")
        return part, part.column("rn").to_numpy(), part.column("next").fill_null(0).to_numpy()

    def leave(part: pa.Table) -> pa.Table:
        part, numbers, following = sorted_block(part)
        out = _ways_out(numbers, following)
        return pa.table({c: part.column(c) for c in [*by, "rn"]} | {"to": pa.array(out, mask=out == 0)})

    ways = cut(placed.groupBy(*by, "_b").applyInArrow(leave, f"{schema}, to bigint"))
    first = ways.where("rn = 1").select(*by, "rn")
    entered = ways.where("to IS NOT NULL").select(*by, F.col("to").alias("rn")).distinct()
    jumps = cut(ways.where("to IS NOT NULL").join(entered.unionByName(first).distinct(), [*by, "rn"], "left_semi"))
    reached = cut(first)
    while True:
        more = reached.join(jumps, [*by, "rn"]).select(*by, F.col("to").alias("rn")).join(reached, [*by, "rn"], "left_anti")
        more = cut(more)
        if more.isEmpty():
            break
        reached = cut(reached.unionByName(more))
        then = jumps.select(*by, F.col("rn").alias("to"), F.col("to").alias("_further"))
        jumps = cut(jumps.join(then, [*by, "to"]).select(*by, "rn", F.col("_further").alias("to")))

    def walk(part: pa.Table) -> pa.Table:
        part, numbers, following = sorted_block(part)
        at = part.column("_entry").to_numpy()[0]
        kept = []
        while 0 < at <= numbers[-1]:
            i = int(np.searchsorted(numbers, at))
            kept.append(i)
            at = following[i]
        return part.select([*by, "rn"]).take(pa.array(kept, pa.int64()))

    entries = reached.withColumn("_b", _block(block)).withColumnRenamed("rn", "_entry")
    return placed.join(entries, [*by, "_b"]).groupBy(*by, "_b").applyInArrow(walk, schema)


def by_length(rows: DataFrame, by: Sequence[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """Streams of up to `block` rows, and the longer ones, or None if there are none. `rows` is read more than once."""
    by = list(by)
    long = cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(*by))
    if long.isEmpty():
        return rows, None
    long = small_side(long, KEY_BYTES)
    return rows.join(long, by, "left_anti"), rows.join(long, by, "left_semi")


def _stream_numbers(part: pa.Table, by: Sequence[str]) -> np.ndarray:
    """0 for the rows of the first stream, 1 for those of the next, and so on. Rows are sorted by stream."""
    opens = np.zeros(len(part), bool)
    for c in by:
        values = part.column(c)
        here, before = values.slice(1), values.slice(0, len(part) - 1)
        differs = pc.not_equal(here, before)
        if pa.types.is_floating(values.type):
            differs = pc.and_(differs, pc.invert(pc.and_(pc.is_nan(here), pc.is_nan(before))))
        opens[1:] |= differs.to_numpy()
    return np.cumsum(opens)


def _walked(part: pa.Table, by: Sequence[str], match: Match) -> pa.Table:
    """Whole streams, sorted, with `step` and `kept` (see `walk_short`)."""
    part = part.combine_chunks()
    stream, at = _stream_numbers(part, by), np.arange(len(part))
    ends = np.searchsorted(stream, stream, side="right")
    following = np.full(len(part), -1)
    for i in range(0, len(part), SHORT_SLICE):
        own, ahead = at[i:i + SHORT_SLICE, None], at[None, i:ends[min(i + SHORT_SLICE, len(part)) - 1]]
        hits = match(part.slice(i, len(own)), part.slice(i, ahead.size)) & (ahead > own) & (ahead < ends[own])
        following[i:i + SHORT_SLICE] = np.where(hits.any(axis=1), i + hits.argmax(axis=1), -1)
    first = np.searchsorted(stream, np.arange(stream[-1] + 1))
    kept, now = np.zeros(len(part), bool), first
    while now.size:
        kept[now] = True
        now = following[now]
        now = now[now >= 0]
    so_far = np.cumsum(kept)
    return part.append_column("step", pa.array(so_far - so_far[first][stream] + 1)).append_column("kept", pa.array(kept))


def walk_short(rows: DataFrame, by: Sequence[str], order: Sequence[str], match: Match) -> DataFrame:
    """`rows` with `kept`: whether the walk from its stream's first row passes a row, and `step`: how many rows it has kept up to there.

    Streams lie whole and sorted in a partition. A task holds one batch and the stream that goes on behind it, so this is for
    streams of bounded length (`by_length`); `match` is called once for all short streams of a slice. Keys must not be null.
    """
    by, schema = list(by), f"{_types(rows, rows.columns)}, step bigint, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if len(held):
                stream = _stream_numbers(held, by)
                whole = int(np.searchsorted(stream, stream[-1]))
                if whole:
                    yield from _walked(held.slice(0, whole), by, match).to_batches()
                held = held.slice(whole)
        if held is not None and len(held):
            yield from _walked(held, by, match).to_batches()

    known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by))
    return known.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
