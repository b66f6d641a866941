"""Walks over ordered streams: fixations, episode de-duplication, straightness, scene filter.

Fixations are walked sample by sample: rows are hashed by stream and sorted inside the partition, the walk reads Arrow
batches in order and keeps only its own small state, and streams are first split where the walk provably restarts.
Walks that restart at every row they keep are paths in a successor graph (`successors`) and need no such place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordered import island_ids, lagged, row_numbers, running
from .successors import BLOCK, by_length, find_successors, reached_from_first, walk_short
from .vectors import _matrix, dot


class FixationWalk:
    """Dispersion-based fixation detection, one sample at a time; shared by batch and stream.

    State: start of the fixation, sums over its inliers, its last inlier, and the samples of a running
    excursion that the detector may have to go back to.
    """

    FIELDS = ("start", "last", "n", "sx", "sy", "out_t", "out_x", "out_y", "seen")

    def __init__(self, radius: float = 0.05, min_seconds: float = 0.5, gap: float = 0.2, dropout: float = 0.4,
                 state: tuple | None = None):
        self.radius, self.min_seconds, self.gap, self.dropout = radius, min_seconds, gap, dropout
        for name, value in zip(self.FIELDS, state or (None,) * len(self.FIELDS)):
            setattr(self, name, value)

    def state(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    def _open(self, t: float, x: float, y: float) -> None:
        self.start, self.last, self.n, self.sx, self.sy, self.out_t = t, t, 1, x, y, None

    def _close(self) -> list[tuple]:
        length = self.last - self.start
        if length < self.min_seconds:
            return []
        return [(self.start, self.last, self.sx / self.n, self.sy / self.n, length, self.n)]

    def _inside(self, x: float, y: float) -> bool:
        return math.hypot(x - self.sx / self.n, y - self.sy / self.n) <= self.radius

    def step(self, t: float, x: float, y: float) -> list[tuple]:
        if self.start is None:
            self._open(t, x, y)
            self.seen = t
            return []
        hole, self.seen = t - self.seen, t
        if hole > self.dropout:
            done = self._close()
            self._open(t, x, y)
            return done
        if self._inside(x, y):
            self.last, self.n, self.sx, self.sy, self.out_t = t, self.n + 1, self.sx + x, self.sy + y, None
            return []
        if self.out_t is None:
            self.out_t, self.out_x, self.out_y = t, x, y
        if t - self.out_t <= self.gap:
            return []
        done = self._close()
        self._open(self.out_t, self.out_x, self.out_y)
        if self._inside(x, y):
            self.last, self.n, self.sx, self.sy = t, 2, self.sx + x, self.sy + y
        else:
            self.out_t, self.out_x, self.out_y = t, x, y
        return done

    def finish(self) -> list[tuple]:
        return [] if self.start is None else self._close()


FIXATION = "start double, end double, cx double, cy double, duration double, n_samples bigint"


def detect_fixations(samples: DataFrame, by: str = "clip", key: str = "sid", radius: float | Sequence[float] = 0.05,
                     min_seconds: float = 0.5, gap: float = 0.2, dropout: float = 0.4) -> DataFrame:
    """Fixations per clip. samples: by, key, t, x, y. Several radii are walked in one pass, named in a column `param`.

    A hole longer than `dropout` always ends a fixation and resets the walk, so clips are cut there first.
    """
    parts = island_ids(samples.select(by, key, "t", "x", "y"), [by], ["t", key], {"_t": F.col("t")},
                       F.col("_t").isNull() | (F.col("t") - F.col("_t") > dropout), "part").drop("_t")
    radii = list(radius) if isinstance(radius, Sequence) else [radius]
    kind = samples.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, param double, {FIXATION}"
    types = {"n_samples": pa.int64()}
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, walkers, of_key = None, [], None

        def table(rows: list[tuple], of_key: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, of_key if n == by else types.get(n, pa.float64())) for n, c in zip(names, columns)], names=names)

        for b in batches:
            rows, of_key = [], b.schema.field(by).type
            for clip, part, t, x, y in zip(*(b.column(c).to_pylist() for c in (by, "part", "t", "x", "y"))):
                if (clip, part) != current:
                    rows.extend((current[0], w.radius, *r) for w in walkers for r in w.finish())
                    current, walkers = (clip, part), [FixationWalk(r, min_seconds, gap, dropout) for r in radii]
                for w in walkers:
                    for r in w.step(t, x, y):
                        rows.append((clip, w.radius, *r))
            yield table(rows, of_key)
        if walkers:
            yield table([(current[0], w.radius, *r) for w in walkers for r in w.finish()], of_key)

    found = parts.repartition(by, "part").sortWithinPartitions(by, "part", "t", key).mapInArrow(run, schema)
    return found if isinstance(radius, Sequence) else found.drop("param")


def consecutive_dedupe(episodes: DataFrame, by: str, least: float, block: int = BLOCK) -> DataFrame:
    """(by, episode_id) of kept episodes: those that are not too similar to the last kept one. episodes: by, episode_id, start, vec.

    The next kept episode is looked for from every episode, so the cost is the sum of the distances to it; stretches of equal
    vectors count once. A vector of zeros is similar to nothing.
    """
    order = ["start", "episode_id"]
    rows = episodes.select(by, *order, F.col("vec").cast("array<double>").alias("vec"))
    if least < 1 - 1e-9:
        # What equals the episode before it is kept only if that one is no neighbour of itself, a null vector.
        rows = lagged(rows, [by], order, {"_before": F.col("vec")})
        rows = rows.where(~F.col("vec").eqNullSafe(F.col("_before")) | (dot("vec", "vec") == 0)).drop("_before")
    short, long = by_length(cut(rows), [by], block)

    def unlike(a: pa.Table, b: pa.Table) -> np.ndarray:
        left, right = _matrix(a.column("vec"), False), _matrix(b.column("vec"), False)
        size = np.sqrt(np.outer((left * left).sum(axis=1), (right * right).sum(axis=1)))
        cosine = np.divide(left @ right.T, size, out=np.full(size.shape, -np.inf), where=size > 0)
        return ~(cosine >= least)

    kept = walk_short(short, [by], order, unlike).where("kept").select(by, "episode_id")
    if long is None:
        return kept
    rows = cut(row_numbers(long, [by], order))
    reached = reached_from_first(find_successors(rows.select(by, "rn", "vec"), [by], unlike, block), [by], block)
    return kept.unionByName(rows.select(by, "rn", "episode_id").join(reached, [by, "rn"]).drop("rn"))


#: Short episodes pass; longer ones must not be black and must stay similar.
SHORT_SECONDS = 1.5
LEAST_SIMILARITY = 0.9


def scene_reason(duration: Column, brightness: Column, similarity: Column, black: float) -> Column:
    """Why an episode is kept or dropped, from measured brightness and least frame similarity."""
    return (F.when(duration < SHORT_SECONDS, "short").when(brightness < black, "black")
            .when(similarity < LEAST_SIMILARITY, "scene change").otherwise("steady"))


def scene_filter(episodes: DataFrame, black: float) -> DataFrame:
    reason = scene_reason(F.col("duration"), F.col("brightness"), F.col("similarity"), black)
    return episodes.withColumn("reason", reason).withColumn("kept", F.col("reason").isin("short", "steady"))


def path_straightness(samples: DataFrame, by: Sequence[str], key: str, bin_seconds: float = 0.3, block: int = BLOCK) -> DataFrame:
    """Net displacement over path length per fixation; 0 with fewer than three bins. samples: by, key, t, x, y.

    A bin opens with the first sample that is more than `bin_seconds` behind the opening one of the bin before it. The path
    runs over the bins' mean points.
    """
    by, order = list(by), ["t", key]
    short, long = by_length(cut(samples.select(*by, key, "t", "x", "y")), by, block)

    def later(a: pa.Table, b: pa.Table) -> np.ndarray:
        return b.column("t").to_numpy()[None, :] - a.column("t").to_numpy()[:, None] > bin_seconds

    def centres(binned: DataFrame) -> DataFrame:
        return binned.groupBy(*by, "bin").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))

    # A short fixation has few bins, so a plain window meets a bounded group.
    binned = walk_short(short, by, order, later).withColumnRenamed("step", "bin")
    behind = Window.partitionBy(*by).orderBy("bin")
    steps = centres(binned).withColumns({"px": F.lag("cx").over(behind), "py": F.lag("cy").over(behind)})
    if long is not None:
        rows = cut(row_numbers(long, by, order))
        opened = reached_from_first(find_successors(rows.select(*by, "rn", "t"), by, later, block), by, block)
        marked = rows.join(opened.withColumn("_opens", F.lit(1)), [*by, "rn"], "left").fillna(0, ["_opens"])
        binned = running(marked, by, ["rn"], {"bin": ("sum", F.col("_opens"))})
        steps = steps.unionByName(lagged(centres(binned), by, ["bin"], {"px": F.col("cx"), "py": F.col("cy")}).select(steps.columns))

    def distance(x0, y0, x1, y1) -> Column:
        return F.hypot(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0))

    point = F.struct("cx", "cy")
    paths = steps.groupBy(*by).agg(
        F.sum(distance("px", "py", "cx", "cy")).alias("path"), F.count(F.lit(1)).alias("n_bins"),
        F.min_by(point, "bin").alias("first"), F.max_by(point, "bin").alias("last"))
    net = distance("first.cx", "first.cy", "last.cx", "last.cy")
    straight = F.when((F.col("n_bins") < 3) | (F.col("path") == 0), F.lit(0.0)).otherwise(net / F.col("path"))
    return paths.select(*by, straight.alias("straightness"), "n_bins")
