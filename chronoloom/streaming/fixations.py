"""Fixation detection on a stream of gaze samples; the walk is the one of the batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.stateful import FIXATION, FixationWalk

WALK = "start double, last double, n bigint, sx double, sy double, out_t double, out_x double, out_y double, seen double"
SAMPLE = "t double, k bigint, x double, y double"
STORE = "spark.sql.streaming.stateStore.providerClass"


def use_row_state(spark: SparkSession) -> None:
    """List state and timers need the state store that keeps single rows; streams that already run keep theirs."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FixationProcessor(StatefulProcessor):
    """State of a clip: the open fixation, the newest time seen, and a list of samples that may still be overtaken.

    A sample is walked at the end of a micro-batch if a later one is `slack` seconds ahead of it, so between micro-batches the
    list holds no more than `slack` seconds of a clip (everything, if `slack` is None). A row without a time, or `idle`
    seconds of processing time without rows, walks what waits, closes the open fixation and frees the state.
    """

    def __init__(self, by: str, key: str, rule: tuple[float, float, float, float], slack: float | None, idle: float | None):
        self.by, self.key, self.rule, self.slack, self.idle = by, key, rule, slack, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.walk = handle.getValueState("walk", WALK)
        self.newest = handle.getValueState("newest", "t double")
        self.waiting = handle.getListState("waiting", SAMPLE)

    def _walked(self, clip: tuple, walker: FixationWalk, upto: float | None) -> list[tuple]:
        """Walks the waiting samples up to a time, in order; later ones go on waiting."""
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready = len(waiting) if upto is None else sum(t <= upto for t, *_ in waiting)
        rest = waiting[ready:]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        rows = []
        for t, _, x, y in waiting[:ready]:
            if walker.seen is not None and t < walker.seen:
                rows.append((*clip, "late", t, t, x, y, 0.0, 1))
            else:
                rows.extend((*clip, "fixation", *r) for r in walker.step(t, x, y))
        return rows

    def _finished(self, clip: tuple, walker: FixationWalk) -> list[tuple]:
        rows = self._walked(clip, walker, None) + [(*clip, "fixation", *r) for r in walker.finish()]
        for state in (self.walk, self.newest, self.waiting):
            state.clear()
        return rows

    def _walker(self) -> FixationWalk:
        return FixationWalk(*self.rule, tuple(self.walk.get()) if self.walk.exists() else None)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        columns = [self.by, "kind", *(c.split()[0] for c in FIXATION.split(", "))]
        return pd.DataFrame(rows, columns=columns) if rows else pd.DataFrame()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clip, walker = tuple(key), self._walker()
        newest = self.newest.get()[0] if self.newest.exists() else float("-inf")
        ended = False
        for frame in rows:                           # a piece of the clip's rows at a time, on to the store
            timed = frame[frame["t"].notna()]
            ended |= len(timed) < len(frame)
            if len(timed):
                self.waiting.appendList(list(zip(*(timed[c].tolist() for c in ("t", self.key, "x", "y")), strict=True)))
                newest = max(newest, float(timed["t"].max()))
        out = [] if self.slack is None else self._walked(clip, walker, newest - self.slack)
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        if ended:
            out.extend(self._finished(clip, walker))
        else:
            self.newest.update((newest,))
            if walker.start is not None:
                self.walk.update(walker.state())
            if self.idle is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._finished(tuple(key), self._walker()))

    def close(self) -> None:
        pass


def fixation_stream(samples: DataFrame, by: str = "clip", key: str = "sid", radius: float = 0.05, min_seconds: float = 0.5,
                    gap: float = 0.2, dropout: float = 0.4, slack: float | None = 0.0, idle: float | None = None) -> DataFrame:
    """Closed fixations per clip (kind `fixation`). samples: by, key, t (seconds), x, y.

    Every clip has its own clock, kept in its state: clips may start at any time, and no row is filtered by a common
    watermark. Across micro-batches samples may be up to `slack` seconds out of order; one that is older than what was
    already walked is handed back as kind `late`. With `slack` None samples may come in any order and are walked when their clip ends. A clip ends with a
    row without `t`, or, if `idle` is given, after so many seconds without rows; `idle` needs a query that keeps running.
    """
    use_row_state(samples.sparkSession)
    kind = samples.schema[by].dataType.simpleString()
    rows = samples.selectExpr(f"`{by}`", f"CAST(`{key}` AS bigint) AS `{key}`", "CAST(t AS double) AS t", "CAST(x AS double) AS x", "CAST(y AS double) AS y")
    processor = FixationProcessor(by, key, (radius, min_seconds, gap, dropout), slack, idle)
    return rows.groupBy(by).transformWithStateInPandas(
        processor, f"{by} {kind}, kind string, {FIXATION}", "Append", "None" if idle is None else "ProcessingTime")
