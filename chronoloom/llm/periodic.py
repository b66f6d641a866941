"""Periodic runs of words: stretches that repeat with a smallest period q at least four times.

The sparse dynamic program over diagonals runs online: every word position looks at its earlier occurrences, each raises the
match length of the diagonal with that lag, and a diagonal that is not raised ends and emits its run at once if it is long
enough. To be exact in O(n log n) on any text, words in front of "the the the" included, an occurrence of a word counts
only with its neighbourhood: for lags from D to 2D - 1 (D = 1, 2, 4, ...) a position stands for the 2D words that start
there, and only its nearest earlier occurrence is looked at. Nothing is lost:

* A run of period q has at least 3q >= 2D matching words on its diagonal, so its neighbourhoods match too.
* If a nearer occurrence at r < q exists, the words between have the periods q and r over more than q + r words,
  so also their common divisor, and q was not the run's smallest period. The other way round, a diagonal of nearest
  occurrences has no smaller period, and it ends where its words stop to match.

Neighbourhoods are named by doubling, and those that occur once in their document are left out, so prose is done after a few
levels. Null and empty texts have no words, no runs and an empty collapsed text. Every row is treated for itself, whatever rows
equal it; a task holds a slice of texts. Extra columns stay, but one with the name of a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A slice of texts is closed when it has so many bytes.
SLICE_BYTES = 2_000_000
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def earlier_occurrences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and the lags to look at there, by position. Words have equal numbers if they are equal and in one document."""
    n = len(words)
    places, lags = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    name = np.full(n, -1, dtype=np.int64)        # of the neighbourhood that starts here, if it occurs more than once
    at, size, code = np.arange(n), 1, words.astype(np.int64)
    while len(at):
        order = np.argsort(code, kind="stable")
        same = np.diff(code[order]) == 0
        later, lag = at[order[1:][same]], (at[order[1:]] - at[order[:-1]])[same]
        fits = (lag >= size // 2) & (lag < size)
        places.append(later[fits])
        lags.append(lag[fits])
        number = np.empty(len(at), dtype=np.int64)
        number[order] = np.concatenate(([0], np.cumsum(~same)))
        repeated = np.zeros(len(at), dtype=bool)
        repeated[order[1:][same]] = repeated[order[:-1][same]] = True
        alive = at[repeated]
        name[alive] = number[repeated]
        at = alive[alive + size < n]
        at = at[name[at + size] >= 0]
        code = name[at] * (n + 1) + name[at + size]
        name[alive] = -1
        size *= 2
    flat, lag = np.concatenate(places), np.concatenate(lags)
    order = np.lexsort((lag, flat))
    return flat[order], lag[order]


def diagonal_runs(occurrences: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period), as soon as their diagonals end."""
    active: dict[int, int] = {}                  # lag: neighbourhoods matched in a row, up to the position before
    now = -1
    raised: dict[int, int] = {}

    def ended(at: int, lags: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        for lag in lags:
            around = 2 << (lag.bit_length() - 1)
            length = active[lag] - 1 + around + lag
            if length >= max(6, 4 * lag):
                yield at - active[lag] - lag, length, lag

    for at, lag in occurrences:
        if at != now:
            yield from ended(now, active.keys() - raised.keys())
            active, raised = raised, {}
            if at != now + 1:
                yield from ended(now + 1, active)
                active = {}
            now = at
        raised[lag] = active.get(lag, 0) + 1
    yield from ended(now, active.keys() - raised.keys())
    active = raised
    yield from ended(now + 1, active)


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    first, size, held = 0, 0, []
    for i, t in enumerate(batch.column(text)):
        raw = (t.as_py() or "").encode()
        held.append(raw)
        size += len(raw)
        if size >= SLICE_BYTES or i + 1 == batch.num_rows:
            yield batch.slice(first, i + 1 - first), held
            first, size, held = i + 1, 0, []


def _runs_of(texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """Numbers of words, runs by start and period, and texts without the words that repeat a run's first period."""
    split = [t.split() for t in texts]           # bytes are split at the six ASCII blanks only
    counts = [len(s) for s in split]
    ends = np.cumsum(counts)
    starts = ends - counts
    words = [w for s in split for w in s]
    codes = pa.array(words, pa.binary()).dictionary_encode()
    document = np.repeat(np.arange(len(texts)), counts)
    places, lags = earlier_occurrences(document * max(1, len(codes.dictionary)) + codes.indices.to_numpy())
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in diagonal_runs(zip(places.tolist(), lags.tolist())):
        d = int(document[start])
        runs[d].append((start - int(starts[d]), length, period))
        change[start + period] += 1
        change[start + length] -= 1
    for own in runs:
        own.sort(key=lambda r: (r[0], r[2]))
    gone = np.cumsum(change[:-1]) > 0
    kept = [b" ".join(s if not own else [w for w, g in zip(s, gone[a:b]) if not g])
            for s, own, a, b in zip(split, runs, starts.tolist(), ends.tolist())]
    return counts, runs, kept


def find_runs(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with n_words, runs (array of start, length, period, in words) and collapsed (the words that no run repeats,
    joined by one space)."""
    docs = docs.drop(*(c for c in ("n_words", "runs", "collapsed") if c != text))
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *added])
    run_type = pa.struct([(f.name, pa.int64()) for f in RUN.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch, text):
                counts, runs, kept = _runs_of(texts)
                flat = np.array([r for own in runs for r in own], dtype=np.int64).reshape(-1, 3)
                ends = np.concatenate(([0], np.cumsum([len(own) for own in runs])))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(flat[:, i]) for i in range(3)], fields=list(run_type)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(counts, pa.int64()), listed, pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, schema)
