"""Byte-level BPE by a tree: halves are encoded for themselves and joined at their seam.

A text is cut into the matches of a pattern. A match that is a token itself is that token; every other one is
encoded by its tree: leaves of a few bytes by plain merging, inner nodes by `join`, which is associative, so any tree
over the same bytes gives the same ids. `join` encodes the last tokens of the left and the first tokens of the right
anew, in a window that doubles until it no longer changes its outside: token sequences are the encoding of their bytes
exactly if every two neighbours are the encoding of their own bytes, so it is enough to look at the two pairs
where the window meets the rest.

Decoding concatenates the tokens' bytes up a tree of halves. Null and empty texts have no ids and decode to no bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAF = 8                         # bytes that are merged without a tree
SHORT = 128                      # bytes up to which plain merging looks at all pairs; beyond, it keeps a heap
REMEMBERED = 350_000             # matches whose ids a worker keeps, twice: the latest and those before; about 0.5 KB each
SLICE = 256                      # texts of one result batch, which bounds a worker's memory


#: Letters below U+0250 in which both regular expression libraries agree on letters, digits and white space.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
OUTSIDE = re.compile(f"[^\\t-\\r -~{LETTERS}]")


def plain_form(pattern: str) -> re.Pattern | None:
    """The pattern with letters and digits spelled out, for the faster library; None if it cannot be had that way."""
    for name, chars in ((r"\p{L}", LETTERS), (r"\p{N}", "0-9")):
        pattern = pattern.replace(f"?{name}+", f"?[{chars}]+").replace(name, chars)
    return re.compile(pattern) if r"\p" not in pattern and "++" not in pattern else None


class Codec:
    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.plain = plain_form(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging: the pair with the lowest rank first, the leftmost of equal ones."""
        if len(piece) > 2 * LEAF:
            return self._merged_short(piece) if len(piece) <= SHORT else self._merged_long(piece)
        ids = self.leaves.get(piece)
        if ids is None:
            if len(self.leaves) >= self.remembered:
                self.leaves.clear()
            ids = self.leaves[piece] = self._merged_short(piece)
        return ids

    def _merged_short(self, piece: bytes) -> list[int]:
        """By the positions where parts begin, and the rank of every part joined with the next."""
        rank, none = self.ranks.get, 1 << 62
        n = len(piece)
        cuts = list(range(n + 1))
        joins = [rank(piece[i:i + 2], none) for i in range(n - 1)]
        while joins:
            low = min(joins)
            if low == none:
                break
            i = joins.index(low)
            del cuts[i + 1], joins[i]
            if i < len(joins):
                joins[i] = rank(piece[cuts[i]:cuts[i + 2]], none)
            if i:
                joins[i - 1] = rank(piece[cuts[i - 1]:cuts[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same by a heap of pairs over linked positions."""
        n = len(piece)
        end = list(range(1, n + 1))              # end of the part that starts here; 0 if none does
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            middle = end[i]
            if middle < n and (r := self.ranks.get(piece[i:end[middle]])) is not None:
                heapq.heappush(heap, (r, i, end[middle]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbours are the encoding of their bytes."""
        seen = self.pairs.get((a, b))
        if seen is None:
            seen = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) >= self.remembered:
                self.pairs.clear()
            self.pairs[a, b] = seen
        return seen

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i:] + right[:j])))
            whole_left, whole_right = i == len(left), j == len(right)
            good_left = whole_left or self.stable(left[-i - 1], window[0])
            good_right = whole_right or self.stable(window[-1], right[j])
            if good_left and good_right:
                return left[:len(left) - i] + window + right[j:]
            i, j = (i if good_left else 2 * i), (j if good_right else 2 * j)

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.merged(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode(self, text: str) -> list[int]:
        simple = self.plain is not None and not OUTSIDE.search(text)
        matches = (self.plain if simple else self.pattern).findall(text)
        parts = list(map(self.known.get, matches))
        if None in parts:
            for i, ids in enumerate(parts):
                if ids is None:
                    parts[i] = self._learn(matches[i])
        return list(chain.from_iterable(parts))

    def _learn(self, match: str) -> tuple[int, ...]:
        ids = self.known.get(match) or self.older.get(match)
        if ids is None:
            piece = match.encode("utf-8")
            own = self.ranks.get(piece)
            ids = tuple(self.tree(piece)) if own is None else (own,)
        if len(match) <= 64:
            if len(self.known) >= self.remembered:
                self.older, self.known = self.known, {}
            self.known[match] = ids
        return ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=3)
def codec(path: str, pattern: str, remembered: int = REMEMBERED) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern, remembered)


def _sliced(docs: DataFrame, made: dict[str, T.DataType], convert) -> DataFrame:
    """`docs` with the columns `made`; `convert` makes their arrays for a slice of a batch."""
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, kind) for n, kind in made.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, *convert(part)], names=[*batch.schema.names, *made])

    return docs.mapInArrow(run, schema)


def _encoded(own: Codec, texts: pa.Array) -> pa.ListArray:
    flat, ends = array("i"), [0]
    for t in texts:
        flat.extend(own.encode(t.as_py() or ""))
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else [], pa.int32()))


def _decoded(own: Codec, ids: pa.Array) -> pa.Array:
    return pa.array([own.decode(x.values.to_pylist() if x.is_valid else []) for x in ids], pa.binary())


def encode(docs: DataFrame, text: str, path: str, pattern: str, name: str = "ids", remembered: int = REMEMBERED) -> DataFrame:
    """`docs` with a column of token ids; `name` must not be one of its columns. `remembered` weighs a worker's
    memory against its time; workers keep what they remember between tasks."""
    return _sliced(docs, {name: T.ArrayType(T.IntegerType())}, lambda part: [_encoded(codec(path, pattern, remembered), part.column(text))])


def decode(docs: DataFrame, ids: str, path: str, pattern: str, name: str = "decoded") -> DataFrame:
    """`docs` with a column of the bytes that its token ids stand for; null ids stand for none."""
    return _sliced(docs, {name: T.BinaryType()}, lambda part: [_decoded(codec(path, pattern, 0), part.column(ids))])


def round_trip(docs: DataFrame, text: str, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded",
               remembered: int = REMEMBERED) -> DataFrame:
    """Token ids and the bytes that they decode to, in one pass: a task has one Python worker and one codec, not two of each."""
    def both(part: pa.RecordBatch) -> list[pa.Array]:
        own = codec(path, pattern, remembered)
        coded = _encoded(own, part.column(text))
        return [coded, _decoded(own, coded)]

    return _sliced(docs, {ids: T.ArrayType(T.IntegerType()), decoded: T.BinaryType()}, both)
