"""Alignment of the tokens of two public tokenizers over the same bytes.

A text is encoded by A (byte-level BPE, with a space before it) and by B (pieces, which adds that space). Tokens of both
cover the same bytes, so they are merged by their ends in lockstep: one NumPy state holds a pair of pointers for every
document of a slice, each step links the two tokens under them, cuts where both end, and moves on whichever ends first;
finished documents are compacted away. So that one long document does not keep the state alone, documents enter it in
lanes of `LANE` tokens of A; the next lane starts at the same byte with the token of B that covers it.

Links are counted in how many documents an id pair occurs, over the whole corpus: every row is a document of its own,
repeated rows included. Alignments are written once below the shared folder and read for the counts and for the scores.

Texts that are null or empty, and texts whose tokens do not give back their bytes (B has no piece for the sign U+2581 itself),
have no tokens. Special tokens' strings inside texts are plain text. Extra columns stay, but one with the name of a result gives
way to it.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import cut, scratch
from .bpe import OUTSIDE
from .hot import join_counted

LANE = 64                        # tokens of A that one lane of the state goes through
SLICE_BYTES = 1_000_000          # a slice of texts is closed when it has so many bytes
PAIR = 1 << 32                   # an id pair is a * PAIR + b
REMEMBERED = 100_000             # words whose pieces a worker keeps; about 0.3 KB each
ROW = "_alignment_row"           # numbers the written rows; no column of the documents may have this name
WORD = re.compile(" +[^ ]*")     # a word with the spaces before it

#: Results of `align` besides the columns of the documents.
ALIGNED = T.StructType([
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()), T.StructField("groups", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])


def byte_letters() -> dict[str, int]:
    """Byte-level BPE writes a byte as a letter: printable Latin-1 as itself, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(moved)}


class Sides:
    """Both tokenizers and the bytes of their tokens; one per Python worker."""

    def __init__(self, path_a: str, path_b: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark has a worker on every core already
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.size_a, self.size_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        # Without a piece that goes on over the start of a word, words are encoded each for itself.
        self.by_word = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        # A word without signs is a space at a text's end, which B would not encode alone.
        self.pieces: dict[str, bytes | None] = {" ": array("i", [self.b.piece_to_id("▁")]).tobytes()}
        # An id with the comma, bar or semicolon that follows it.
        self.shown = np.array([f"{i}{c}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for c in ",|;"], dtype=object)
        self.fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                known = {base64.b64decode(x): int(i) for x, i in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def pieces_of(self, words: list[str]) -> None:
        """Remembers B's ids of new words, as the bytes of 32-bit numbers; None where they do not give back the word's bytes."""
        for w, ids in zip(words, self.b.encode([w[1:] for w in words], num_threads=1)):
            same = b"".join(map(self.bytes_b.__getitem__, ids)) == w.encode()
            self.pieces[w] = array("i", ids).tobytes() if same else None

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides as the bytes of 32-bit numbers; none for a text whose tokens do not give back its bytes.

        Where all signs are letters, digits and blanks to all libraries, A is encoded by the ranks of the same vocabulary, whose
        tokens always give back the bytes, and B word by word; all other texts are encoded whole.
        """
        words = [None if self.fast is None or not self.by_word or OUTSIDE.search(t) else WORD.findall(" " + t) for t in texts]
        if len(self.pieces) > REMEMBERED:
            self.pieces = {" ": self.pieces[" "]}
        new = list(set().union(*(w for w in words if w)) - self.pieces.keys())
        self.pieces_of(new)
        out = []
        for t, own in zip(texts, words):
            if not t:
                out.append((b"", b""))
            elif own is not None:
                parts = list(map(self.pieces.__getitem__, own))
                out.append((b"", b"") if None in parts else (self.fast.encode_to_numpy(" " + t).tobytes(), b"".join(parts)))
            else:
                a, b = self.a.encode(" " + t, add_special_tokens=False).ids, self.b.encode(t)
                same = b" " + t.encode() == b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b))
                out.append((array("i", a).tobytes(), array("i", b).tobytes()) if same else (b"", b""))
        for w in new:
            if len(w) > 64:
                del self.pieces[w]
        return out


@lru_cache(maxsize=1)
def sides(path_a: str, path_b: str, ranks: str | None) -> Sides:
    return Sides(path_a, path_b, ranks)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, lane_starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links (a, b) and cuts (a, b) as token numbers. The ends are byte offsets over all documents of a slice, one after
    the other; a lane goes from its first token of A to the next lane's."""
    stop = np.append(lane_starts[1:], len(end_a))
    byte = np.where(lane_starts > 0, end_a[lane_starts - 1], 0)
    a, b = lane_starts.copy(), np.searchsorted(end_b, byte, side="right")
    links: list[tuple[np.ndarray, np.ndarray]] = []
    cuts: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a):
        links.append((a, b))
        ea, eb = end_a[a], end_b[b]
        both = ea == eb
        cuts.append((a[both], b[both]))
        a, b = a + (ea <= eb), b + (eb <= ea)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    none = np.empty(0, np.int64)
    out = [np.concatenate([none, *(x[i] for x in parts)]).astype(np.int64) for parts in (links, cuts) for i in (0, 1)]
    order = np.argsort(out[2])
    return out[0], out[1], out[2][order], out[3][order]


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts in a row, and how many each has."""
    return np.frombuffer(b"".join(parts), dtype=np.int32).astype(np.int64), np.array([len(x) // 4 for x in parts], dtype=np.int64)


def _aligned(texts: list[str], own: Sides) -> list[pa.Array]:
    ids = own.encode(texts)
    (a, n_a), (b, n_b) = (_flat([x[side] for x in ids]) for side in (0, 1))
    end_a, end_b = np.cumsum(own.size_a[a]), np.cumsum(own.size_b[b])
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    lanes = np.concatenate([np.empty(0, np.int64), *(np.arange(e - n, e, LANE) for e, n in zip(last_a.tolist(), n_a.tolist()) if n)])
    link_a, link_b, cut_a, cut_b = lockstep(end_a, end_b, lanes.astype(np.int64))
    document = np.repeat(np.arange(len(texts)), n_a)

    # Id pairs of a document, each once, and how often it is linked.
    wide_a, wide_b = len(own.bytes_a), len(own.bytes_b)
    key, times = np.unique((document[link_a] * wide_a + a[link_a]) * wide_b + b[link_b], return_counts=True)
    pairs = key // wide_b % wide_a * PAIR + key % wide_b
    pair_ends = np.concatenate(([0], np.cumsum(np.bincount(key // wide_b // wide_a, minlength=len(texts)))))

    # The text form of the groups: tokens of A, then those of B, each with the sign that follows it.
    first_b = np.concatenate(([0], cut_b + 1))
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[cut_a], mark_b[cut_b] = 1, 2
    group_a, group_b = np.cumsum(mark_a) - mark_a, (np.cumsum(mark_b) - mark_b) // 2
    signs = np.empty(len(a) + len(b), np.int64)
    signs[np.arange(len(a)) + first_b[group_a]] = a * 3 + mark_a
    signs[np.arange(len(b)) + (cut_a + 1)[group_b] if len(b) else np.empty(0, np.int64)] = b * 3 + mark_b
    shown, both = own.shown[signs].tolist(), last_a + last_b
    groups = ["".join(shown[i:j])[:-1] for i, j in zip([0, *both.tolist()], both.tolist())]

    def count(of: np.ndarray) -> pa.Array:
        return pa.array(np.bincount(of, minlength=len(texts)).astype(np.int64))

    ends = pa.array(pair_ends, pa.int32())
    return [pa.array(n_a), pa.array(n_b), count(document[cut_a]), count(document[link_a]), pa.array(groups, pa.string()),
            pa.ListArray.from_arrays(ends, pa.array(pairs.astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))]


def align(docs: DataFrame, text: str, path_a: str, path_b: str, ranks: str | None = None) -> DataFrame:
    """`docs` with the columns of ALIGNED: numbers of tokens, groups and links, the groups as
    text (`a1,a2|b1;a3|b2,b3`), and the linked id pairs with how often each is linked. `ranks` names the same vocabulary as A
    in ranks, which is read faster for texts on whose signs both libraries agree."""
    docs = docs.drop(*(c for c in ALIGNED.names if c != text))
    schema = T.StructType([*docs.schema.fields, *ALIGNED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, held = 0, 0, []
            for i, t in enumerate(batch.column(text)):
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size >= SLICE_BYTES or i + 1 == batch.num_rows:
                    made = _aligned(held, sides(path_a, path_b, ranks))
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, i + 1 - first).columns, *made],
                                                     names=[*batch.schema.names, *ALIGNED.names])
                    first, size, held = i + 1, 0, []

    return docs.mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """Id pairs with `docs`, the number of rows that link them, and `best`: whether no other pair of the A id has more."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")))
    a = F.shiftright("pair", 32)
    # One row per id of A: bounded by its vocabulary.
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return cut(counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def score_links(aligned: DataFrame) -> DataFrame:
    """`aligned` without pairs and times but with n_best (links whose pair is the best of its A id) and count_sum (the
    counts of all links' pairs)."""
    aligned = aligned.drop("n_best", "count_sum")
    path = scratch(aligned.sparkSession, "alignment")
    aligned.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(path)
    kept = aligned.sparkSession.read.parquet(path)
    rows = kept.select(ROW, F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(ROW, "p.pairs", "p.times").withColumnRenamed("pairs", "pair")
    scored = join_counted(rows, link_counts(kept), ["pair"], "docs")
    sums = scored.groupBy(ROW).agg(F.sum(F.when(F.col("best"), F.col("times").cast("bigint"))).alias("n_best"),
                                      F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    return (kept.drop("pairs", "times").join(sums, ROW, "left").drop(ROW)
            .withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_best", "count_sum")}))
