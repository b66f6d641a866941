"""Near-duplicate removal with banded MinHash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .graph import connected_components

# --- Fixed values: tokens, hash ranges and bands for a Jaccard threshold of 0.7 --------------------
NOT_TOKEN = "[^A-Za-z_0-9]"
PRIME = np.uint64((1 << 61) - 1)
TOP = np.uint64((1 << 32) - 1)
PERMUTATIONS = 256
SEED = 42
BANDS, BAND_ROWS = 25, 10
NGRAM = 5
# --------------------------------------------------------------------------------------------------


def coefficients(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multiplier and offset of each permutation, drawn in turn from one seeded generator."""
    rng = np.random.RandomState(seed)
    draws = [(rng.randint(1, PRIME, dtype=np.uint64), rng.randint(0, PRIME, dtype=np.uint64)) for _ in range(n)]
    pairs = np.array(draws, dtype=np.uint64)
    return pairs[:, 0], pairs[:, 1]


def token_hashes(text: Column, size: int) -> Column:
    """32-bit hashes of the word n-grams of the whole text, four bytes each, one after the other."""
    def packed(words: Column) -> Column:
        starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1))
        heads = F.transform(starts, lambda i: F.substring(F.sha1(F.array_join(F.slice(words, i, size), " ").cast("binary")), 1, 8))
        return F.unhex(F.array_join(heads, ""))

    # The words are bound by the outer transform, so that a text is split once and not once per n-gram.
    return F.transform(F.array(F.split(F.coalesce(text, F.lit("")), NOT_TOKEN)), packed)[0]


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 128) -> np.ndarray:
    """Minimum permuted hash per permutation; 64-bit products wrap.

    Blocks are small enough for the processor cache, and the remainder by 2^61 - 1 is taken by folding the
    high bits onto the low ones.
    """
    low = np.full(len(a), TOP, dtype=np.uint64)
    shift = np.uint64(61)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), block):
            x = hashes[i:i + block, None] * a
            x += b
            high = x >> shift
            x &= PRIME
            x += high
            np.subtract(x, PRIME, out=x, where=x >= PRIME)
            x &= TOP
            np.minimum(low, x.min(axis=0), out=low)
    return low


def band_keys(hashed: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, permutations: int = PERMUTATIONS, at_once: int = 256) -> DataFrame:
    """(id, keys): the band hashes of every text with `token_hashes`. hashed: id, hashes.

    A few texts at a time leave the task, and their hashes are read where Arrow holds them, so that Python keeps one batch and a slice.
    """
    a, b = coefficients(permutations)

    def one(hashes: pa.BinaryScalar) -> list[str]:
        low = signature(np.unique(np.frombuffer(hashes.as_buffer(), dtype="<u4")).astype(np.uint64), a, b)
        return [hashlib.md5(low[i * rows:(i + 1) * rows].tobytes()).hexdigest() for i in range(bands)]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                part = part.filter(pc.greater(pc.binary_length(part.column("hashes")), 0))      # null is not greater
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([one(h) for h in part.column("hashes")], pa.list_(pa.string()))],
                                                 names=["id", "keys"])

    kind = hashed.schema["id"].dataType.simpleString()
    return hashed.select("id", "hashes").mapInArrow(keys, f"id {kind}, keys array<string>")


def duplicate_edges(docs: DataFrame, key: str, text: str, ngram: int = NGRAM, **bands) -> DataFrame:
    """(u, v) links of documents that share a band, as stars around the smallest id.

    Equal signatures are folded first, so a crowd of copies enters the bands as one row; in a band every
    member links to the smallest id only, never to all others.
    """
    texts = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("_text")))
    hashed = texts.select("id", token_hashes(F.col("_text"), ngram).alias("hashes"))
    signed = cut(band_keys(hashed, **bands).withColumn("sig", F.md5(F.array_join("keys", ""))))
    heads = cut(signed.groupBy("sig").agg(F.min("id").alias("head"), F.first("keys").alias("keys")))
    same = signed.select("id", "sig").join(heads.select("sig", "head"), "sig").where("id <> head").select(
        F.col("id").alias("u"), F.col("head").alias("v"))
    banded = heads.select("head", F.posexplode("keys").alias("band", "key"))
    first = banded.groupBy("band", "key").agg(F.min("head").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = banded.join(first, ["band", "key"]).where("head <> v").select(F.col("head").alias("u"), "v")
    return same.unionByName(near).distinct()


def deduplicate(docs: DataFrame, key: str, text: str, **bands) -> DataFrame:
    """Documents that are the smallest id of their cluster.

    Texts too short for a single n-gram would all share one empty signature; they are kept as they are.
    """
    groups = connected_components(duplicate_edges(docs, key, text, **bands))
    dropped = groups.where("node <> component").select(F.col("node").alias(key))
    return docs.join(dropped, key, "left_anti")
