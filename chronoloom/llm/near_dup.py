"""SimHash near-duplicates: fingerprints of four-word shingles, linked at a few differing bits.

Fingerprints: each shingle's 64-bit hash votes; a bit is 1 if set in over half of them. The votes of a text are 32
running sums, added up where the text is read.

Links: fingerprints that differ in at most `radius` bits differ in at most `radius` of their 8 bytes, so they share at
least 8 - radius bytes at equal positions. An inverted index files every distinct fingerprint under positional bytes.
A posting of one byte would hold 1/256 of all fingerprints, so postings are keyed by three positional bytes at once;
the twenty triples of `TRIPLES` are chosen so that any four positions hold one of them, and no pair with four shared
bytes is missed. Pairs that meet tally their shared positional bytes, those with the guaranteed minimum are verified,
and a pair is reported only by the first triple in which it meets. Postings with many fingerprints are split by a salt.

Documents with equal fingerprints are folded first. Null and empty texts have fingerprint zero and link like any
other. Null ids take part but never name a component unless all ids in it are null. Repeated rows come back repeated.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut
from .text import bit_counts, differing_bits, majority, text_or_empty, words
from .url_filter import LOWER, UPPER

SHINGLE = 4
RADIUS = 4
POSTING = 256                    # fingerprints of a posting that one salt value compares with all others


def covering_triples(positions: int = 8, shared: int = 4) -> list[tuple[int, ...]]:
    """Triples of positions such that any `shared` positions hold one: all triples within a third of the circle
    pattern (0,1,2 / 3,4,5 / 6,7 classes: three of a class, or two of a class and one of the next)."""
    groups = [p % 3 for p in range(positions)]
    out = [t for t in combinations(range(positions), 3)
           if len({groups[p] for p in t}) == 1 or any(
               sum(groups[p] == g for p in t) == 2 and sum(groups[p] == (g + 1) % 3 for p in t) == 1 for g in range(3))]
    assert all(any(set(t) <= set(four) for t in out) for four in combinations(range(positions), shared))
    return out


TRIPLES = covering_triples()


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _h, fingerprint bigint), a row per row of `docs`; _h is a hash of the lower-cased text."""
    rows = docs.select(F.col(key), F.translate(text_or_empty(text), UPPER, LOWER).alias("_t"))
    rows = rows.select(key, F.xxhash64("_t").alias("_h"), words(F.col("_t")).alias("_w"))
    n = F.size("_w")
    later = [F.slice("_w", i + 1, F.greatest(n - SHINGLE + 1, F.lit(0))) for i in range(SHINGLE)]
    full = F.arrays_zip(*[x.alias(f"w{i}") for i, x in enumerate(later)])
    short = F.array(F.struct(F.array_join("_w", " ").alias("w0"), *[F.lit(None).cast("string").alias(f"w{i}") for i in range(1, SHINGLE)]))
    shingled = rows.select(key, "_h", F.posexplode(F.when(n >= SHINGLE, full).otherwise(short)).alias("_i", "_s"))
    hashed = shingled.select(key, "_h", "_i", F.xxhash64(F.concat_ws(" ", *[f"_s.w{i}" for i in range(SHINGLE)])).alias("_x"),
                             (F.col("_s.w0") != "").cast("int").alias("_one"))
    counts = hashed.groupBy(key, "_h").agg(
        *bit_counts(F.col("_x"), F.col("_one"), "_b"), F.sum("_one").cast("bigint").alias("_n"),
        F.sum((F.col("_i") == 0).cast("int")).cast("int").alias("_rows"))
    return counts.select(key, "_h", majority("_b", F.col("_n")).alias("fingerprint"), "_rows").select(
        key, "_h", "fingerprint", F.explode(F.array_repeat(F.lit(0), F.col("_rows"))).alias("_r")).drop("_r")


def byte_mask(places) -> int:
    mask = sum(0xFF << (8 * p) for p in places)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def shared_bytes(a: Column, b: Column) -> Column:
    """Tally of positions at which both hold the same byte."""
    x = a.bitwiseXOR(b)
    out = F.lit(0)
    for p in range(8):
        out = out + (x.bitwiseAND(F.lit(byte_mask([p]))) == 0).cast("int")
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), u < v: distinct fingerprints (column `fingerprint`) at 1 to `radius` differing bits; radius 0 to 4."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the byte triples cover a radius of 0 to {RADIUS}")
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(byte_mask(t))).alias("k"))
                     for i, t in enumerate(TRIPLES)])
    postings = prints.select("fingerprint", F.inline(keys))
    crowded = (postings.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
               .withColumn("salts", F.ceil(F.col("n") / POSTING).cast("int")))
    met = postings.join(crowded, ["t", "k"])
    left = met.select("t", "k", F.col("fingerprint").alias("u"), F.pmod(F.xxhash64("fingerprint"), "salts").cast("int").alias("s"))
    right = met.select("t", "k", F.col("fingerprint").alias("v"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    first = F.lit(False)
    for i, t in enumerate(TRIPLES):
        first = first | ((F.col("t") > i) & (x.bitwiseAND(F.lit(byte_mask(t))) == 0))
    pairs = left.join(right, ["t", "k", "s"]).where(F.col("u") < F.col("v"))
    return pairs.where((shared_bytes(F.col("u"), F.col("v")) >= 8 - radius)
                       & (differing_bits(F.col("u"), F.col("v")) <= radius) & ~first).select("u", "v")


def near_duplicates(docs: DataFrame, key: str, text: str, radius: int = RADIUS) -> DataFrame:
    """(key, _h, fingerprint, component_id, root): component_id is the smallest key reachable over links, root the
    smallest fingerprint of the component."""
    prints = cut(fingerprints(docs, key, text))
    heads = cut(prints.groupBy("fingerprint").agg(F.min(key).alias("head")))
    groups = connected_components(links(heads.select("fingerprint"), radius))
    named = heads.join(groups.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left").select(
        "fingerprint", "head", F.coalesce("component", "fingerprint").alias("root"))
    lowest = named.groupBy("root").agg(F.min("head").alias("component_id"))
    # Joined per distinct fingerprint first: the rows of a large component never meet under one key.
    told = named.select("fingerprint", "root").join(lowest, "root")
    return prints.join(told, "fingerprint").select(
        key, "_h", "fingerprint", "component_id", "root")


def keep_one(docs: DataFrame, key: str, text: str, radius: int = RADIUS) -> DataFrame:
    """One row of every component of near duplicates: the one with the smallest key, nulls last, and of equal keys the
    smallest text hash. All columns of `docs` stay."""
    name = [F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull().cast("string"), F.col("_h").cast("string")]
    order = F.struct(F.col(key).isNull(), F.col(key), F.col("_h"))
    kept = (near_duplicates(docs.select(key, text), key, text, radius).groupBy("root").agg(F.min(order).alias("best"))
            .select(F.col(f"best.{key}").alias(key), "best._h").select(F.concat_ws("|", *name).alias("row")))
    lowered = F.xxhash64(F.translate(text_or_empty(text), UPPER, LOWER)).alias("_h")
    rows = docs.select(F.struct("*").alias("doc"), F.col(key).alias(key), lowered).select(F.concat_ws("|", *name).alias("row"), "doc")
    return rows.join(kept, "row").dropDuplicates(["row"]).select("doc.*")
