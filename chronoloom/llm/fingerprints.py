"""SimHash document fingerprints of 128 bits, and a search within a Hamming radius by permuted block tables.

Terms are pairs of neighbouring words, and the last word alone. A term's weight is its length in characters, at most
16, times its number of occurrences: long terms say more about a text than function words. Each of the 128
hash bits votes with the weight, plus if set, else minus; the sign is the fingerprint's bit.

The search cuts fingerprints into `radius` + 1 blocks. Two fingerprints within the radius agree in one block at
least, so a table per block, keyed by that block moved to the front, finds all of them; pairs that meet are verified
and reported by the first table in which they meet.

Null and empty texts have fingerprint zero. Equal texts have equal fingerprints. Repeated rows come back repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bit_counts, differing_bits, hex16, majority, text_or_empty, words

BITS = 128
MOST_WEIGHT = 16


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, hi, lo): a row per distinct `keys`, which must determine the text. Keys must not be null."""
    split = rows.select(*keys, words(text_or_empty(text)).alias("_w"))
    terms = F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))).alias("b"))
    each = split.select(*keys, F.explode_outer(terms).alias("_p")).select(
        *keys, F.xxhash64("_p.a", "_p.b").alias("_x"),
        F.least(F.lit(MOST_WEIGHT), F.coalesce(F.length("_p.a"), F.lit(0)) + F.coalesce(F.length("_p.b"), F.lit(0))).cast("bigint").alias("_m"))
    each = each.withColumn("_y", F.xxhash64("_x"))
    counts = each.groupBy(*keys).agg(*bit_counts(F.col("_x"), F.col("_m"), "_a"), *bit_counts(F.col("_y"), F.col("_m"), "_c"),
                                     F.sum("_m").alias("_total"))
    return counts.select(*keys, majority("_a", F.col("_total")).alias("hi"), majority("_c", F.col("_total")).alias("lo"))


def shown(hi: Column, lo: Column) -> Column:
    return F.concat(hex16(hi), hex16(lo))


def likeness(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    """Estimated cosine of the weighted terms, from the share of differing bits; opposite or worse counts as 0."""
    share = (differing_bits(hi_a, hi_b) + differing_bits(lo_a, lo_b)) / F.lit(float(BITS))
    return F.greatest(F.lit(0.0), F.cos(share * F.lit(3.141592653589793)))


def _blocks(radius: int) -> list[tuple[int, int]]:
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _mask(start: int, end: int) -> tuple[int, int]:
    whole = ((1 << (end - start)) - 1) << (BITS - end)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in (whole >> 64, whole & ((1 << 64) - 1))]
    return signed[0], signed[1]


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """(q_hi, q_lo, hi, lo, bits) for all fingerprints of `prints` within `radius` bits of one of `queries`.

    Both hold distinct (hi, lo). Hot blocks are ordinary skewed keys of an inner join, which adaptive execution splits.
    """
    masks = [_mask(*b) for b in _blocks(radius)]

    def table(df: DataFrame, hi: str, lo: str) -> DataFrame:
        return df.select(hi, lo, F.inline(F.array(*[F.struct(
            F.lit(i).alias("t"), F.col(hi).bitwiseAND(F.lit(a)).alias("k_hi"), F.col(lo).bitwiseAND(F.lit(b)).alias("k_lo"))
            for i, (a, b) in enumerate(masks)])))

    asked = table(queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")), "q_hi", "q_lo")
    x, y = F.col("hi").bitwiseXOR(F.col("q_hi")), F.col("lo").bitwiseXOR(F.col("q_lo"))
    bits = F.bit_count(x) + F.bit_count(y)
    earlier = F.lit(False)
    for i, (a, b) in enumerate(masks):
        earlier = earlier | ((F.col("t") > i) & (x.bitwiseAND(F.lit(a)) == 0) & (y.bitwiseAND(F.lit(b)) == 0))
    met = asked.join(table(prints.select("hi", "lo"), "hi", "lo"), ["t", "k_hi", "k_lo"])
    return met.where((bits <= radius) & ~earlier).select("q_hi", "q_lo", "hi", "lo", bits.alias("bits"))
