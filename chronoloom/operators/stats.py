"""Paired statistics over per-question results."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .sequences import average_ranks

#: Fixed value: width of a 95 % interval in standard errors.
Z95 = 1.96


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_paired_p(a: Column | str, b: Column | str) -> Column:
    """Two-sided exact binomial p of a split a : b; 1 when nothing is discordant.

    The largest needed term comes from a sum of logarithms, the smaller ones from it by ratios, so counts of
    any size neither overflow nor vanish.
    """
    a, b = _col(a).cast("bigint"), _col(b).cast("bigint")
    n, k = a + b, F.least(a, b)
    logs = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1))), F.lit(0.0),
                       lambda acc, i: acc + F.log((n - k + i) / i))
    top = F.exp(F.when(k > 0, logs).otherwise(0.0) - n * F.lit(math.log(2)))
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(k - 1, F.lit(0)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc, j):
        i = k - j
        term = acc["term"] * (i / (n - i + 1))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.when(k > 0, F.aggregate(steps, start, add, lambda acc: acc["total"])).otherwise(1.0)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * top * total))


def chance_recall(targets: Column | str, visible: Column | str, k: int) -> Column:
    """Chance that k draws from the visible pool hold a target."""
    t, v = _col(targets).cast("bigint"), _col(visible).cast("bigint")
    draws = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.least(F.lit(k).cast("bigint"), v) - 1, F.lit(0)))
    miss = F.aggregate(draws, F.lit(1.0), lambda acc, i: acc * F.greatest(v - t - i, F.lit(0)) / F.greatest(v - i, F.lit(1)))
    return F.when((t <= 0) | (v <= 0), 0.0).when(t >= v, 1.0).otherwise(F.lit(1.0) - miss)


def expected_best_rank(targets: Column | str, visible: Column | str) -> Column:
    return (_col(visible) + 1) / (_col(targets) + 1)


def paired_interval(n: Column, only_a: Column, only_b: Column) -> dict[str, Column]:
    """Difference of paired proportions with its 95 % Wald interval."""
    d = (only_a - only_b) / n
    se = F.sqrt(F.greatest(only_a + only_b - (only_a - only_b) * (only_a - only_b) / n, F.lit(0.0))) / n
    return {"diff": d, "low": d - Z95 * se, "high": d + Z95 * se}


def proportion_interval(p: Column, n: Column) -> dict[str, Column]:
    half = Z95 * F.sqrt(p * (1 - p) / n)
    return {"low": p - half, "high": p + half}


def _folded(diffs: DataFrame, diff: str) -> DataFrame:
    """Distinct values with counts: the resampling tests depend on nothing else."""
    return diffs.where(F.col(diff).isNotNull()).groupBy(F.col(diff).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def _seed(seed: int, *parts) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *[int(p) & 0xFFFFFFFF for p in parts]])))


#: Replicates or permutations that one task draws for a chunk of values.
REPLICATES = 500


def sign_flip_p(diffs: DataFrame, diff: str, n: int = 50000, seed: int = 0, chunk_values: int = 50000) -> DataFrame:
    """Permutation p of the mean difference: zeros dropped, p = (hits + 1) / (n + 1), or 1 when nothing is left.

    Flipping the signs of all differences of one size is one binomial draw, so the work is permutations times
    distinct sizes, whatever the number of questions. Sizes are dealt into chunks by hash; a task draws one block of
    permutations for one chunk and hands back one partial sum per permutation.
    """
    sizes = _folded(diffs, diff).where("value <> 0").select(
        F.abs("value").alias("size"), "n", (F.col("value") * F.col("n")).alias("part"))
    sizes = cut(sizes.groupBy("size").agg(F.sum("n").alias("n"), F.sum("part").alias("part")))
    observed = sizes.agg(F.coalesce(F.abs(F.sum("part")), F.lit(0.0)).alias("observed")).withColumn("_k", F.lit(1))
    n_chunks, n_blocks = sizes.count() // chunk_values + 1, -(-n // REPLICATES)

    def flipped(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        block, chunk = int(part["block"].iloc[0]), int(part["chunk"].iloc[0])
        size, count, rng = part["size"].to_numpy(), part["n"].to_numpy(), _seed(seed, block, chunk)
        perms = range(block * REPLICATES, min(n, (block + 1) * REPLICATES))
        return pd.DataFrame({"perm": perms, "total": [float((2.0 * rng.binomial(count, 0.5) - count) @ size) for _ in perms]})

    dealt = sizes.select("size", "n", F.pmod(F.xxhash64("size"), F.lit(n_chunks)).alias("chunk"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    parts = dealt.groupBy("chunk", "block").applyInPandas(flipped, "perm bigint, total double")
    sums = parts.groupBy("perm").agg(F.sum("total").alias("total"))
    hits = sums.withColumn("_k", F.lit(1)).join(observed, "_k").agg(
        F.count_if(F.abs("total") >= F.col("observed") - 1e-12).alias("hits"), F.count(F.lit(1)).alias("drawn"))
    return hits.select(F.when(F.col("drawn") == 0, 1.0).otherwise((F.col("hits") + 1) / F.lit(n + 1)).alias("p"))


def bootstrap_interval(diffs: DataFrame, diff: str, draws: int = 10000, seed: int = 0, level: float = 0.95,
                       chunk_values: int = 50000) -> DataFrame:
    """Mean difference with bootstrap percentile ends.

    A resample of all questions is one multinomial draw over the distinct differences. These are dealt into chunks
    by hash; each replicate first draws how many questions fall into every chunk, then, chunk by chunk, into its
    values, which is the same draw. A task holds one chunk; only the totals of the chunks, one number per
    `chunk_values` distinct differences, go to every task.
    """
    folded = cut(_folded(diffs, diff))
    n_chunks = folded.count() // chunk_values + 1
    n_blocks = -(-draws // REPLICATES)
    dealt = folded.withColumn("chunk", F.pmod(F.xxhash64("value"), F.lit(n_chunks)))
    held = (dealt.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("v"))
            .select("chunk", F.col("v.value").alias("values"), F.col("v.n").alias("counts")))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    totals = (dealt.groupBy("chunk").agg(F.sum("n").alias("n"))
              .agg(F.array_sort(F.collect_list(F.struct("chunk", "n"))).alias("v")).where(F.size("v") > 0)
              .select(F.col("v.chunk").alias("chunks"), F.col("v.n").alias("counts"), F.lit(1).alias("_k")))
    blocks = folded.sparkSession.range(n_blocks).select(F.col("id").cast("int").alias("block"), F.lit(1).alias("_k"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, chunks, counts in zip(b["block"], b["chunks"], b["counts"]):
                total = int(counts.sum())
                for rep in range(block * REPLICATES, min(draws, (block + 1) * REPLICATES)):
                    drawn = _seed(seed, rep).multinomial(total, counts / total)
                    yield pd.DataFrame({"block": block, "chunk": chunks, "rep": rep, "drawn": drawn})

    def resample(shares: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        values, counts = chunk["values"].iloc[0], chunk["counts"].iloc[0]
        chances, c = counts / counts.sum(), int(chunk["chunk"].iloc[0])
        totals = [float(_seed(seed, rep, c).multinomial(k, chances) @ values) for rep, k in zip(shares["rep"], shares["drawn"])]
        return pd.DataFrame({"rep": shares["rep"], "total": totals, "drawn": shares["drawn"]})

    shares = blocks.join(F.broadcast(totals), "_k").select("block", "chunks", "counts").mapInPandas(
        split, "block int, chunk bigint, rep bigint, drawn bigint")
    parts = shares.groupBy("block", "chunk").cogroup(held.groupBy("block", "chunk")).applyInPandas(
        resample, "rep bigint, total double, drawn bigint")
    means = parts.groupBy("rep").agg((F.sum("total") / F.sum("drawn")).alias("m"))
    tail = (1 - level) / 2
    center = folded.agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n")).withColumn("_k", F.lit(1))
    ends = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high")).withColumn("_k", F.lit(1))
    return center.join(ends, "_k").drop("_k")


# Abramowitz and Stegun 7.1.26, an approximation of the error function to 1.5e-7.
ERF_SCALE = 0.3275911
ERF_TERMS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _normal_tail(z: Column) -> Column:
    """Two-sided normal tail."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = F.lit(1.0) / (F.lit(1.0) + ERF_SCALE * x)
    poly = F.lit(0.0)
    for term in reversed(ERF_TERMS):
        poly = t * (F.lit(term) + poly)
    return poly * F.exp(-x * x)


#: Up to so many differences without ties the distribution of the rank sum is counted out.
EXACT_RANKS = 50


def _exact_rank_tail(n: Column, w: Column) -> Column:
    """Two-sided p of a sum of signed ranks 1 to n. counts[s] is in how many of the 2^n sign patterns the positive ranks sum to s;
    rank by rank, each pattern goes on without the rank or with it. All counts are whole numbers below 2^53."""
    n = n.cast("int")
    sums = (n * (n + 1) / 2).cast("int") + 1
    none = F.transform(F.sequence(F.lit(0), sums - 1), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1), n), none, lambda c, rank: F.transform(
        c, lambda v, s: v + F.when(s >= rank, F.get(c, s - rank)).otherwise(0.0)))
    at = w.cast("int")

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, v: a + v)

    tails = F.element_at(F.transform(F.array(counts), lambda c: F.least(
        total(F.slice(c, F.lit(1), at + 1)), total(F.slice(c, at + 1, sums - at)))), 1)
    return F.least(F.lit(1.0), 2 * tails / F.pow(F.lit(2.0), n))


def signed_rank(pairs: DataFrame, by: str, a: str, b: str, least: int = 10) -> DataFrame:
    """Wilcoxon test on log rank differences per group, with better : worse counts.

    Up to EXACT_RANKS non-zero differences without ties, p counts out all sign patterns (method `exact`); otherwise it is the
    normal approximation with tie correction (`normal`). Groups with fewer than `least` non-zero differences have no p.
    """
    d = F.round(F.log(F.col(a) / F.col(b)), 12)
    rows = pairs.select(by, d.alias("d")).where("d <> 0").select(by, F.abs("d").alias("size"), (F.col("d") > 0).alias("up"))
    ranks = average_ranks(rows.select(by, "size"), [by], "size").select(by, "size", "n", "avg_rank")
    ups = rows.groupBy(by, "size").agg(F.count_if("up").alias("ups"))
    out = ranks.join(ups, [by, "size"]).groupBy(by).agg(
        F.sum("n").alias("n"), F.sum("ups").alias("better"), F.sum(F.col("ups") * F.col("avg_rank")).alias("w"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48.0
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(var)
    enough, exact = F.col("n") >= least, (F.col("n") <= EXACT_RANKS) & (F.col("ties") == 0)
    p = F.when(enough & exact, _exact_rank_tail(F.col("n"), F.col("w"))).when(enough, _normal_tail(z))
    return out.select(by, "n", "better", (F.col("n") - F.col("better")).alias("worse"), "w", F.when(enough, z).alias("z"), p.alias("p"),
                      F.when(enough & exact, "exact").when(enough, "normal").alias("method"))
