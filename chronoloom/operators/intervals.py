"""Interval, tolerance, containment, nearest and as-of joins as equi joins on time buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import chunked, running_over


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    first, last = F.floor(lo / F.lit(width)), F.floor(hi / F.lit(width))
    return F.sequence(first, F.greatest(first, last))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str],
                 right_span: tuple[str, str], width: float, by: Sequence[str] = (),
                 strict: bool = False) -> DataFrame:
    """Pairs whose spans meet (closed ends, or open when `strict`), each pair exactly once.

    Both sides are listed once per bucket they touch; a pair is kept only in the bucket of the later
    start, so no distinct is needed. A crowded bucket is an ordinary skewed equi join, which adaptive
    execution splits. Column names of the two sides must differ except for `by`.
    """
    (al, ah), (bl, bh) = left_span, right_span
    a = left.withColumn("_b", F.explode(_buckets(F.col(al), F.col(ah), width)))
    b = right.withColumn("_b", F.explode(_buckets(F.col(bl), F.col(bh), width)))
    if strict:
        meet = (F.col(al) < F.col(bh)) & (F.col(ah) > F.col(bl))
    else:
        meet = (F.col(al) <= F.col(bh)) & (F.col(ah) >= F.col(bl))
    home = F.floor(F.greatest(F.col(al), F.col(bl)) / F.lit(width)) == F.col("_b")
    return a.join(b, [*by, "_b"]).where(meet & home).drop("_b")


def tolerance_join(points: DataFrame, spans: DataFrame, at: str | tuple[str, str],
                   span: tuple[str, str], tol: float, width: float,
                   by: Sequence[str] = ()) -> DataFrame:
    """Spans [lo, hi] that meet [a - tol, b + tol] for every point or annotated span (a, b)."""
    a, b = (at, at) if isinstance(at, str) else at
    wide = points.withColumn("_wlo", F.col(a) - F.lit(tol)).withColumn("_whi", F.col(b) + F.lit(tol))
    return overlap_join(wide, spans, ("_wlo", "_whi"), span, width, by).drop("_wlo", "_whi")


def span_distance(at: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - at, at - hi, F.lit(0))


def as_of(queries: DataFrame, versions: DataFrame, at: str, version: str,
          by: Sequence[str] = (), unique: str = "qid", name: str = "as_of") -> DataFrame:
    """Latest `version` time <= `at` for each query, through one ordered pass over both tables."""
    marks = versions.select(*by, F.col(version).alias("_t"), F.lit(0).alias("_side"),
                            F.lit(None).cast("bigint").alias("_u"), F.col(version).alias("_v"))
    asks = queries.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"),
                          F.col(unique).cast("bigint").alias("_u"),
                          F.lit(None).cast(versions.schema[version].dataType).alias("_v"))
    order = ["_t", "_side", "_u"]
    rows = chunked(marks.distinct().unionByName(asks), by, order)
    found = running_over(rows, by, order, {name: ("max", F.col("_v"))})
    found = found.where("_side = 1").select(F.col("_u").alias(unique), name)
    return queries.join(found, unique)


def visible_counts(queries: DataFrame, rows: DataFrame, at: str, end: str,
                   by: Sequence[str] = (), unique: str = "qid") -> DataFrame:
    """Future guard: how many rows ended by each query's time, and the latest of them.

    One running pass over rows and queries in time order, so no (query, row) pair is ever built.
    """
    marks = rows.select(*by, F.col(end).alias("_t"), F.lit(0).alias("_side"),
                        F.monotonically_increasing_id().alias("_u"))
    asks = queries.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"),
                          F.col(unique).cast("bigint").alias("_u"))
    order = ["_t", "_side", "_u"]
    both = chunked(marks.unionByName(asks), by, order)
    seen = running_over(both, by, order, {
        "n_visible": ("sum", (F.col("_side") == 0).cast("bigint")),
        "last_end": ("max", F.when(F.col("_side") == 0, F.col("_t")))})
    seen = seen.where("_side = 1").select(F.col("_u").alias(unique), "n_visible", "last_end")
    return queries.join(seen, unique)


def visible_join(queries: DataFrame, rows: DataFrame, at: str, end: str, width: float,
                 horizon: float, by: Sequence[str] = ()) -> DataFrame:
    """(query, row) pairs with `horizon` >= at - end >= 0, for callers that bound the look-back.

    A bucket is never narrower than the horizon, so a query is listed in two of them at most.
    """
    width = max(width, horizon)
    q = queries.withColumn("_b", F.explode(_buckets(F.col(at) - F.lit(horizon), F.col(at), width)))
    r = rows.withColumn("_b", F.floor(F.col(end) / F.lit(width)))
    gap = F.col(at) - F.col(end)
    return q.join(r, [*by, "_b"]).where((gap >= 0) & (gap <= F.lit(horizon))).drop("_b")


def meeting_counts(points: DataFrame, spans: DataFrame, at: str, span: tuple[str, str],
                   counts: Mapping[str, tuple[float, Column]], by: Sequence[str] = ()) -> DataFrame:
    """(by, at) with, per name, how many spans meet [at - tol, at + tol] and fulfil a condition; each instant once.

    counts: name -> (tol, condition on the span). A span that meets began by at + tol and did not end before at - tol, so
    one running pass over starts, ends and instants counts them, and no (point, span) pair is ever built. Spans
    must not end before they start.
    """
    lo, hi = span
    names, zero = list(counts), F.lit(0).cast("bigint")

    def marks(end: str, mine: str, other: str) -> DataFrame:
        return spans.groupBy(*by, F.col(end).cast("double").alias("_t")).agg(
            *[F.count_if(counts[n][1]).alias(f"{mine}{n}") for n in names]).withColumns({f"{other}{n}": zero for n in names})

    steps = marks(lo, "_up_", "_down_").unionByName(marks(hi, "_down_", "_up_")).where("_t IS NOT NULL")
    steps = steps.groupBy(*by, "_t").agg(*[F.sum(f"{d}{n}").alias(f"{d}{n}") for d in ("_up_", "_down_") for n in names])
    steps = steps.withColumns({"_side": F.lit(1), "_at": F.lit(None).cast(points.schema[at].dataType), "_tol": F.lit(None).cast("double")})
    tols = F.array(*[F.lit(float(x)) for x in sorted({tol for tol, _ in counts.values()})])
    asks = points.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at")).distinct().withColumn("_tol", F.explode(tols))
    asks = asks.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(2)))).withColumns({f"{d}{n}": zero for d in ("_up_", "_down_") for n in names})
    asks = asks.withColumn("_t", F.col("_at") + F.when(F.col("_side") == 0, -F.col("_tol")).otherwise(F.col("_tol")))
    order = ["_t", "_side", "_at"]
    seen = running_over(chunked(steps.unionByName(asks), by, order), by, order,
                        {f"{d}{n}": ("sum", F.col(f"{d}{n}")) for d in ("_up_", "_down_") for n in names})
    return seen.where("_side <> 1").groupBy(*by, F.col("_at").alias(at)).agg(*[
        F.sum(F.when(F.col("_tol") == float(counts[n][0]),
                     F.when(F.col("_side") == 2, F.col(f"_up_{n}")).otherwise(-F.col(f"_down_{n}")))).alias(n) for n in names])
