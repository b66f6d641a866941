"""Ordered computations that do not need a whole group in one task.

A plain window pulls each partition key into a single task, which breaks when one key (or no key at
all) covers the table. Here the rows are range partitioned on (key, order) so a large key spans many
chunks; every chunk is computed locally and a small per-chunk table carries the state across.
The chunked rows are checkpointed once, because the per-chunk totals and the rows must see the very
same range boundaries even if a task is run again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, parallelism

CHUNK = "_chunk"


def chunked(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
            partitions: int | None = None) -> DataFrame:
    """Range partition on (by, order); `order` must end in a unique column. Keys must not be null."""
    n = partitions or parallelism(df.sparkSession)
    ranged = df.repartitionByRange(n, *by, *order)
    return cut(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _local(by, order):
    return Window.partitionBy(CHUNK, *by).orderBy(*order)


def _earlier(by):
    return Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def running_over(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column],
                 columns: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Inclusive running `sum`, `max` or `min` over chunked rows."""
    fn = {"sum": F.sum, "max": F.max, "min": F.min}
    totals = rows.groupBy(CHUNK, *by).agg(
        *[fn[kind](c).alias(f"_t_{name}") for name, (kind, c) in columns.items()])
    carry = totals.select(CHUNK, *by, *[
        fn[kind](f"_t_{name}").over(_earlier(by)).alias(f"_c_{name}")
        for name, (kind, _) in columns.items()])
    frame = _local(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(carry, [CHUNK, *by])
    for name, (kind, c) in columns.items():
        local, before = fn[kind](c).over(frame), F.col(f"_c_{name}")
        if kind == "sum":
            value = F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            value = (F.greatest if kind == "max" else F.least)(local, before)
        out = out.withColumn(name, value)
    return out.drop(*[f"_c_{name}" for name in columns])


def lag_over(rows: DataFrame, by: Sequence[str], order: Sequence[str],
             columns: Mapping[str, Column]) -> DataFrame:
    """Previous row's values inside `by`, also across chunk edges. `order` holds ascending names."""
    packed = rows.withColumn("_v", F.struct(*[c.alias(n) for n, c in columns.items()]))
    last = packed.groupBy(CHUNK, *by).agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    carry = last.select(CHUNK, *by, F.last("_last").over(_earlier(by)).alias("_carry"))
    out = packed.join(carry, [CHUNK, *by]).withColumn(
        "_p", F.coalesce(F.lag("_v").over(_local(by, order)), F.col("_carry")))
    return out.select("*", *[F.col(f"_p.{n}").alias(n) for n in columns]).drop("_v", "_p", "_carry")


def number_over(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column],
                name: str = "rn") -> DataFrame:
    sizes = rows.groupBy(CHUNK, *by).agg(F.count(F.lit(1)).alias("_n"))
    carry = sizes.select(CHUNK, *by, F.sum("_n").over(_earlier(by)).alias("_before"))
    return (rows.join(carry, [CHUNK, *by])
            .withColumn(name, F.row_number().over(_local(by, order)).cast("bigint")
                        + F.coalesce("_before", F.lit(0)))
            .drop("_before"))


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
                name: str = "rn") -> DataFrame:
    """`row_number() over (partition by by order by order)` without one task per key."""
    return number_over(chunked(df, by, order), by, order, name).drop(CHUNK)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
            columns: Mapping[str, tuple[str, Column]]) -> DataFrame:
    return running_over(chunked(df, by, order), by, order, columns).drop(CHUNK)


def lagged(df: DataFrame, by: Sequence[str], order: Sequence[str],
           columns: Mapping[str, Column]) -> DataFrame:
    return lag_over(chunked(df, by, order), by, order, columns).drop(CHUNK)


def island_ids(df: DataFrame, by: Sequence[str], order: Sequence[str],
               previous: Mapping[str, Column], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows inside `by`: a row opens a run when `starts` holds.

    `previous` names the lagged values that `starts` may use; they are null on the first row.
    """
    rows = lag_over(chunked(df, by, order), by, order, previous)
    return running_over(rows, by, order, {name: ("sum", starts.cast("int"))}).drop(CHUNK)


def _value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, _n, _upto, _total): equal values folded first, then counted in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    return running(counts, by, [value], {"_upto": ("sum", F.col("_n"))}).join(totals, list(by))


def _value_at(value: str, pos: Column) -> Column:
    """The value at a zero-based position of the sorted group."""
    here = (F.col("_upto") > pos) & (F.col("_upto") - F.col("_n") <= pos)
    return F.max(F.when(here, F.col(value).cast("double")))


def exact_percentile(df: DataFrame, by: Sequence[str], value: str, share: float,
                     name: str) -> DataFrame:
    """Interpolated percentile per group; a large group never sits in one task."""
    if not by:
        whole = exact_percentile(df.withColumn("_all", F.lit(0)), ["_all"], value, share, name)
        return whole.drop("_all")
    pos = F.lit(float(share)) * (F.col("_total") - 1)
    lo = F.floor(pos)
    picked = _value_counts(df, by, value).groupBy(*by).agg(
        _value_at(value, lo).alias("_lo"), _value_at(value, F.ceil(pos)).alias("_hi"),
        F.max(pos - lo).alias("_f"))
    return picked.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(name))


def upper_median(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """The sorted group's element at floor(n / 2); no interpolation."""
    return _value_counts(df, by, value).groupBy(*by).agg(
        _value_at(value, F.floor(F.col("_total") / 2)).alias(name))
