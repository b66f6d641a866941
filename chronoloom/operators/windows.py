"""Tumbling windows, row groups, frames and text roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import row_numbers


def _start(at: Column, seconds: int, first: Column) -> Column:
    """Start of the window of `at`: the first window starts at the stream's first item, later ones at multiples of the width."""
    return F.when(at < first + seconds, first).otherwise(F.floor(at / seconds) * seconds).cast("bigint")


def _joined(items: str) -> Column:
    return F.array_join(F.transform(items, lambda i: i["text"]), "\n")


def _with_first(items: DataFrame, by: Sequence[str], seconds: int, summary=None) -> DataFrame:
    """`scale_windows` with the start of each stream, `_first`."""
    first = items.groupBy(*by).agg(F.min("start_sec").alias("_first"))
    keyed = items.join(first, list(by)).withColumn("window_start", _start(F.col("start_sec"), seconds, F.col("_first")))
    ordered = F.array_sort(F.collect_list(F.struct("start_sec", "item_id", "text", "path")))
    out = keyed.groupBy(*by, "window_start").agg(ordered.alias("_items"), F.min("_first").alias("_first"))
    joined = _joined("_items")
    return out.select(*by, F.col("window_start").alias("start_sec"),
                      (F.col("window_start") + seconds).alias("end_sec"),
                      F.size("_items").alias("n_items"),
                      (summary(joined) if summary else joined).alias("text"),
                      F.col("_items")[0]["path"].alias("path"),
                      F.col("_items")[0]["item_id"].alias("item_id"), "_first")


def scale_windows(items: DataFrame, by: Sequence[str], seconds: int, summary=None) -> DataFrame:
    """Captions -> windows of `seconds` per key; the first window starts at the first item.

    Later windows start at multiples of the width. items: by, start_sec, item_id, text, path.
    `summary` maps the joined text to the window's text (a model hook); the default keeps the join.
    Holds at most one window of one stream per group.
    """
    return _with_first(items, by, seconds, summary).drop("_first")


def multiscale(items: DataFrame, by: Sequence[str], scales: Sequence[int], summary=None) -> DataFrame:
    """All scales in one table; each scale reads the windows of the one before.

    Without a summary nothing has to be built level by level: a stream's first window has the same start at every scale, so the
    start at each scale follows from the start at the one before in closed form, and the text of a window is that of its
    windows of the smallest scale, in order. Those are made once, then every scale in one more grouping.
    """
    if summary:
        levels, current = [], items
        for seconds in scales:
            current = scale_windows(current, by, seconds, summary)
            levels.append(current.withColumn("scale", F.lit(seconds)))
        return reduce(DataFrame.unionByName, levels)
    smallest = _with_first(items, by, scales[0])
    ways, below = [], F.col("start_sec")
    for i, seconds in enumerate(scales):
        start = _start(below, seconds, F.col("_first")) if i else below
        ways.append(F.struct(F.lit(seconds).alias("scale"), start.alias("window_start"), below.alias("below")))
        below = start
    dealt = smallest.select(*by, "start_sec", "n_items", "text", "path", "item_id", F.inline(F.array(*ways)))
    pieces = F.array_sort(F.collect_list(F.struct("start_sec", "item_id", "text", "path", "below", "n_items")))
    out = dealt.groupBy(*by, "scale", "window_start").agg(pieces.alias("_pieces"))
    windows_below = F.size(F.array_distinct(F.transform("_pieces", lambda p: p["below"])))
    return out.select(*by, F.col("window_start").alias("start_sec"), (F.col("window_start") + F.col("scale")).alias("end_sec"),
                      F.when(F.col("scale") == scales[0], F.col("_pieces")[0]["n_items"]).otherwise(windows_below).alias("n_items"),
                      _joined("_pieces").alias("text"), F.col("_pieces")[0]["path"].alias("path"),
                      F.col("_pieces")[0]["item_id"].alias("item_id"), "scale")


def row_groups(rows: DataFrame, by: Sequence[str], order: Sequence[str], period: int) -> DataFrame:
    """Every `period` consecutive rows of a key share a group number."""
    return row_numbers(rows, by, order).withColumn("group", F.floor((F.col("rn") - 1) / period))


def extents(rows: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Smallest start and largest end; groups without any time give no row."""
    out = rows.groupBy(*by).agg(F.min(start).alias("start"), F.max(end).alias("end"))
    return out.where(F.col("start").isNotNull() | F.col("end").isNotNull())


def halving_average(values: Column) -> Column:
    """Fold of an ordered array by (previous + next) / 2; not the mean."""
    return F.aggregate(F.slice(values, F.lit(2), F.size(values)), values[0], lambda a, v: (a + v) / 2)


def frame_samples(samples: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """One row per frame: folded x and y in sample order, kind of the last sample. Columns x, y, kind."""
    packed = F.array_sort(F.collect_list(F.struct(order, "x", "y", "kind")))
    out = samples.groupBy(*by).agg(packed.alias("_s"))
    return out.select(*by, F.size("_s").alias("n"),
                      halving_average(F.transform("_s", lambda s: s["x"])).alias("x"),
                      halving_average(F.transform("_s", lambda s: s["y"])).alias("y"),
                      F.element_at("_s", -1)["kind"].alias("kind"))


def merge_by_head(passages: DataFrame, by: Sequence[str], order: str, text: str, prefix: str) -> DataFrame:
    """Passages of one query that share a first line are joined under it."""
    head, tail = F.split(text, "\n", 2)[0], F.coalesce(F.get(F.split(text, "\n", 2), F.lit(1)), F.lit(""))
    keyed = passages.select(*by, order, head.alias("head"), tail.alias("_tail"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "_tail"))), lambda p: p["_tail"])
    out = keyed.groupBy(*by, "head").agg(F.min(order).alias("first_at"), parts.alias("_p"))
    return out.select(*by, "head", "first_at", F.concat_ws(
        "\n", F.concat(F.lit(prefix), F.col("head")), F.array_join("_p", "\n")).alias("merged"))
