"""Ordered analyses per stream: islands, saccades, page numbers, ranks, corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import _value_counts, chunked, island_ids, lag_over, row_numbers, running, running_over


def minmax(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(x - min) / (max - min) per key; all ones for a constant column."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return (rows.join(ends, list(by))
            .withColumn(name, F.when(span == 0, 1.0).otherwise((F.col(value) - F.col("_lo")) / span))
            .drop("_lo", "_hi"))


def episodes(fixations: DataFrame, by: str, max_distance: float, max_pause: float) -> DataFrame:
    """Merge neighbouring fixations: near the previous one and started soon after it ended.

    fixations: by, fixation_id, start, end, cx, cy, object, others (array), caption. Every comparison is
    with the row before. The modal object's first appearance wins ties. Long lists arise only from long
    episodes, as in the result itself.
    """
    prev = {"_px": F.col("cx"), "_py": F.col("cy"), "_pe": F.col("end")}
    dx, dy = F.col("cx") - F.col("_px"), F.col("cy") - F.col("_py")
    near = (F.sqrt(dx * dx + dy * dy) < max_distance) & (F.col("start") - F.col("_pe") < max_pause)
    rows = island_ids(fixations, [by], ["start", "fixation_id"], prev, ~F.coalesce(near, F.lit(False)), "episode")
    keys = [by, "episode"]
    base = rows.groupBy(*keys).agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.transform(F.array_sort(F.collect_list(F.struct("start", "fixation_id", "caption"))),
                    lambda r: F.struct(r["fixation_id"].alias("id"), r["caption"].alias("caption"))).alias("_r"))
    objects = rows.where(F.coalesce(F.col("object"), F.lit("")) != "").groupBy(*keys, "object").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("start", "fixation_id")).alias("first"))
    best = objects.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "object")).alias("m"))
    others = (rows.select(*keys, "start", "fixation_id", F.posexplode("others").alias("pos", "name"))
              .groupBy(*keys, "name").agg(F.min(F.struct("start", "fixation_id", "pos")).alias("first"))
              .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))),
                                              lambda o: o["name"]).alias("others")))
    return (base.join(best, keys, "left").join(others, keys, "left")
            .select(*keys, "start", "end", (F.col("end") - F.col("start")).alias("duration"),
                    F.transform("_r", lambda r: r["id"]).alias("fixation_ids"),
                    F.transform("_r", lambda r: r["caption"]).alias("captions"),
                    F.col("m.object").alias("object"),
                    F.coalesce("others", F.array().cast("array<string>")).alias("others")))


def saccades(samples: DataFrame, by: str, speed: float, min_seconds: float, spread: float,
             key: str = "sid") -> DataFrame:
    """Runs of fast samples that last long enough and cover enough of the image. samples: by, t, x, y, key."""
    order = ["t", key]
    rows = lag_over(chunked(samples, [by], order), [by], order,
                    {"_t": F.col("t"), "_x": F.col("x"), "_y": F.col("y")})
    dx, dy, dt = F.col("x") - F.col("_x"), F.col("y") - F.col("_y"), F.col("t") - F.col("_t")
    fast = F.coalesce((dt > 0) & (F.sqrt(dx * dx + dy * dy) / dt > speed), F.lit(False))
    rows = running_over(rows.withColumn("_fast", fast), [by], order, {"run": ("sum", (~F.col("_fast")).cast("int"))})
    out = rows.where("_fast").groupBy(by, "run").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("spread"),
        F.count(F.lit(1)).alias("n"))
    return (out.withColumn("duration", F.col("end") - F.col("start"))
            .where((F.col("duration") >= min_seconds) & (F.col("spread") > spread)).drop("run"))


#: A long, slow, wide scan counts as confusion.
CONFUSION = {"speed": 0.01, "min_seconds": 2.5, "spread": 0.1}


def valid_runs(rows: DataFrame, by: Sequence[str], order: Sequence[str], valid: Column) -> DataFrame:
    """Consecutive valid rows share a run number; an invalid row ends the run."""
    marked = rows.withColumn("_ok", valid)
    out = running(marked, by, order, {"run": ("sum", (~F.col("_ok")).cast("int"))})
    return out.where("_ok").drop("_ok")


def page_offsets(docs: DataFrame, order: Sequence[str], pages: str) -> DataFrame:
    """Number of pages before each document, in order of first appearance over the whole table."""
    run = running(docs.withColumn("_all", F.lit(0)), ["_all"], order, {"_upto": ("sum", F.col(pages))})
    return run.withColumn("first_page", F.col("_upto") - F.col(pages)).drop("_upto", "_all")


def graded_pages(docs: DataFrame, evidence: DataFrame, key: str, first: str, pages: str) -> DataFrame:
    """All pages of a query's document score 2, its evidence pages 3; queries without evidence drop out.

    docs: key, first, pages; evidence: key, page (within the document).
    """
    asked = docs.join(evidence.select(key).distinct(), key, "left_semi")
    every = asked.where(F.col(pages) > 0).select(key, F.explode(F.sequence(F.col(first), F.col(first) + F.col(pages) - 1)).alias("page_id"),
                                                 F.lit(2).alias("score"))
    marked = evidence.join(docs, key).select(key, (F.col(first) + F.col("page")).alias("page_id"), F.lit(3).alias("score"))
    return every.unionByName(marked).groupBy(key, "page_id").agg(F.max("score").alias("score"))


def running_accuracy(rows: DataFrame, order: Sequence[str], ok: str) -> DataFrame:
    """Accuracy so far in processing order, over the whole table."""
    out = running(rows.withColumn("_all", F.lit(0)), ["_all"], order,
                  {"n_done": ("sum", F.lit(1).cast("bigint")), "n_right": ("sum", F.col(ok).cast("bigint"))})
    return out.withColumn("accuracy", F.col("n_right") / F.col("n_done")).drop("_all")


def average_ranks(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rank of each distinct value with ties averaged: (by, value, n, avg_rank)."""
    counts = _value_counts(rows, by, value)
    return counts.select(*by, value, F.col("_n").alias("n"),
                         (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias("avg_rank"))


def holm(rows: DataFrame, p: str, key: str) -> DataFrame:
    """Step-down adjustment: running maximum of min(1, (m - i) * p) over sorted p."""
    family = rows.withColumn("_all", F.lit(0))
    m = rows.agg(F.count(F.lit(1)).alias("_m")).withColumn("_all", F.lit(0))
    numbered = row_numbers(family, ["_all"], [p, key]).join(m, "_all")
    raw = F.least(F.lit(1.0), (F.col("_m") - F.col("rn") + 1) * F.col(p))
    return running(numbered, ["_all"], [p, key], {"p_holm": ("max", raw)}).drop("_all", "_m", "rn")
