"""Aggregates over gaze points and fixations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gaze import crop_box
from .ordered import exact_percentile


def grid_counts(points: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Counts on a bins x bins grid over [0, 1]; the fullest cells are marked. At most bins^2 rows."""
    def cell(c):
        return F.least(F.lit(bins - 1), F.floor(F.col(c) * bins).cast("bigint"))

    counts = points.groupBy(cell(x).alias("bx"), cell(y).alias("by_")).agg(F.count(F.lit(1)).alias("n"))
    peak = counts.agg(F.max("n").alias("_peak")).withColumn("_one", F.lit(1))
    return (counts.withColumn("_one", F.lit(1)).join(peak, "_one")
            .withColumn("is_peak", F.col("n") == F.col("_peak")).drop("_one", "_peak"))


def iou_share(points: DataFrame, by: Sequence[str], width: int, height: int, ratio: float,
              least: float) -> DataFrame:
    """Share of crop boxes whose overlap with the centered box (IoU) reaches `least`."""
    box = crop_box(width, height, "x", "y", ratio)
    side = max(1, round(min(width, height) * ratio))
    cx, cy = (width - side) // 2, (height - side) // 2

    def shared(edge, center):
        return F.greatest(F.lit(0), F.least(edge + side, F.lit(center + side)) - F.greatest(edge, F.lit(center)))

    inter = shared(box["x0"], cx) * shared(box["y0"], cy)
    iou = inter / (F.lit(2 * side * side) - inter)
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                   F.round(F.avg((iou >= least).cast("int")), 6).alias("share"))


def fixation_summary(fixations: DataFrame, covered: DataFrame, clips: DataFrame) -> DataFrame:
    """Per parameter value: fixations per clip, durations, covered frames, long ones, empty clips.

    fixations: param, clip, duration; covered: param, clip, share; clips: param, clip.
    """
    per_clip = (clips.join(fixations.groupBy("param", "clip").agg(F.count(F.lit(1)).alias("n_fix")), ["param", "clip"], "left")
                .fillna(0, ["n_fix"]))
    out = per_clip.groupBy("param").agg(F.count(F.lit(1)).alias("n_clips"), F.round(F.avg("n_fix"), 6).alias("mean_per_clip"),
                                        F.count_if(F.col("n_fix") == 0).alias("n_empty"))
    dur = fixations.groupBy("param").agg(F.round(F.avg((F.col("duration") > 3).cast("int")), 6).alias("share_long"))
    cov = covered.groupBy("param").agg(F.round(F.avg("share"), 6).alias("mean_covered"))
    parts = [dur, cov, exact_percentile(per_clip, ["param"], "n_fix", 0.5, "median_per_clip"),
             exact_percentile(fixations, ["param"], "duration", 0.5, "median_duration"),
             exact_percentile(fixations, ["param"], "duration", 0.9, "p90_duration")]
    for p in parts:
        out = out.join(p, "param", "left")
    return out
