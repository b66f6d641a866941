"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the wanted total by its weight. A source may be repeated `max_epochs` times at most:
sources above that are clamped, and what they leave is shared among the others by weight, until none is above.
Documents are then taken by seeded whole and fractional repetitions: a source's documents all get the whole
repetitions of its target; one more goes to those whose seeded hash falls into the first buckets, up to the target,
and in the bucket that straddles it each document gives the same fraction of a repetition.

Nothing but three numbers per round reaches the driver; a source's documents are only summed by hash bucket.
Null texts and texts without a word have size 0 and are taken 0 words; a source without words has target 0.
Null is a source of its own. Rows with equal ids share their hash, so repeated rows are taken alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .text import text_or_empty, words

BUCKETS = 4096


def size_in_words(text: str) -> Column:
    return F.size(words(text_or_empty(text))).cast("bigint")


def water_fill(sources: DataFrame, total: Column | str, max_epochs: float) -> DataFrame:
    """Adds `target` to sources (weight, size). `total` is an aggregate over them; positive weights."""
    cap = F.col("size") * F.lit(float(max_epochs))
    rows = cut(sources.withColumn("_cap", cap).withColumn("_full", F.lit(False)))
    wanted = rows.agg(total if isinstance(total, Column) else F.expr(total)).first()[0]
    wanted = float(wanted or 0)
    while True:
        free, clamped = rows.agg(F.sum(F.when(~F.col("_full"), F.col("weight").cast("double"))),
                                 F.sum(F.when(F.col("_full"), F.col("_cap")))).first()
        level = max(0.0, wanted - (clamped or 0.0)) / free if free else 0.0
        above = ~F.col("_full") & (F.col("weight") * F.lit(level) > F.col("_cap"))
        if not free or not rows.where(above).limit(1).count():
            share = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("weight") * F.lit(level))
            return rows.withColumn("target", share.cast("double")).drop("_cap", "_full")
        rows = cut(rows.withColumn("_full", F.col("_full") | above))


def repetition_plan(docs: DataFrame, key: str, source: str, size: Column, weights, total: str, max_epochs: float,
                    seed: int) -> DataFrame:
    """`docs` as struct `doc` beside size, source_size, target, whole (repetitions of every document) and part (what
    this document adds, 0 to 1). `weights` maps the source table (source, size) to one with a weight."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8),
                   16, 10).cast("bigint") % BUCKETS
    # The source travels as a struct that is never null, so that null is joined like any other source.
    rows = docs.select(F.struct("*").alias("doc"), size.alias("size"), place.alias("bucket"),
                       F.concat_ws("", F.when(F.col(source).isNull(), "0").otherwise("1"), F.col(source)).alias("sid"))
    summed = cut(rows.groupBy("sid", "bucket").agg(F.sum("size").alias("size")))
    sources = summed.groupBy("sid").agg(F.sum("size").alias("size"))
    filled = water_fill(weights(sources), total, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = (filled.withColumnRenamed("size", "source_size").withColumn("whole", F.floor(epochs + 1e-12))
            .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
            .select("sid", "source_size", "target", "whole", "rest"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    part = F.when(F.col("size") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("rest") - F.col("before")) / F.col("size"))))
    parts = (summed.withColumn("before", before).join(plan, "sid")
             .select("sid", "bucket", "source_size", "target", "whole", F.coalesce(part, F.lit(0.0)).alias("part")))
    return rows.join(parts, ["sid", "bucket"]).drop("bucket")


def cyclic_weights(cycle: list[int]):
    """Weights by the code-point order of the sources, null last. One small row per source is ordered."""
    def add(sources: DataFrame) -> DataFrame:
        order = Window.orderBy(F.desc(F.substring("sid", 1, 1)), "sid")
        nth = (F.row_number().over(order) - 1) % len(cycle)
        return sources.withColumn("weight", F.element_at(F.array(*[F.lit(c) for c in cycle]), (nth + 1).cast("int")))
    return add


def taken_words() -> Column:
    return (F.col("whole") * F.col("size") + F.floor(F.col("part") * F.col("size") + 0.5)).cast("bigint")


def mix(docs: DataFrame, key: str, source: str, text: str, weights, total: str = "1.5 * sum(size)",
        max_epochs: float = 2, seed: int = 7) -> DataFrame:
    """The mixed documents, all columns, each repeated as often as the plan takes it as a whole. In the bucket
    that straddles a target a document is repeated if its fraction is a half or more."""
    plan = repetition_plan(docs, key, source, size_in_words(text), weights, total, max_epochs, seed)
    times = (F.col("whole") + F.when(F.col("part") >= 0.5, 1).otherwise(0)).cast("int")
    return plan.where(times > 0).select(F.explode(F.array_repeat("doc", times)).alias("doc")).select("doc.*")
