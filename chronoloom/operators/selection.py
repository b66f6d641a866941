"""Top-k, thinning, quotas, mixtures and other seeded selections.

Chance is always the order of md5(seed | id), so a selection is repeatable on any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import row_numbers, running


def seeded(seed: str, *ids: Column | str) -> Column:
    """Hash that stands for a random order."""
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary"))


def seeded_uniform(seed: str, *ids: Column | str) -> Column:
    """Number in [0, 1) from the first 32 bits of the seeded hash."""
    return F.conv(F.substring(seeded(seed, *ids), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def topk_by_scale(rows: DataFrame, by: Sequence[str], scale: str, limits: Mapping[str, int],
                  default: int, order: Sequence[Column | str]) -> DataFrame:
    """k best rows per (by, scale), k from a table of scales; ranks above the largest k never shuffle."""
    w = Window.partitionBy(*by, scale).orderBy(*order)
    k = F.lit(default)
    for name, n in limits.items():
        k = F.when(F.col(scale) == name, F.lit(n)).otherwise(k)
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(default, *limits.values()))
    return top.where(F.col("rank") <= k)


def merge_scales(candidates: DataFrame, query: str, item: str, k: int, score: str, choice: str) -> DataFrame:
    """Up to k candidates as they are; else the chooser's items in its order, then the best scores.

    `choice` is the chooser's position of an item or null; a failed chooser is all nulls.
    """
    sized = candidates.join(candidates.groupBy(query).agg(F.count(F.lit(1)).alias("_n")), query)
    use = F.when(F.col("_n") > k, F.col(choice))
    w = Window.partitionBy(query).orderBy(F.coalesce(use, F.lit(1 << 30)), F.desc(score), item)
    return sized.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_n")


def _on_grid(pos: Column, total: Column, cap: Column) -> Column:
    """Is a zero-based position one of the `cap` truncated linspace positions over 0..total-1?"""
    step = (total - 1) / F.greatest(cap - 1, F.lit(1))
    near = F.floor(pos / F.greatest(step, F.lit(1e-12)))

    def hit(i):
        inside = (i >= 0) & (i < cap - 1)
        return inside & (F.floor(i * step) == pos)

    return (pos == 0) | ((cap > 1) & (pos == total - 1)) | hit(near) | hit(near + 1)


def thin(rows: DataFrame, by: Sequence[str], order: Sequence[str], cap: int | Column) -> DataFrame:
    """Keep at most `cap` rows per key, evenly spaced over the whole ordered list."""
    numbered = row_numbers(rows, by, order)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    out = numbered.join(sizes, list(by))
    limit = F.lit(cap) if isinstance(cap, int) else cap
    keep = (F.col("_total") <= limit) | _on_grid(F.col("rn") - 1, F.col("_total"), limit)
    return out.where(keep).drop("_total")


def thin_groups(rows: DataFrame, by: Sequence[str], group: str, order: Sequence[str], cap: int) -> DataFrame:
    """Over the cap: every group keeps max(1, floor(n * cap / total)) evenly spaced rows."""
    groups = rows.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_n"))
    totals = groups.groupBy(*by).agg(F.sum("_n").alias("_all"))
    share = F.when(F.col("_all") > cap, F.greatest(F.lit(1), F.floor(F.col("_n") * (F.lit(float(cap)) / F.col("_all"))))
                   ).otherwise(F.col("_n"))
    sized = rows.join(groups.join(totals, list(by)).withColumn("_cap", share).drop("_all", "_n"), [*by, group])
    return thin(sized, [*by, group], order, F.col("_cap")).drop("_cap")


def quota(rows: DataFrame, strata: Sequence[str], n: int, prefer: Column, seed: str, key: str
          ) -> tuple[DataFrame, DataFrame]:
    """n rows per stratum in seeded order, preferred rows first; and every stratum's shortfall."""
    w = Window.partitionBy(*strata).orderBy(prefer.desc(), seeded(seed, key), key)
    taken = rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("available"))
    short = sizes.withColumn("shortfall", F.greatest(F.lit(n) - F.col("available"), F.lit(0)))
    return taken, short


def with_distractors(clips: DataFrame, targets: DataFrame, n: int, seed: str, key: str,
                     days: str | None = None) -> DataFrame:
    """All targets plus n seeded other clips, from the targets' days only when `days` is given."""
    wanted = targets.select(key).distinct()
    chosen = clips.join(wanted, key, "left_semi").withColumn("is_target", F.lit(True))
    others = clips.join(wanted, key, "left_anti")
    if days:
        others = others.join(chosen.select(days).distinct(), days, "left_semi")
    extra = others.orderBy(seeded(seed, key), key).limit(n).withColumn("is_target", F.lit(False))
    return chosen.unionByName(extra)


def cluster_sample(rows: DataFrame, cluster: str, n: int, seed: str, key: str) -> DataFrame:
    """ceil(n / #clusters) seeded rows per cluster, filled up to n from the rest.

    A table of n rows or fewer is kept whole; rounding up per cluster may give a few rows more than n.
    """
    clusters, total = rows.agg(F.count_distinct(cluster), F.count(F.lit(1))).first()
    if total <= n:
        return rows.withColumn("pick", F.lit(0)).withColumn("filled", F.lit(False))
    per = math.ceil(n / max(1, clusters))
    w = Window.partitionBy(cluster).orderBy(seeded(seed, key), key)
    first = rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= per)
    have = first.count()
    rest = rows.join(first.select(key), key, "left_anti")
    top_up = rest.orderBy(seeded(seed, key), key).limit(max(0, n - have)).withColumn("pick", F.lit(0))
    return first.withColumn("filled", F.lit(False)).unionByName(top_up.withColumn("filled", F.lit(True)))


def mixture(rows: DataFrame, source: str, key: str, weights: Mapping[str, float], batch: int, seed: str,
            stop: str = "first_exhausted") -> DataFrame:
    """Weighted mixture in batches of one source: (slot, pos, source, key).

    A slot's source comes from a seeded number against cumulative weights. `first_exhausted` ends before
    the first slot that finds its source empty; `all_exhausted` wraps until every source was used up once.
    """
    spark = rows.sparkSession
    total = sum(weights.values())
    rows = rows.where(F.col(source).isin(list(weights)))   # so the size table has one row per weight at most
    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("size"))
    n_rows, smallest = sizes.agg(F.sum("size"), F.max("size")).first()

    def schedule(n_slots: int) -> DataFrame:
        u = seeded_uniform(seed, "slot")
        edge, pick = 0.0, None
        for name, w in weights.items():
            edge += w / total
            pick = F.when(u < edge, name) if pick is None else pick.when(u < edge, name)
        slots = spark.range(n_slots).select(F.col("id").alias("slot")).withColumn(
            source, pick.otherwise(list(weights)[-1]))
        turns = running(slots, [source], ["slot"], {"turn": ("sum", F.lit(1))})
        return turns.join(F.broadcast(sizes), source).withColumn("start", (F.col("turn") - 1) * batch)

    n_slots = math.ceil(n_rows / batch) + len(weights)
    plan = schedule(n_slots)
    if stop == "first_exhausted":
        end = plan.where(F.col("start") >= F.col("size")).agg(F.min("slot")).first()[0]
        plan = plan.where(F.col("slot") < (n_slots if end is None else end))
        last_row = F.least(F.col("start") + batch, F.col("size")) - 1
    else:
        while True:
            used = plan.where(F.col("start") + batch >= F.col("size")).groupBy(source).agg(F.min("slot").alias("s"))
            done, end = used.agg(F.count(F.lit(1)), F.max("s")).first()
            if done == len(weights):
                break
            n_slots *= 2
            plan = schedule(n_slots)
        plan = plan.where(F.col("slot") <= end)
        last_row = F.col("start") + batch - 1
    wanted = plan.select("slot", source, "size", "start", F.explode(F.sequence(F.col("start"), last_row)).alias("_at"))
    wanted = wanted.select("slot", source, (F.col("_at") - F.col("start")).alias("pos"),
                           (F.col("_at") % F.col("size") + 1).alias("rn"))
    ordered = row_numbers(rows.select(source, key, seeded(seed, key).alias("_h")), [source], ["_h", key])
    return wanted.join(ordered, [source, "rn"]).select("slot", "pos", source, key)


def uniform_points(clips: DataFrame, key: str, seconds: Column, rate: float, seed: str) -> DataFrame:
    """Control stream: max(1, round(duration * rate)) seeded points in [.15, .85]^2 per clip."""
    n = F.greatest(F.lit(1), F.bround(F.greatest(seconds, F.lit(1.0)) * rate)).cast("int")
    grid = clips.select(key, F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))

    def spot(axis):
        return F.lit(0.15) + F.lit(0.7) * seeded_uniform(seed + axis, key, "i")

    return grid.select(key, (F.col("i") / F.lit(rate)).alias("t"), spot("x").alias("x"), spot("y").alias("y"))


def representative(samples: DataFrame, targets: DataFrame, by: str, key: str, show: int = 6) -> DataFrame:
    """Per clip: the row nearest the target, the two most off-center rows, then evenly spaced ones.

    samples: by, key, t, dist, off; targets: by, target.
    """
    near = samples.join(targets, by).groupBy(by).agg(
        F.min(F.struct(F.abs(F.col("t") - F.col("target")).alias("d"), "t", key)).alias("m"))
    near = near.select(by, F.col(f"m.{key}").alias(key), F.lit(0).alias("prio"))
    w = Window.partitionBy(by).orderBy(F.desc("dist"), "t", key)
    far = samples.where("off").withColumn("prio", F.row_number().over(w)).where("prio <= 2").select(by, key, "prio")
    numbered = row_numbers(samples.select(by, key, "t"), [by], ["t", key])
    sizes = samples.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(show - 1)), lambda k: F.struct(
        (F.bround(k * (F.col("_n") - 1) / (show - 1)) + 1).cast("bigint").alias("rn"), (k + 3).alias("prio")))
    even = (sizes.select(by, F.explode(spots).alias("s")).select(by, "s.rn", "s.prio")
            .join(numbered, [by, "rn"]).select(by, key, "prio"))
    every = near.unionByName(far).unionByName(even).groupBy(by, key).agg(F.min("prio").alias("prio"))
    first = Window.partitionBy(by).orderBy("prio")
    return every.withColumn("pick", F.row_number().over(first)).where(F.col("pick") <= show)


def frames_in_fixations(frames: DataFrame, fixations: DataFrame) -> DataFrame:
    """Frames whose instant lies in a fixation, with the start of the earliest one. frames: clip, frame, ft."""
    from .intervals import tolerance_join
    spans = fixations.select("clip", F.col("start").alias("_s"), F.col("end").alias("_e"))
    pairs = tolerance_join(frames, spans, "ft", ("_s", "_e"), 0.0, 1.0, ["clip"])
    return pairs.groupBy("clip", "frame").agg(F.min("_s").alias("fix_start"))


def refill_frames(fixations: DataFrame, clips: DataFrame, n: int, fps: float) -> DataFrame:
    """n midpoints of equal shares of the covered time, mapped back to frames; repeats appear once.

    clips: clip, total (frames).
    """
    spans = fixations.select("clip", "start", "end", (F.col("end") - F.col("start")).alias("len"))
    run = running(spans, ["clip"], ["start", "end"], {"upto": ("sum", F.col("len"))})
    covered = run.groupBy("clip").agg(F.max("upto").alias("covered"), F.max(F.struct("start", "end")).alias("last"))
    wanted = (covered.where("covered > 0").join(clips, "clip")
              .select("clip", "covered", "last", "total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
              .withColumn("u", F.col("covered") * (F.col("j") + 0.5) / n))
    before = F.col("upto") - F.col("len")
    pairs = wanted.join(run, "clip").where(((F.col("u") > before) | (before <= 0)) & (F.col("u") <= F.col("upto"))
                                           | ((F.col("u") > F.col("upto")) & (F.col("last.start") == F.col("start"))))
    at = F.bround((F.col("start") + F.least(F.col("u") - before, F.col("len"))) * fps)
    idx = F.least(F.greatest(at, F.lit(0)), F.col("total") - 1).cast("bigint")
    return pairs.groupBy("clip", idx.alias("frame")).agg(F.min("start").alias("fix_start"))
