"""Tables over per-question results: breakdowns, paired counts, votes, merges, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import exact_percentile


def accuracy_breakdown(rows: DataFrame, cond: str, groups: Sequence[str], ok: str) -> DataFrame:
    """Accuracy and n by condition alone and by condition with each grouping column."""
    keys = [F.col(cond), *[F.col(g) for g in groups]]
    sets = [[F.col(cond)], *[[F.col(cond), F.col(g)] for g in groups]]
    out = rows.groupingSets(sets, *keys).agg(
        F.grouping_id(cond, *groups).alias("_gid"), F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col(ok).cast("double")), 6).alias("accuracy"))
    full = (1 << len(groups)) - 1
    kind, value = F.lit("ALL"), F.lit("ALL")
    for i, g in enumerate(groups):
        here = F.col("_gid") == (full ^ (1 << (len(groups) - 1 - i)))
        kind, value = F.when(here, F.lit(g)).otherwise(kind), F.when(here, F.col(g).cast("string")).otherwise(value)
    return out.select(cond, kind.alias("by"), value.alias("value"), "n", "accuracy")


def widen(rows: DataFrame, question: str, arm: str, arms: Sequence[str], value: str) -> DataFrame:
    """One row per question with a column per arm; a single aggregate instead of self joins."""
    return rows.groupBy(question).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(a) for a in arms])


def discordant(wide: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Per arm pair: questions scored by both, only-first and only-second wins, gap in points."""
    lines = [F.struct(F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b"), F.col(a).alias("x"), F.col(b).alias("y"))
             for a, b in combinations(arms, 2)]
    long = wide.select(F.explode(F.array(*lines)).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    return long.groupBy("arm_a", "arm_b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("only_a"),
        F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("only_b"),
        F.round(100 * F.avg((F.col("x") - F.col("y")).cast("double")), 6).alias("gap_points"))


def agreed_vote(votes: DataFrame, by: str, vote: str, default: str) -> DataFrame:
    """The vote of both orders when they agree; otherwise the default arm."""
    out = votes.groupBy(by).agg(F.count(vote).alias("_n"), F.min(vote).alias("_a"), F.max(vote).alias("_b"))
    same = (F.col("_n") >= 2) & (F.col("_a") == F.col("_b"))
    return out.select(by, F.when(same, F.col("_a")).otherwise(default).alias("chosen"), (~same).alias("abstained"))


def seed_summary(rows: DataFrame, cond: str, run: str, question: str, ok: str) -> DataFrame:
    """Mean and sample deviation of per-run accuracy, answers that flip, majority vote for odd run counts."""
    per_run = rows.groupBy(cond, run).agg(F.avg(F.col(ok).cast("double")).alias("acc"))
    acc = per_run.groupBy(cond).agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.avg("acc"), 6).alias("mean"),
                                    F.round(F.stddev_samp("acc"), 6).alias("sd"))
    per_q = rows.groupBy(cond, question).agg(F.avg(F.col(ok).cast("double")).alias("share"),
                                             F.min(ok).alias("lo"), F.max(ok).alias("hi"))
    votes = per_q.groupBy(cond).agg(F.count(F.lit(1)).alias("n_questions"),
                                    F.count_if(F.col("lo") != F.col("hi")).alias("n_flips"),
                                    F.round(F.avg((F.col("share") > 0.5).cast("double")), 6).alias("vote"))
    return (acc.join(votes, cond)
            .withColumn("vote", F.when(F.col("n_runs") % 2 == 1, F.col("vote"))))


def merge_runs(runs: Sequence[DataFrame], keys: Sequence[str], settings: Sequence[str]) -> DataFrame:
    """Union of runs over disjoint questions; raises when a key repeats or the settings differ."""
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r)
    if merged.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"the runs share rows with equal {list(keys)}")
    if settings and merged.select(*settings).distinct().limit(2).count() > 1:
        raise ValueError(f"the runs differ in {list(settings)}")
    return merged


def gate(table: DataFrame, arm: str, value: str, baseline: str, threshold: float) -> DataFrame:
    """Best candidate against the baseline: gain, and whether it reaches the threshold."""
    is_base = F.col(arm) == baseline
    out = table.agg(F.max(F.when(is_base, F.col(value))).alias("base"),
                    F.max(F.when(~is_base, F.struct(F.col(value).alias("v"), F.col(arm).alias("a")))).alias("best"))
    gain = F.col("best.v") - F.col("base")
    return out.select(F.col("best.a").alias("arm"), F.round(gain, 6).alias("gain"), (gain >= threshold).alias("passed"))


#: Rank bands of the report.
BANDS = ((1, 10), (11, 50), (51, 200), (201, None))


def band_of(rank: Column) -> Column:
    out = None
    for lo, hi in BANDS:
        name = f"{lo}+" if hi is None else f"{lo}-{hi}"
        test = F.lit(True) if hi is None else rank <= hi
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def rank_bands(pairs: DataFrame, k: int) -> DataFrame:
    """Per band of the first rank: better, worse, tie, median change; entries to and exits from the top k."""
    rows = pairs.withColumn("band", band_of(F.col("rank_a"))).withColumn("change", F.col("rank_b") - F.col("rank_a"))
    counts = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("change") < 0).alias("better"),
        F.count_if(F.col("change") > 0).alias("worse"), F.count_if(F.col("change") == 0).alias("tie"),
        F.count_if((F.col("rank_a") > k) & (F.col("rank_b") <= k)).alias("entered"),
        F.count_if((F.col("rank_a") <= k) & (F.col("rank_b") > k)).alias("left_top"))
    return counts.join(exact_percentile(rows, ["band"], "change", 0.5, "median_change"), "band")


def frequency_report(rows: DataFrame, name: str, top: int) -> DataFrame:
    """The `top` most frequent names with totals over all names on every row."""
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.count(F.lit(1)).alias("n_names"), F.sum("n").alias("n_total"),
                        F.count_if(F.col("n") == 1).alias("n_single")).withColumn("_one", F.lit(1))
    best = counts.orderBy(F.desc("n"), name).limit(top).withColumn("_one", F.lit(1))
    return best.join(totals, "_one").drop("_one")


def macro_average(rows: DataFrame, split: str, subset: str, metrics: Sequence[str], times: Sequence[str],
                  expected: int) -> DataFrame:
    """Mean of each metric over the subsets, only where all are present; times are summed."""
    out = rows.groupBy(split).agg(F.count_distinct(subset).alias("_n"),
                                  *[F.round(F.avg(m), 6).alias(m) for m in metrics],
                                  *[F.round(F.sum(c), 6).alias(c) for c in times])
    return out.where(F.col("_n") == expected).drop("_n")


def score_report(expected: DataFrame, scores: DataFrame, dataset: str, group: str, experiment: str,
                 experiments: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(value per dataset and experiment with `missing` marks, mean per group over present values)."""
    wide = scores.groupBy(dataset).pivot(experiment, list(experiments)).agg(F.max(value))
    runs = scores.groupBy(dataset).agg(F.lit(True).alias("_known"))
    table = expected.join(wide, dataset, "left").join(runs, dataset, "left")
    pairs = F.array(*[F.struct(F.lit(e).alias("experiment"), F.col(e).alias("value")) for e in experiments])
    long = table.select(dataset, group, "_known", F.explode(pairs).alias("e")).select(
        dataset, group, "e.experiment", "e.value",
        F.when(F.col("e.value").isNotNull(), "present").when(F.col("_known"), "not in experiment")
        .otherwise("no result").alias("state"))
    means = long.groupBy(group, "experiment").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n_present"),
        F.count_if(F.col("state") == "not in experiment").alias("n_absent"),
        F.count_if(F.col("state") == "no result").alias("n_no_result"))
    return long, means


def pooled_effect(wide: DataFrame, base: str, others: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Mean over the other arms minus the baseline, improved/worsened by any, by each grouping set."""
    arms = [F.col(o) for o in others]
    mean = sum(arms[1:], arms[0]) / F.lit(float(len(arms)))
    rows = wide.select(*groups, (mean - F.col(base)).alias("effect"),
                       (F.greatest(*arms) > F.col(base)).alias("up"), (F.least(*arms) < F.col(base)).alias("down"))
    sets = [[], *[[F.col(g)] for g in groups], [F.col(g) for g in groups]]
    out = rows.groupingSets(sets, *[F.col(g) for g in groups]).agg(
        F.grouping_id(*groups).alias("grouping"), F.count(F.lit(1)).alias("n"),
        F.round(F.avg("effect"), 6).alias("effect"), F.count_if("up").alias("n_up"), F.count_if("down").alias("n_down"))
    return out


def headline(tables: DataFrame, table: str, n: str, n_arms: str, pairs: DataFrame) -> DataFrame:
    """Pairs of the table with most questions, then most arms; the winner first, the gap positive."""
    best = tables.agg(F.max(F.struct(n, n_arms, table)).alias("m")).select(F.col(f"m.{table}").alias(table))
    mine = pairs.join(best, table)
    flip = F.col("gap") < 0
    return mine.select(table, F.when(flip, F.col("arm_b")).otherwise(F.col("arm_a")).alias("winner"),
                       F.when(flip, F.col("arm_a")).otherwise(F.col("arm_b")).alias("other"),
                       F.abs("gap").alias("gap"))


def name_pool(rows: DataFrame, single: Column, lists: Sequence[Column], comma: Column) -> DataFrame:
    """Distinct lower-cased, trimmed, non-blank names from one field, several lists and a comma list."""
    everything = F.concat(F.array(single), *lists, F.split(comma, ","))
    clean = F.array_distinct(F.transform(F.filter(everything, lambda n: n.isNotNull()), lambda n: F.lower(F.trim(n))))
    return rows.select(F.explode(F.filter(clean, lambda n: n != "")).alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).alias("n_rows"))


def counts_of(flags: Mapping[str, Column]) -> list[Column]:
    return [F.count_if(c).alias(n) for n, c in flags.items()]
