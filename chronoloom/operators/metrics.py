"""Retrieval and answer metrics over (query, rank) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at(hits: DataFrame, gold: DataFrame, ks: Sequence[int], query: str = "qid",
              item: str = "rid") -> DataFrame:
    """Macro recall per k, rounded to 4; a query without gold counts as 0.

    hits: query, item, rank; gold: query, item (all queries appear in `hits`).
    """
    found = hits.join(gold.select(query, item).distinct().withColumn("_g", F.lit(1)), [query, item], "left")
    sizes = gold.select(query, item).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("_n_gold"))
    per = found.groupBy(query).agg(*[
        F.count_distinct(F.when(F.col("_g").isNotNull() & (F.col("rank") <= k), F.col(item))).alias(f"_h{k}")
        for k in ks]).join(sizes, query, "left")
    shares = F.array(*[F.struct(F.lit(k).alias("k"), F.when(
        F.col("_n_gold") > 0, F.col(f"_h{k}") / F.col("_n_gold")).otherwise(0.0).alias("r")) for k in ks])
    return (per.select(F.explode(shares).alias("s")).groupBy("s.k")
            .agg(F.round(F.avg("s.r"), 4).alias("recall")))


def ranking_metrics(hits: DataFrame, gold: DataFrame, queries: DataFrame, ks: Sequence[int],
                    query: str = "qid", item: str = "rid") -> DataFrame:
    """Mean precision, recall, hit, F1, MAP, MRR and nDCG (linear, exponential) per k.

    Empty gold: recall 1, everything else 0. Average precision is divided by min(#gold, k).
    hits: query, item, rank; gold: query, item, rel (graded; unique pairs); queries: query.
    """
    biggest = max(ks)
    top = hits.where(F.col("rank") <= biggest).join(gold, [query, item], "left")
    order = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("rel").isNotNull().cast("int")
    top = top.withColumn("_hit", hit).withColumn("_so_far", F.sum(hit).over(order))

    def gain(rel, pos, kind):
        g = rel.cast("double") if kind == "lin" else F.pow(F.lit(2.0), rel) - 1
        return g / F.log2(pos + F.lit(1.0))

    per = top.groupBy(query).agg(*[c for k in ks for c in (
        F.sum(F.when(F.col("rank") <= k, F.col("_hit"))).alias(f"hits{k}"),
        F.sum(F.when((F.col("rank") <= k) & (F.col("_hit") == 1),
                     F.col("_so_far") / F.col("rank"))).alias(f"ap{k}"),
        F.min(F.when((F.col("rank") <= k) & (F.col("_hit") == 1), F.col("rank"))).alias(f"first{k}"),
        F.sum(F.when((F.col("rank") <= k) & (F.col("_hit") == 1),
                     gain(F.col("rel"), F.col("rank"), "lin"))).alias(f"lin{k}"),
        F.sum(F.when((F.col("rank") <= k) & (F.col("_hit") == 1),
                     gain(F.col("rel"), F.col("rank"), "exp"))).alias(f"exp{k}"))])
    best = Window.partitionBy(query).orderBy(F.desc("rel"), item)
    ideal_rows = gold.withColumn("_p", F.row_number().over(best)).where(F.col("_p") <= biggest)
    ideal = ideal_rows.groupBy(query).agg(*[
        F.sum(F.when(F.col("_p") <= k, gain(F.col("rel"), F.col("_p"), kind))).alias(f"i{kind}{k}")
        for k in ks for kind in ("lin", "exp")])
    sizes = gold.groupBy(query).agg(F.count(F.lit(1)).alias("n_gold"))
    per = (queries.select(query).join(per, query, "left").join(ideal, query, "left")
           .join(sizes, query, "left").fillna(0))

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    lines = []
    for k in ks:
        p = F.col(f"hits{k}") / F.lit(float(k))
        r = F.when(F.col("n_gold") > 0, F.col(f"hits{k}") / F.col("n_gold")).otherwise(1.0)
        lines.append(F.struct(
            F.lit(k).alias("k"), F.when(F.col("n_gold") > 0, p).otherwise(0.0).alias("precision"),
            r.alias("recall"), (F.col(f"hits{k}") > 0).cast("double").alias("hit"),
            F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
            F.when(F.col("n_gold") > 0, F.col(f"ap{k}") / F.least(F.col("n_gold"), F.lit(k)))
            .otherwise(0.0).alias("map"),
            F.when(F.col(f"first{k}") > 0, 1.0 / F.col(f"first{k}")).otherwise(0.0).alias("mrr"),
            ratio(f"lin{k}", f"ilin{k}").alias("ndcg_linear"),
            ratio(f"exp{k}", f"iexp{k}").alias("ndcg_exponential")))
    names = ("precision", "recall", "hit", "f1", "map", "mrr", "ndcg_linear", "ndcg_exponential")
    return (per.select(F.explode(F.array(*lines)).alias("m")).groupBy("m.k")
            .agg(*[F.round(F.avg(f"m.{n}"), 6).alias(n) for n in names]))


def exact_and_f1(predictions: DataFrame, golds: DataFrame, by: Sequence[str], normalize) -> DataFrame:
    """Per answer: exact match and bag-of-tokens F1, each the best over its gold answers.

    predictions: by, answer; golds: by, gold_id, gold. Tokens meet by equi join on (answer, gold, token)
    after both bags are counted.
    """
    def bag(rows, keys, text):
        words = rows.select(*keys, F.explode(F.filter(F.split(text, " "), lambda w: w != "")).alias("w"))
        return words.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("n"))

    p = predictions.select(*by, normalize(F.col("answer")).alias("a"))
    g = golds.select(*by, "gold_id", normalize(F.col("gold")).alias("g"))
    pairs = p.join(g, list(by)).select(
        *by, "gold_id", (F.col("a") == F.col("g")).cast("double").alias("em"),
        F.size(F.filter(F.split("a", " "), lambda w: w != "")).alias("na"),
        F.size(F.filter(F.split("g", " "), lambda w: w != "")).alias("ng"))
    common = (bag(g, [*by, "gold_id"], "g").withColumnRenamed("n", "m")
              .join(bag(p, by, "a"), [*by, "w"])
              .groupBy(*by, "gold_id").agg(F.sum(F.least("n", "m")).alias("same")))
    scored = pairs.join(common, [*by, "gold_id"], "left").withColumn("same", F.coalesce("same", F.lit(0)))
    f1 = F.when(F.col("same") == 0, 0.0).otherwise(2.0 * F.col("same") / (F.col("na") + F.col("ng")))
    return scored.groupBy(*by).agg(F.max("em").alias("em"), F.round(F.max(f1), 6).alias("f1"))
