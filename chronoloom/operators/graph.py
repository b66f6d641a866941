"""Iterative graph work as DataFrame loops: personalized PageRank and connected components.

Every loop cuts its lineage with a reliable checkpoint, so a lost executor costs one step, not all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, saved, shuffles_dropped, small_side
from .rank_blocks import MOST_QUERIES, block_ranks, numbered, undirected


def personalized_pagerank(edges: DataFrame, reset: DataFrame, damping: float, steps: int = 1000,
                          tol: float = 1e-9, cut_every: int = 5) -> DataFrame:
    """(qid, node, score) for all queries at once.

    edges: src, dst, weight, every undirected edge in both directions (parallel rows add up).
    reset: qid, node, mass; null, NaN and negative masses count as 0, the rest is scaled to sum 1.
    A node without edges sends its mass back to the reset vector. Power iteration from the reset vector;
    it stops when no query moved more than `tol` in total between two cuts. If that is not reached in `steps`
    steps it raises; with `tol` 0 exactly `steps` steps are taken. Up to MOST_QUERIES queries on a graph that is undirected indeed
    go by blocks of edges (`rank_blocks`), in fewer steps to the same ranks.
    """
    mass = F.when(F.col("mass").isNull() | F.isnan(F.col("mass").cast("double")) | (F.col("mass") < 0), 0.0
                  ).otherwise(F.col("mass").cast("double"))
    seeds = reset.groupBy("qid", "node").agg(F.sum(mass).alias("m")).where("m > 0")
    if tol > 0 and 0 < damping < 1:
        with shuffles_dropped(edges.sparkSession):
            seeds, _ = saved(seeds, "rank-masses")
            few = seeds.select("qid").distinct().limit(MOST_QUERIES + 1).count()
            half = undirected(edges) if 0 < few <= MOST_QUERIES else None
            names = None if half is None else numbered(edges, seeds)
            if names is not None:
                totals = seeds.groupBy("qid").agg(F.sum("m").alias("_t"))
                shares = seeds.join(small_side(totals, 64), "qid").select("qid", "node", (F.col("m") / F.col("_t")).alias("r"))
                return block_ranks(half, shares, names, damping, steps, tol)
    pairs = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    # The loop runs on numbers instead of node names.
    named = seeds.select("node").union(pairs.select("src")).union(pairs.select("dst")).distinct()
    named = cut(named.withColumn("id", F.monotonically_increasing_id()))
    totals = seeds.groupBy("qid").agg(F.sum("m").alias("_t"))
    seeds = (seeds.join(totals, "qid").join(named, "node")
             .select("qid", F.col("id").alias("node"), (F.col("m") / F.col("_t")).alias("r")))
    out = pairs.groupBy("src").agg(F.sum("w").alias("_out"))
    links = cut(pairs.join(out, "src").where("_out > 0")
                .join(named.select(F.col("node").alias("src"), F.col("id").alias("_s")), "src")
                .join(named.select(F.col("node").alias("dst"), F.col("id").alias("_d")), "dst")
                .select(F.col("_s").alias("node"), F.col("_d").alias("dst"), (F.col("w") / F.col("_out")).alias("share")))
    # Mass only travels along edges, so a node without edges can hold mass only as a seed. What it sends
    # back is one number per query with a simple recurrence; the loop never has to look for such nodes.
    lonely = (seeds.join(links.select("node").distinct(), "node", "left_anti").groupBy("qid")
              .agg(F.sum("r").alias("lone")))
    seeds = cut(seeds.join(lonely, "qid", "left").fillna(0.0, ["lone"]))
    state, checked = seeds.select("qid", "node", F.col("r").alias("p")), None
    sent_back = F.col("lone")
    for i in range(1, steps + 1):
        kept = F.lit(1 - damping) + F.lit(damping) * sent_back
        back = seeds.select("qid", "node", (F.col("r") * kept).alias("x"))
        sent_back = F.col("lone") * kept
        moved = state.join(links, "node").select("qid", F.col("dst").alias("node"),
                                                 (F.col("p") * F.col("share") * damping).alias("x"))
        state = moved.unionByName(back).groupBy("qid", "node").agg(F.sum("x").alias("p"))
        if i % cut_every == 0 or i == steps:
            state = cut(state)
            if tol > 0 and checked is not None:
                change = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
                most = (state.join(checked.withColumnRenamed("p", "old"), ["qid", "node"], "full")
                        .groupBy("qid").agg(F.sum(change).alias("d")).agg(F.max("d")).first()[0])
                if most is None or most < tol:
                    break
            checked = state
    else:
        if tol > 0:
            raise RuntimeError(f"the ranks still moved by more than {tol} after {steps} steps")
    return state.withColumnRenamed("node", "id").join(named, "id").select("qid", "node", F.col("p").alias("score"))


def passages_by_ppr(edges: DataFrame, phrases: DataFrame, passages: DataFrame, passage_weight: float,
                    k: int, damping: float = 0.5, **loop) -> DataFrame:
    """k best passages per query; reset = phrase weights plus a small share of the passage scores.

    phrases: qid, node, weight; passages: qid, node, score (node ids of passages).
    """
    reset = phrases.select("qid", "node", F.col("weight").alias("mass")).unionByName(
        passages.select("qid", "node", (F.col("score") * passage_weight).alias("mass")))
    ranked = personalized_pagerank(edges, reset, damping, **loop)
    only = ranked.where(F.col("node").startswith("chunk-"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "node")
    return only.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def triples_by_ppr(triples: DataFrame, similar: DataFrame, k: int, damping: float = 0.85, **loop) -> DataFrame:
    """k best triples per query by the summed PageRank of their ends.

    triples: tid, s, o; similar: qid, tid, score (top similar triples, which seed the walk uniformly).
    Parallel edges count, self loops do not. Queries whose triples name no entity keep the similar triples.
    """
    spark = triples.sparkSession
    ways = F.array(F.struct(F.col("s").alias("src"), F.col("o").alias("dst")),
                   F.struct(F.col("o").alias("src"), F.col("s").alias("dst")))
    with shuffles_dropped(spark):
        similar, _ = saved(similar, "similar-triples")
        pairs, _ = saved(triples.groupBy("s", "o").agg(F.count(F.lit(1)).alias("n")), "triple-ends")
        seeds, _ = saved(triples.join(small_side(similar.select("qid", "tid"), 64), "tid").select("qid", F.explode(F.array("s", "o")).alias("node"))
                         .where("node <> ''").distinct().withColumn("mass", F.lit(1.0)), "triple-seeds")
        edges = pairs.where("s <> '' AND o <> '' AND s <> o").select(F.explode(ways).alias("e"), F.col("n").cast("double").alias("weight"))
        ranks, _ = saved(personalized_pagerank(edges.select("e.src", "e.dst", "weight"), seeds, damping, **loop), "triple-ranks")
        # Triples with equal ends score alike, so scores are summed once per pair of ends, not per triple.
        top_pairs, _ = saved(_best_pairs(pairs.select("s", "o"), ranks, k), "triple-top")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "tid")
    walked = triples.join(small_side(top_pairs, 256), ["s", "o"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    walked = walked.select("qid", "tid", "score", "rank", F.lit("walk").alias("source"))
    plain = similar.join(seeds.select("qid").distinct(), "qid", "left_anti")
    ws = Window.partitionBy("qid").orderBy(F.desc("score"), "tid")
    plain = plain.withColumn("rank", F.row_number().over(ws)).where(F.col("rank") <= k)
    return walked.unionByName(plain.select("qid", "tid", "score", "rank", F.lit("similar").alias("source")))


def _best_pairs(pairs: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """(qid, s, o, score): the pairs of the k best summed scores of each query, with all that tie.

    A node's scores are lists with a place per query, MOST_QUERIES of them to a list, so that the sums are made within a row and
    only the best pairs of each task are shuffled.
    """
    numbers, _ = saved(ranks.select("qid").distinct().withColumn("_n", F.row_number().over(Window.orderBy("qid")) - 1), "rank-queries")
    held = MOST_QUERIES
    slots = small_side(numbers.select("qid", F.floor(F.col("_n") / held).alias("_g"), (F.col("_n") % held).alias("_at")), 64)
    entries = ranks.where("node IS NOT NULL").join(slots, "qid").groupBy("node", "_g").agg(F.map_from_entries(F.collect_list(F.struct("_at", "score"))).alias("_m"))
    width = min(held, numbers.count())
    lists, _ = saved(entries.select("node", "_g", F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda i: F.try_element_at("_m", i)).alias("_p")), "rank-lists")
    few = small_side(lists, 64 + 16 * width)
    at = [few.select(F.col("node").alias(c), "_g", F.col("_p").alias(f"_p{c}")) for c in "so"]
    asked = pairs.crossJoin(small_side(lists.select("_g").distinct(), 64))
    both = asked.join(at[0], ["s", "_g"], "left").join(at[1], ["o", "_g"], "left").where("_ps IS NOT NULL OR _po IS NOT NULL")
    none = F.array_repeat(F.lit(None).cast("double"), width)
    total = F.zip_with(F.coalesce("_ps", none), F.coalesce("_po", none), lambda a, b: F.coalesce(a + b, a, b))
    scored = both.select("s", "o", "_g", F.posexplode(total).alias("_at", "score")).where("score IS NOT NULL").join(slots, ["_g", "_at"])
    by_score = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)))
    return scored.select("qid", "s", "o", "score").withColumn("_r", F.dense_rank().over(by_score)).where(F.col("_r") <= k).drop("_r")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node id reachable.

    Alternating large-star and small-star steps; each is one group minimum and one join, and a hot node
    only ever sends its neighbours to its minimum. Stops when the edge set no longer changes.
    """
    e = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct()
    e = cut(e)
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .where("a <> b").distinct())
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        kept = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(kept.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
