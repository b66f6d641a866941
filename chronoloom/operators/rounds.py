"""Search in rounds for all open questions at once, and reports over the rounds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .lookups import unseen_top


def round_report(items: DataFrame, by: Sequence[str], order: str, item: str, text: str) -> DataFrame:
    """Per question and round: item count, item list and evidence text in order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"), F.col(text).alias("t"))))
    out = items.groupBy(*by).agg(packed.alias("_p"))
    return out.select(*by, F.size("_p").alias("n_items"),
                      F.array_join(F.transform("_p", lambda p: p["i"]), ",").alias("items"),
                      F.array_join(F.transform("_p", lambda p: p["t"]), "\n").alias("evidence"))


def retrieval_rounds(questions: DataFrame, decide: Callable[[DataFrame, DataFrame, int], DataFrame],
                     memories: Mapping[str, Callable[[DataFrame, int], DataFrame]], k: int,
                     max_rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(state, history). One job per round for all questions that are still open.

    `decide(open, history, round)` adds columns action (`search` or `answer`), memory, search.
    `memories[name](asks, n)` returns (qid, item, score) with the n best items per ask; hits already in
    a question's history are dropped after fetching 2k. A memory that is not known answers the question.
    """
    state = questions.withColumn("action", F.lit("search")).withColumn("rounds", F.lit(0))
    history = questions.sparkSession.createDataFrame([], "qid bigint, round int, memory string, item string, score double, rank int")
    closed = None
    for i in range(1, max_rounds + 1):
        asked = cut(decide(state, history, i))
        search = (F.col("action") == "search") & F.col("memory").isin(list(memories))
        done = asked.where(~search).withColumn("action", F.lit("answer"))
        closed = done if closed is None else closed.unionByName(done, allowMissingColumns=True)
        opened = asked.where(search)
        if opened.limit(1).count() == 0:
            state = opened
            break
        found = None
        for name, find in memories.items():
            hits = find(opened.where(F.col("memory") == name), 2 * k).select(
                "qid", F.col("item").cast("string").alias("item"), "score", F.lit(name).alias("memory"))
            found = hits if found is None else found.unionByName(hits)
        fresh = unseen_top(found, history, ["qid", "memory"], "item", k).withColumn("round", F.lit(i))
        history = cut(history.unionByName(fresh.select(*history.columns)))
        state = cut(opened.withColumn("rounds", F.lit(i)).drop("memory", "search"))
    left = state.withColumn("action", F.lit("limit"))
    final = left if closed is None else closed.unionByName(left, allowMissingColumns=True)
    return final, history
