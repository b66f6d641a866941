"""Unions, differences and de-duplication of lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged_union(parts: Mapping[str, DataFrame], tag: str, order: Sequence[str] = ()) -> DataFrame:
    """Union of same-shaped tables with a literal tag column, ordered if asked."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return out.orderBy(*order) if order else out


def candidate_corpus(lists: DataFrame, corpus: DataFrame, query: str, pos: str, name: str, item: str,
                     after: int) -> DataFrame:
    """First occurrence of each name over all candidate lists, then over the corpus."""
    every = lists.select(query, pos, name, item).unionByName(
        corpus.select(F.lit(after).cast("bigint").alias(query), pos, name, item))
    first = every.groupBy(name).agg(F.min(F.struct(query, pos, item)).alias("m"))
    return first.select(name, F.col(f"m.{item}").alias(item), F.col(f"m.{query}").alias("first_query"))


def distinct_queries(queries: DataFrame, qid: str, order: str, text: str) -> DataFrame:
    """Trimmed, non-empty query texts of a question, the first of equal ones kept."""
    clean = queries.withColumn(text, F.trim(text)).where(F.col(text) != "")
    rest = [c for c in clean.columns if c not in (qid, text)]
    first = clean.groupBy(qid, text).agg(F.min_by(F.struct(*rest), order).alias("m"))
    return first.select(qid, text, *[F.col(f"m.{c}").alias(c) for c in rest])


def only_in_deleted(rows: DataFrame, deleted: DataFrame, doc: str, item: Sequence[str]) -> DataFrame:
    """Items that no remaining document uses; one aggregate counts both sides."""
    marked = rows.join(deleted.select(doc).distinct().withColumn("_gone", F.lit(True)), doc, "left")
    alive = F.max(F.col("_gone").isNull().cast("int"))
    return marked.groupBy(*item).agg(alive.alias("_alive")).where("_alive = 0").drop("_alive")


def replace_pairs(state: DataFrame, removals: DataFrame, additions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every row equal to a removal goes, equal copies included; then the additions are appended."""
    return state.join(removals.select(*key).distinct(), list(key), "left_anti").select(*state.columns).unionByName(
        additions.select(*state.columns))


def varying(rows: DataFrame, question: str, cond: str, ok: str) -> DataFrame:
    """Questions whose correctness differs across conditions, with the winning conditions."""
    out = rows.groupBy(question).agg(
        F.count(F.lit(1)).alias("n"), F.sum(ok).cast("bigint").alias("n_right"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col(ok) == 1, F.col(cond)))), "+").alias("winners"))
    return out.where((F.col("n_right") > 0) & (F.col("n_right") < F.col("n")))
