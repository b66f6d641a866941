"""Nodes, edges and indexes of the entity graph, from (doc, s, p, o) triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_normalize, hash_id
from ..session import cut, small_side


def normalized(triples: DataFrame) -> DataFrame:
    return triples.select("doc", *[entity_normalize(c).alias(c) for c in ("s", "p", "o")])


def fact_edges(triples: DataFrame) -> DataFrame:
    """Every occurrence of (s, o) adds one to both directions; self loops are left out."""
    both = triples.where(F.col("s") != F.col("o")).groupBy("s", "o").agg(F.count(F.lit(1)).alias("n"))
    ways = F.array(F.struct(F.col("s").alias("src"), F.col("o").alias("dst")),
                   F.struct(F.col("o").alias("src"), F.col("s").alias("dst")))
    return (both.select(F.explode(ways).alias("e"), "n").groupBy("e.src", "e.dst")
            .agg(F.sum("n").cast("double").alias("weight")))


def mentions(triples: DataFrame) -> DataFrame:
    """Distinct (doc, entity) pairs; only subjects and objects are entities."""
    return triples.select("doc", F.explode(F.array("s", "o")).alias("entity")).where("entity <> ''").distinct()


def passage_edges(triples: DataFrame) -> DataFrame:
    m = mentions(triples)
    return m.select(F.concat(F.lit("chunk-"), F.col("doc").cast("string")).alias("src"),
                    F.col("entity").alias("dst"), F.lit(1.0).alias("weight"))


def entity_nodes(triples: DataFrame) -> DataFrame:
    return (mentions(triples).groupBy("entity").agg(F.count(F.lit(1)).alias("n_docs"))
            .withColumn("node", hash_id("entity", "entity-")))


def facts(triples: DataFrame) -> DataFrame:
    """Distinct (doc, s, p, o) rows: the fact -> documents index in row form."""
    return triples.select("s", "p", "o", "doc").distinct()


def phrase_weights(top_facts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Per query the k phrases of largest mean (fact score / number of documents of the phrase).

    top_facts: qid, s, o, score; nodes: entity, n_docs. Phrases that are no node drop out. A few entities may hold most phrases,
    so the nodes are broadcast if a count shows that they are few, and the phrases stay where they are.
    """
    phrases = top_facts.select("qid", F.explode(F.array("s", "o")).alias("entity"), "score")
    scored = phrases.join(small_side(cut(nodes.select("entity", "n_docs")), 128), "entity")
    means = scored.groupBy("qid", "entity").agg(F.avg(F.col("score") / F.col("n_docs")).alias("weight"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("weight", 9)), "entity")
    return means.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def graph_info(triples: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Counts of nodes, facts and edges by kind, each from its own aggregate, in one row."""
    def one(df, name):
        return df.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1))

    parts = [one(entity_nodes(triples), "n_phrases"), one(triples.select("doc").distinct(), "n_passages"),
             one(triples.select("s", "p", "o").distinct(), "n_facts"), one(fact_edges(triples), "n_fact_edges"),
             one(passage_edges(triples), "n_passage_edges"), one(synonyms, "n_synonym_edges")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "_k")
    total = F.col("n_fact_edges") + F.col("n_passage_edges") + F.col("n_synonym_edges")
    return (out.withColumn("n_nodes", F.col("n_phrases") + F.col("n_passages"))
            .withColumn("n_edges", total).drop("_k"))
