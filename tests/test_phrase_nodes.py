"""Phrase weights when one entity holds every fact."""

from pyspark.sql import functions as F

from chronoloom.operators import graph_build as B


def test_hot_entities_are_not_gathered(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.range(2000).select((F.col("id") % 500).alias("qid"), F.lit("hot").alias("s"),
                                         F.concat(F.lit("e"), F.col("id").cast("string")).alias("o"), F.lit(0.5).alias("score"))
        nodes = spark.createDataFrame([("hot", 4), ("e7", 1)], "entity string, n_docs bigint")
        out = B.phrase_weights(facts, nodes, 5)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        got = {(r["qid"], r["entity"]): (r["weight"], r["rank"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(q, "hot"): (0.125, 2 if q == 7 else 1) for q in range(500)} | {(7, "e7"): (0.5, 1)}
