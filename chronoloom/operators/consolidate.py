"""Consolidation of semantic triples over time, kept as a table of versions.

Every row has the stamp from which it holds and the stamp at which it was superseded, so a snapshot is a filter. A stamp
appends what it opens and what it closes; rows that it does not touch are not written again, and their vectors are made once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import hooks
from ..session import cut, forget, saved, scratch, shuffles_dropped, small_side
from .neighbours import RELEVANT_SCORE, RELEVANT_TOP, relevant_by_vector
from .ordered import row_numbers

KEY = ["s", "p", "o", "evidence"]


def same_subject_rule(pairs: DataFrame) -> DataFrame:
    """Default decision: a relevant older triple with the same subject and predicate is superseded.

    In: new_id, old_id and both triples, with the numbers `new_row` and `old_row`. Out: the pairs to remove.
    """
    return pairs.where((F.col("ns") == F.col("s")) & (F.col("np") == F.col("p")))


def consolidate_versions(triples: DataFrame, decide: Callable[[DataFrame], DataFrame] = same_subject_rule,
                         encoder: hooks.Encoder = hooks.hashed_words, top: int = RELEVANT_TOP,
                         least: float = RELEVANT_SCORE) -> DataFrame:
    """(s, p, o, evidence, valid_from, valid_to), valid_to null while a row holds. triples: ts (string), s, p, o, evidence (array<string>).

    Stamps are taken in string order; the driver knows one at a time. A new triple takes over the evidence of what it
    replaces. Every equal copy goes. Equal new triples of one stamp enter once, with the smallest of their evidence lists.
    Triples are written once, each file in stamp order, so that a stamp reads its own pages only. Neighbours are looked for once per
    different vector. Evidence that is taken over is kept once per different set of replaced triples, and rows only name their set;
    the lists are put together where they are asked for.
    """
    spark = triples.sparkSession
    with shuffles_dropped(spark):
        return _versions(triples, decide, encoder, top, least)


def _versions(triples: DataFrame, decide: Callable[[DataFrame], DataFrame], encoder: hooks.Encoder, top: int, least: float) -> DataFrame:
    spark, text = triples.sparkSession, F.concat_ws(" ", "s", "p", "o")
    waiting, _ = saved(triples.where("ts IS NOT NULL").groupBy("ts", "s", "p", "o").agg(F.min("evidence").alias("evidence"))
                       .sortWithinPartitions("ts"), "triples-by-stamp")
    opened, closed, sets, vectors = (scratch(spark, f"triples-{n}") for n in ("opened", "closed", "sets", "vectors"))
    kinds = {c: waiting.schema[c].dataType.simpleString() for c in KEY}
    empty = spark.createDataFrame([], "row bigint, " + ", ".join(f"{c} {kinds[c]}" for c in KEY) + ", key string, set string, valid_from string, valid_to string, more array<string>")
    empty.select("row", *KEY, "key", "set", "valid_from").write.parquet(opened)
    empty.select("row", "valid_from", "valid_to").write.parquet(closed)
    empty.select("set", "more").write.parquet(sets)

    def with_evidence(rows: DataFrame) -> DataFrame:
        """Rows with their whole evidence in place of their own and the name of a set."""
        both = F.array_sort(F.array_distinct(F.concat("evidence", "more")))
        taken = rows.where("set IS NOT NULL").join(spark.read.parquet(sets), "set").withColumn("evidence", both).drop("set", "more")
        return rows.where("set IS NULL").drop("set").unionByName(taken)

    def ended() -> DataFrame:
        return small_side(spark.read.parquet(closed), 64)

    ts, first = waiting.agg(F.min("ts")).first()[0], True
    while ts is not None:
        fresh = waiting.where(F.col("ts") == ts).select(text.alias("new_id"), *KEY)
        # A vector is known by a hash of its numbers, so that rows do not carry it through the joins.
        key = F.md5(F.array_join(F.col("vec").cast("array<string>"), ",", "null"))
        new, new_at = saved(hooks.encode(fresh, "new_id", "vec", encoder).withColumn("key", key)
                            .withColumn("new_row", F.monotonically_increasing_id()), "triples-new")
        own, own_at = saved(new.select("key", "vec").dropDuplicates(["key"]), "triples-own")
        passing, gone = [new_at, own_at], None
        if not first:
            old = spark.read.parquet(opened).join(ended(), ["row", "valid_from"], "left_anti").withColumn("old_id", F.md5(text))
            known = spark.read.parquet(vectors)
            near, near_at = saved(relevant_by_vector(own.select(F.col("key").alias("query"), F.col("vec").alias("qvec")), known, old, "old_id", top, least)
                                  .select(F.col("query").alias("key"), "old_id"), "triples-near")
            listed, listed_at = saved(old.join(small_side(near.select("old_id").distinct(), 96), "old_id").drop("key")
                                      .withColumn("old_row", F.monotonically_increasing_id()), "triples-listed")
            whole = with_evidence(listed)
            pairs = (new.select("key", "new_id", "new_row", F.col("s").alias("ns"), F.col("p").alias("np"), F.col("o").alias("no"))
                     .join(near.join(whole.drop("row", "valid_from"), "old_id"), "key").drop("key"))
            picked = decide(pairs).groupBy("new_row").agg(F.sort_array(F.collect_set("old_row")).alias("rows"))
            name = F.md5(F.concat_ws(",", F.lit(ts), F.col("rows").cast("array<string>")))
            gone, gone_at = saved(picked.withColumn("set", name), "triples-gone")
            members, members_at = saved(gone.select("set", "rows").dropDuplicates(["set"]).select("set", F.explode("rows").alias("old_row"))
                                        .join(whole, "old_row"), "triples-members")
            copies = (whole.join(members.select(*KEY).distinct(), KEY, "left_semi").select("row", "valid_from").distinct()
                      .withColumn("valid_to", F.lit(ts)))
            members.select("set", F.explode("evidence").alias("e")).groupBy("set").agg(F.collect_set("e").alias("more")).write.mode("append").parquet(sets)
            copies.write.mode("append").parquet(closed)
            own = own.join(known.select("key"), "key", "left_anti")
            passing += [near_at, listed_at, gone_at, members_at]
        rows = new.select(F.col("new_row").alias("row"), *KEY, "key")
        if first:
            rows = rows.withColumn("set", F.lit(None).cast("string"))
        else:
            named = gone.join(spark.read.parquet(sets).select("set"), "set").select(F.col("new_row").alias("row"), "set")
            rows = rows.withColumn("evidence", F.array_sort(F.array_distinct("evidence"))).join(named, "row", "left")
        rows.withColumn("valid_from", F.lit(ts)).select("row", *KEY, "key", "set", "valid_from").write.mode("append").parquet(opened)
        own.write.mode("append").parquet(vectors)
        forget(spark, *passing)
        ts, first = waiting.where(F.col("ts") > ts).agg(F.min("ts")).first()[0], False
    return with_evidence(spark.read.parquet(opened).drop("key").join(ended(), ["row", "valid_from"], "left")).select(*KEY, "valid_from", "valid_to")


def holds_at(ts: Column) -> Column:
    """Whether a version is part of the snapshot at `ts`."""
    return (F.col("valid_from") <= ts) & (F.col("valid_to").isNull() | (F.col("valid_to") > ts))


def snapshots(versions: DataFrame, stamps: DataFrame) -> DataFrame:
    """(ts, s, p, o, evidence): the snapshots at all `stamps` (ts); each version is listed for the stamps at which it holds.

    The versions' own stamps must be among them. Other columns of the versions stay as they are.
    """
    kept = [c for c in versions.columns if c not in ("valid_from", "valid_to")]
    numbered = small_side(cut(row_numbers(stamps.select("ts").distinct(), [], ["ts"], "no")), 64)
    last = numbered.agg(F.max("no").alias("_last"))
    ends = (versions.join(numbered.select(F.col("ts").alias("valid_from"), F.col("no").alias("_from")), "valid_from")
            .join(numbered.select(F.col("ts").alias("valid_to"), F.col("no").alias("_to")), "valid_to", "left").join(F.broadcast(last)))
    upto = F.coalesce(F.col("_to") - 1, F.col("_last"))
    listed = ends.withColumn("no", F.explode(F.sequence("_from", upto)))
    return listed.select("no", *kept).join(numbered, "no").select("ts", *kept)


def consolidate(triples: DataFrame, decide: Callable[[DataFrame], DataFrame] = same_subject_rule,
                encoder: hooks.Encoder = hooks.hashed_words, top: int = RELEVANT_TOP,
                least: float = RELEVANT_SCORE) -> DataFrame:
    """All snapshots (ts, s, p, o, evidence) of `consolidate_versions`."""
    return snapshots(consolidate_versions(triples, decide, encoder, top, least), triples.select("ts"))
