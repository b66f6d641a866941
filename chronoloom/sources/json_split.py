"""One large JSON file read by many tasks: the objects of a top-level array or map as rows.

The text source splits files by bytes and records by `}`, so every object ends where a piece ends, if that brace
lies outside of strings and closes the object that a member is. Both are sums over the pieces before: the number of
quotes (odd: inside a string) and the nesting depth. Each block of a file is summed up on its own, a table with one
row per block (and depth) carries the sums across, and windows inside a block, which is never larger than a split of
the scan, do the rest. No file and no list of members is ever one row; a single member is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What may stand before a member, and the last piece of a whole file, by the kind of the top level.
LEAD = {"array": r"^\s*[\[,]\s*(?=\{)", "map": r'^\s*[{,]\s*(?=")'}
TAIL = {"array": r"^\s*(\[\s*)?\]\s*$", "map": r"^\s*(\{\s*)?$"}


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the text between closing braces; `at` is the order inside a block."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def _plain(value: Column | str) -> Column:
    """Without escaped characters: all quotes that are left open or close a string."""
    return F.regexp_replace(value, r"(?s)\\.", "")


def _before(total: str, by: Sequence[str]) -> Column:
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(earlier), F.lit(0))


def members(parts: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
    """(by, pos, value): the objects of each file's top-level array (`kind` "array"), or its `"key": {...}` entries ("map").

    parts: `pieces`, with `by` (which holds `file`) naming a file. `pos` counts from 0. Files that end too early, have
    unbalanced brackets or anything but objects between the members fail the read and are named. Files without bytes
    have no members.
    """
    here = [*by, "block"]
    inside = Window.partitionBy(*here).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wrong = F.raise_error(F.concat(F.lit("malformed JSON in "), F.col("file")))

    counted = parts.withColumn("_quotes", F.regexp_count(_plain("value"), F.lit('"')).cast("bigint"))
    quotes = counted.groupBy(*here).agg(F.sum("_quotes").alias("_q"))
    quotes = quotes.select(*here, _before("_q", by).alias("_q0"))

    # Outside of strings: a piece that starts inside one gets the quote that it lacks.
    seen = F.col("_q0") + F.sum("_quotes").over(inside)
    nested = counted.join(quotes, here).withColumn("_seen", seen)
    opened = F.when((F.col("_seen") - F.col("_quotes")) % 2 == 1, '"').otherwise("")
    bare = F.regexp_replace(F.concat(opened, _plain("value")), r'"[^"]*+("|$)', "")
    closes = F.col("_seen") % 2 == 0            # the brace that ends the piece lies outside of strings
    step = F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]")) - closes.cast("int")
    nested = (nested.withColumn("_closes", closes).withColumn("_step", step.cast("bigint"))
              .withColumn("_depth", F.sum("_step").over(inside)))

    # Per block: its depth, and how many braces close at each depth, counted from the block's start.
    at_depth = nested.groupBy(*here, "_depth").agg(
        F.sum("_step").alias("_d"), F.sum(F.col("_closes").cast("bigint")).alias("_n"),
        F.max(F.struct("at", "value", "_closes")).alias("_last"))
    blocks = at_depth.groupBy(*here).agg(F.sum("_d").alias("_d"), F.max("_last").alias("_last"))
    whole = Window.partitionBy(*by)
    ends = F.max(F.struct("block", "_last")).over(whole)["_last"]
    # The text source adds a brace after the last piece, unless the file ends with one.
    total = F.sum("_d").over(whole)
    sound = ends["_closes"] & ends["value"].rlike(TAIL[kind]) & (total.isin(-1) if kind == "array" else total.isin(0, -1))
    blocks = blocks.select(*here, F.when(sound, _before("_d", by)).otherwise(wrong).alias("_d0"))
    ended = at_depth.join(blocks, here).where("_d0 + _depth = 1").groupBy(*here).agg(F.sum("_n").alias("_n"))
    starts = blocks.join(ended, here, "left").select(*here, "_d0", _before("_n", by).alias("_n0"))

    rows = nested.join(starts, here).withColumn("_end", F.col("_closes") & (F.col("_d0") + F.col("_depth") == 1))
    upto = F.col("_n0") + F.sum(F.col("_end").cast("bigint")).over(inside)
    rows = rows.withColumn("pos", upto - F.col("_end").cast("bigint"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "}")
    found = rows.groupBy(*by, "pos").agg(F.concat(text, F.lit("}")).alias("_text"), F.max("_end").alias("_end")).where("_end")
    # What follows the last member is no member: null, should a condition on the value be tried before `_end`.
    value = (F.when(~F.col("_end"), F.lit(None)).when(F.col("_text").rlike(LEAD[kind]), F.regexp_replace("_text", LEAD[kind], ""))
             .otherwise(wrong))
    return found.select(*by, "pos", value.alias("value"))
