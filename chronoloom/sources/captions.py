"""Readers for captions, transcripts and semantic snapshots."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_split import members, pieces

CAPTION = "text string, start_time string, end_time string, date string, video_path string"
#: The known time scales.
SCALES = ("30sec", "3min", "10min", "1h")


def _parsed(text: Column, kind: str) -> Column:
    """The value of a JSON text, null for null; a malformed one fails the read and its file is named, instead of giving no rows."""
    wrong = F.raise_error(F.concat(F.lit("malformed JSON in "), F.col("file")))
    return F.when(text.isNotNull(), F.coalesce(F.from_json(text, kind), wrong))


def read_captions(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """JSON arrays of captions, one file per recording and scale; unknown scales are skipped.

    The id is `{scale}_{position in the array}`. Large files are split: a row is one caption, never a file.
    """
    parts = [pieces(spark, path).withColumn("granularity", F.lit(scale)) for scale, path in paths.items() if scale in SCALES]
    found = members(reduce(DataFrame.unionByName, parts), ["granularity", "file"], "array")
    caption = _parsed(F.concat(F.lit("["), "value", F.lit("]")), f"array<struct<{_inline(CAPTION)}>>")[0]
    return found.withColumn("c", caption).select(
        "file", "granularity", "pos", F.concat(F.col("granularity"), F.lit("_"), F.col("pos").cast("string")).alias("id"), "c.*")


def _inline(ddl: str) -> str:
    return ", ".join(part.strip().replace(" ", ": ", 1) for part in ddl.split(","))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Maps time -> triples, one JSON object per file; triples of fewer than three parts are dropped.

    The id keeps the position before the drop. Large files are split: a row is one snapshot, until its triples are exploded.
    """
    kind = "map<string, struct<consolidated_semantic_triples: array<array<string>>>>"
    entries = members(pieces(spark, path), ["file"], "map")
    maps = entries.select(_parsed(F.concat(F.lit("{"), "value", F.lit("}")), kind).alias("m"))
    rows = maps.select(F.explode("m").alias("ts", "v")).select(
        "ts", F.posexplode("v.consolidated_semantic_triples").alias("pos", "t"))
    rows = rows.where(F.size("t") >= 3)
    return rows.select(F.col("ts").cast("bigint").alias("ts"), F.concat_ws("_", F.lit("semantic"), "ts", F.col("pos").cast("string")).alias("id"),
                       F.col("t")[0].alias("s"), F.col("t")[1].alias("p"), F.col("t")[2].alias("o"))


def read_dense_captions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; start and end are the last two `-` fields of `custom_id`."""
    rows = spark.read.schema("custom_id string, translated_text string").json(path)
    fields = F.split("custom_id", "-")
    return rows.select("custom_id", F.element_at(fields, -2).cast("int").alias("start"), F.element_at(fields, -1).cast("int").alias("end"),
                       F.col("translated_text").alias("text"), F.lit("caption").alias("type"))


#: Fixed value: the time line of a subtitle block.
BLOCK_TIME = r"(\d+):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})"


def _srt_seconds(value: Column, first: int) -> Column:
    part = [F.regexp_extract(value, BLOCK_TIME, first + i).try_cast("int") for i in range(4)]
    return part[0] * 3600 + part[1] * 60 + part[2] + part[3] / F.lit(1000.0)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle blocks as rows: file, start_sec, end_sec, lines. Files are split at blank lines, in parallel.

    A file with Windows line ends has no such split, so it is read as a whole and split where it is. Byte order
    marks are dropped.
    """
    pieces = spark.read.option("lineSep", "\n\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    blocks = pieces.select("file", F.explode(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n[ \t]*\r?\n")).alias("value"))
    blocks = blocks.withColumn("value", F.regexp_replace("value", "\r(\n|$)", "$1"))
    blocks = blocks.where(F.col("value").rlike(BLOCK_TIME))
    lines = F.split(F.regexp_replace("value", r"(?s)^.*?-->[^\n]*\n?", ""), "\n")
    return blocks.select("file", _srt_seconds(F.col("value"), 1).alias("start_sec"), _srt_seconds(F.col("value"), 5).alias("end_sec"), lines.alias("lines"))


def srt_last_line(blocks: DataFrame, hour: Column) -> DataFrame:
    """Clock stamps HHMMSS with the file's hour added; the text is the last line only."""
    def stamp(sec):
        whole = F.floor(sec)
        return ((F.floor(whole / 3600) + hour) * 10000 + F.floor(whole % 3600 / 60) * 100 + whole % 60).cast("int")

    lines = F.filter("lines", lambda x: F.trim(x) != "")
    return blocks.select("file", stamp(F.col("start_sec")).alias("start"), stamp(F.col("end_sec")).alias("end"),
                         F.trim(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))).alias("text"), F.lit("transcript").alias("type"))


def srt_joined(blocks: DataFrame) -> DataFrame:
    """All non-blank lines joined by a space; blocks without text are dropped."""
    text = F.array_join(F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != ""), " ")
    return blocks.select("file", "start_sec", "end_sec", text.alias("text")).where("text <> ''")
