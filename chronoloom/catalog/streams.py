"""Streaming forms, run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import TimedIndex
from ..session import scratch
from ..streaming.fixations import fixation_stream as fixations
from ..streaming.indexing import index_stream, inference_stream
from . import views as V
from .incremental import fixation_sql
from .registry import Tables, query


class StreamTables(Tables):
    """The same tables as file streams; the views of `views.py` apply unchanged."""

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.root}/{name}.parquet"
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{path}*")


@query("watermark_index_stream", V.with_views("captions", "clips") + """
SELECT clip, ce, (SELECT max(ce) FROM clips) AS mark FROM clips""")
def watermark_index_stream(t: Tables) -> DataFrame:
    stream = V.clips(StreamTables(t.spark, t.root)).select("clip", "ce")
    like = V.clips(t).select("clip", "ce")
    index = TimedIndex(t.spark, scratch(t.spark, "stream-index"), like, "clip", "ce")
    index_stream(stream, index, scratch(t.spark, "stream-state")).awaitTermination()
    return index.entries().select("clip", "ce", F.lit(index.mark()).alias("mark"))


@query("cached_inference_stream", """
SELECT conv_id, turn, sha256(text || '|rule|text') AS key, length(text) || ':' || coalesce(regexp_extract(text, '\\S+'), '') AS response FROM conversations""")
def cached_inference_stream(t: Tables) -> DataFrame:
    out = scratch(t.spark, "stream-answers")
    inference_stream(t.spark, StreamTables(t.spark, t.root).conversations, "text", scratch(t.spark, "stream-cache"), out,
                     scratch(t.spark, "stream-state")).awaitTermination()
    return t.spark.read.parquet(out).select("conv_id", "turn", "key", "response")


@query("fixation_stream", fixation_sql((0.05,), 0.3) + """
SELECT clip, 'fixation' AS kind, start, "end", round(cx, 9) AS cx, round(cy, 9) AS cy, round(duration, 9) AS duration, n_samples FROM found""")
def fixation_stream(t: Tables) -> DataFrame:
    """The samples, then a mark for the end of every clip, as two runs of one query."""
    ends = V.gaze(t).select("clip").distinct().select(
        "clip", *[F.lit(None).cast(k).alias(c) for c, k in (("sid", "bigint"), ("t", "double"), ("x", "double"), ("y", "double"))])
    marks, out, state = (scratch(t.spark, f"stream-{n}") for n in ("ends", "fixations", "state"))
    ends.limit(0).write.parquet(marks)
    samples = V.gaze(StreamTables(t.spark, t.root)).select("clip", F.col("sid").cast("bigint").alias("sid"), "t", "x", "y")
    both = fixations(samples.unionByName(t.spark.readStream.schema(ends.schema).parquet(marks)), min_seconds=0.3)

    def run() -> None:
        (both.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
         .trigger(availableNow=True).start().awaitTermination())

    run()
    ends.write.mode("append").parquet(marks)
    run()
    return t.spark.read.parquet(out).withColumns({c: F.round(c, 9) for c in ("cx", "cy", "duration")})
