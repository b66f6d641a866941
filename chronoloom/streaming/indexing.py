"""Continuous forms of the incremental operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import hooks
from ..operators.incremental import TimedIndex, cached_inference


def index_stream(stream: DataFrame, index: TimedIndex, checkpoint: str) -> StreamingQuery:
    """Add every arriving row to the index, each key once, and move the mark to the latest end seen.

    Nothing is dropped for being late: a row whose end lies below the mark is new as long as its key is.
    A repeated batch finds its keys already stored.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates([index.key]).persist()
        top = rows.agg(F.max(index.end)).first()[0]
        if top is None:
            rows.unpersist()
            return
        mark = index.mark()
        until = int(top if mark is None else max(top, mark))
        index.take(rows, until)
        if mark is None or until > mark:
            index.spark.createDataFrame([(until,)], "mark bigint").write.mode("append").parquet(f"{index.path}/marks")
        rows.unpersist()

    return (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def inference_stream(spark: SparkSession, stream: DataFrame, prompt: str, cache_path: str, out_path: str,
                     checkpoint: str, answer: Callable[[str], str] = hooks.echo_rule, model: str = "rule") -> StreamingQuery:
    """Answer arriving prompts through the cache; each micro-batch replaces its own output folder."""
    def run(batch: DataFrame, batch_id: int) -> None:
        out = cached_inference(spark, batch, prompt, cache_path, model=model, answer=answer)
        out.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
