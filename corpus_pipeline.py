"""From raw documents to token ids, in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bpe, mixing, near_dup, quality, secrets
from chronoloom.llm.registry import table
from chronoloom.llm.text import text_or_empty
from chronoloom.session import scratch

SOURCE_WEIGHTS = [3, 1, 2]       # by the order of the sources, in turn
EPOCHS = 2
SHARE = "1.5 * sum(size)"
REMEMBERED = 50_000              # the Python workers of an executor serve all stages and must not grow large in one


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality.keep_good(docs, "doc_id", "text", table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return near_dup.keep_one(docs, "doc_id", "text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows."""
    clean = docs.select(*[secrets.redact(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])
    return clean.withColumn("n_chars", F.length("text").cast("bigint"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come back as often as the weights of their sources say, whole."""
    return mixing.mix(docs, "doc_id", "source", "text", mixing.cyclic_weights(SOURCE_WEIGHTS), SHARE, EPOCHS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and the text that they decode to. Other columns stay, but for those named like a result."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "ids", "n_tokens", "decoded")]
    back = bpe.round_trip(docs.select(*kept, text_or_empty("text").alias("text")), "text", path, pattern, remembered=REMEMBERED)
    return back.select(*kept, F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("quality rules", good_documents), ("near duplicates", distinct_documents), ("secrets", without_secrets),
          ("mixing", mixed_documents), ("byte-level BPE", token_ids)]

#: SQL has no decision lists, XXH64 or BPE; the tests hold the pipeline against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
