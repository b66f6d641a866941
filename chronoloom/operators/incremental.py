"""Work that only touches what is new: vector store, cached model calls, timed index, deletions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import hooks
from ..functions.text import hash_id
from ..session import cut
from .graph_build import facts, mentions
from .store import BucketStore

STORE = "hash_id string, content string, embedding array<float>"


# --- vector store ---------------------------------------------------------------------------------

def vector_store(spark: SparkSession, path: str) -> BucketStore:
    """The store at `path`; an empty one is made on first use."""
    return BucketStore(spark, path, STORE, "hash_id")


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the store at `path`."""
    return vector_store(spark, path).rows()


def new_texts(store: DataFrame, texts: DataFrame, text: str, prefix: str) -> DataFrame:
    """Distinct (hash_id, content) rows that the store does not hold yet."""
    ids = texts.select(hash_id(text, prefix).alias("hash_id"), F.col(text).alias("content"))
    return ids.dropDuplicates(["hash_id"]).join(store.select("hash_id"), "hash_id", "left_anti")


def upsert(spark: SparkSession, path: str, texts: DataFrame, text: str, prefix: str = "",
           encoder: hooks.Encoder = hooks.hashed_words) -> None:
    """Encode and append only the texts that are new; only the buckets that the texts fall into are read."""
    store = vector_store(spark, path)
    fresh = new_texts(store.near(texts.select(hash_id(text, prefix).alias("hash_id"))), texts, text, prefix)
    store.append(hooks.encode(fresh, "content", "embedding", encoder))


def remove(spark: SparkSession, path: str, new_path: str, ids: DataFrame) -> None:
    """Write a version of the store without the given ids; the old version stays readable."""
    left = open_store(spark, path).join(ids.select("hash_id"), "hash_id", "left_anti")
    vector_store(spark, new_path).append(left)


def lookup(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored rows of the ids; a text that two runs appended at once is one row."""
    return ids.select("hash_id").join(store.join(ids.select("hash_id"), "hash_id", "left_semi").dropDuplicates(["hash_id"]), "hash_id")


def merge_shards(shards: DataFrame, key: str, shard: str) -> DataFrame:
    """Last shard wins per key; a map-side-combined aggregate."""
    rest = [c for c in shards.columns if c != key]
    out = shards.groupBy(key).agg(F.max_by(F.struct(*rest), shard).alias("m"))
    return out.select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


def contiguous(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Chunk i of n over sorted ids, each of ceil(N / n) rows."""
    from .ordered import row_numbers
    total = rows.count()
    size = max(1, -(-total // n))
    numbered = row_numbers(rows.withColumn("_all", F.lit(0)), ["_all"], order)
    return numbered.withColumn("chunk", F.floor((F.col("rn") - 1) / size)).drop("_all", "rn")


# --- cached model calls ---------------------------------------------------------------------------

CACHE = "key string, response string"


def prompt_key(prompt: str, model: str, schema: str):
    return F.sha2(F.concat_ws("|", F.col(prompt), F.lit(model), F.lit(schema)), 256)


def cached_inference(spark: SparkSession, rows: DataFrame, prompt: str, cache_path: str, model: str = "rule",
                     schema: str = "text", answer: hooks.Answerer = hooks.echo_rule, attempts: int = 5,
                     waves: int = 1) -> DataFrame:
    """Rows with key, hit, response and error.

    Every distinct prompt that is not cached is answered once; of the cache, only the buckets of the prompts are read. Answers are appended wave by wave, so a lost
    job repeats at most one wave. A prompt that keeps failing gives an empty response and its error, and is
    not cached.
    """
    store = BucketStore(spark, cache_path, CACHE, "key")
    keyed = rows.withColumn("key", prompt_key(prompt, model, schema))
    asked = cut(keyed.select("key", F.col(prompt).alias("_prompt")).dropDuplicates(["key"]))
    # Two runs that answered the same prompt at once both appended it; one answer per key is taken, always the same.
    known = cut(store.near(asked).join(asked.select("key"), "key", "left_semi").groupBy("key").agg(F.min("response").alias("response")))
    missing = asked.join(known, "key", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            responses, errors = [], []
            for text in b["_prompt"]:
                response, error = "", None
                for _ in range(attempts):
                    try:
                        response, error = answer(text), None
                        break
                    except Exception as e:  # a model may fail in any way; the row reports it
                        error = f"{type(e).__name__}: {e}"
                responses.append(response)
                errors.append(error)
            yield pd.DataFrame({"key": b["key"], "response": responses, "error": errors})

    answered = known.select("key", "response", F.lit(None).cast("string").alias("error"), F.lit(True).alias("hit"))
    for wave in range(waves):
        part = missing.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave)
        done = cut(part.mapInPandas(call, "key string, response string, error string"))
        store.append(done.where("error IS NULL"))
        answered = answered.unionByName(done.withColumn("hit", F.lit(False)))
    return (keyed.join(answered, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
            .withColumn("response", F.coalesce("response", F.lit(""))))


# --- index up to a time ---------------------------------------------------------------------------

class TimedIndex:
    """Entries seen up to a high-water mark, kept as parquet below `path`.

    Captions and clips accumulate; a semantic index shows one snapshot only. The mark is written after the
    entries, and entries already present are skipped, so a repeated call after a failure is harmless. Rows
    that arrive late (their end is below the mark) are taken on the next call.
    """

    def __init__(self, spark: SparkSession, path: str, like: DataFrame, key: str, end: str):
        self.spark, self.path, self.key, self.end = spark, path, key, end
        self.schema = T.StructType([*like.schema.fields, T.StructField("_call", T.LongType())])
        self.store = BucketStore(spark, f"{path}/entries", self.schema, key)
        spark.createDataFrame([], "mark bigint").write.mode("ignore").parquet(f"{path}/marks")

    def mark(self) -> int | None:
        return self.spark.read.schema("mark bigint").parquet(f"{self.path}/marks").agg(F.max("mark")).first()[0]

    def entries(self) -> DataFrame:
        """One row per key, also where two calls appended it at once."""
        return self.store.rows().dropDuplicates([self.key])

    def take(self, rows: DataFrame, until: int) -> None:
        """Append the rows whose keys are not stored yet; only their buckets are read."""
        fresh = rows.join(self.store.near(rows).select(self.key), self.key, "left_anti")
        self.store.append(fresh.withColumn("_call", F.lit(until).cast("bigint")))

    def advance(self, rows: DataFrame, until: int) -> bool:
        mark = self.mark()
        if mark is not None and until <= mark:
            return False
        self.take(rows.where(F.col(self.end) <= until), until)
        self.spark.createDataFrame([(until,)], "mark bigint").write.mode("append").parquet(f"{self.path}/marks")
        return True


def snapshot_at(snapshots: DataFrame, time: str, until: int) -> DataFrame:
    """Rows of the latest snapshot at or before `until`; earlier snapshots are replaced, not added."""
    latest = snapshots.where(F.col(time) <= until).agg(F.max(time).alias(time))
    return snapshots.join(latest, time)


# --- deletion -------------------------------------------------------------------------------------

PART_ROWS = 500_000     # triples to a part of a counted deletion


def delete_tables(triples: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Remaining triples and edges, and the facts and entities that no remaining document uses."""
    from .sets import only_in_deleted
    kept = triples.join(gone.select("doc"), "doc", "left_anti")
    return {"triples": kept, "passage_edges": mentions(kept),
            "facts_gone": only_in_deleted(triples, gone, "doc", ["s", "p", "o"]),
            "entities_gone": only_in_deleted(mentions(triples), gone, "doc", ["entity"])}


def delete_documents(triples: DataFrame, gone: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row of counts after a deletion, by two passes: one by document, one by fact.

    Both deal the triples into as many parts as their number asks for, so that what a task holds does not grow with them.
    """
    rows = triples.select("doc", "s", "p", "o")
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // part_rows))
    marked = (rows.repartition(n, "doc").join(gone.select("doc").repartition(n, "doc").distinct().withColumn("_gone", F.lit(1)), "doc", "left")
              .select("doc", "s", "p", "o", F.isnull("_gone").cast("int").alias("_alive")))
    ends = marked.where("_alive = 1").select("doc", F.explode(F.array("s", "o")).alias("entity")).distinct()
    of_doc = ends.groupBy("doc").agg(F.count_if(F.col("entity") != "").alias("n"))      # parts of documents: nothing is shuffled again
    by_doc = of_doc.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_passage_edges"))
    # A fact counts for itself, under no name, and shows both of its entities.
    known = marked.repartition(n, "s", "p", "o").groupBy("s", "p", "o").agg(F.max("_alive").alias("_alive"))
    name, nobody = F.explode(F.array(F.lit(None).cast("string"), F.coalesce("s", F.lit("")), F.coalesce("o", F.lit("")))), F.col("name").isNull()
    named = known.select(name.alias("name"), "_alive").where(nobody | (F.col("name") != "")).groupBy("name").agg(
        F.max("_alive").alias("_alive"), F.count_if(F.col("_alive") == 1).alias("n"), F.count_if(F.col("_alive") == 0).alias("n_gone"))
    by_fact = named.agg(
        F.coalesce(F.max(F.when(nobody, F.col("n"))), F.lit(0)).alias("n_facts"), F.coalesce(F.max(F.when(nobody, F.col("n_gone"))), F.lit(0)).alias("n_facts_gone"),
        F.count_if(~nobody & (F.col("_alive") == 1)).alias("n_entities"), F.count_if(~nobody & (F.col("_alive") == 0)).alias("n_entities_gone"))
    return by_doc.crossJoin(by_fact).select("n_docs", "n_facts", "n_facts_gone", "n_entities", "n_entities_gone", "n_passage_edges")
