"""The bucketed store: which folders a batch reads, appended twice, compacted."""

import os

from pyspark.sql import functions as F

from chronoloom.operators import incremental as I
from chronoloom.operators.store import BucketStore
from chronoloom.session import scratch


def local(path):
    return path.removeprefix("file:")


def test_a_batch_reads_its_buckets_only(spark):
    path = scratch(spark, "t-store")
    store = BucketStore(spark, path, "key string, v bigint", "key", buckets=1000)
    store.append(spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v")))
    batch = spark.createDataFrame([(f"k{i}",) for i in range(0, 20000, 2000)], "key string")
    hit = store.buckets_of(batch)
    assert 0 < len(hit) <= 10
    # Folders outside the batch's buckets are made unreadable: reading any of them would fail.
    folders = [f for f in os.listdir(local(f"{path}/rows-0")) if f.startswith("_b=")]
    assert len(folders) > 900
    for f in folders:
        if int(f[3:]) not in [*hit, -1]:
            with open(local(f"{path}/rows-0/{f}/part-broken.parquet"), "w") as out:
                out.write("no parquet")
    found = store.near(batch).join(batch, "key").collect()
    assert sorted(r["v"] for r in found) == list(range(0, 20000, 2000))


def test_bloom_filters_are_written(spark):
    import pyarrow.parquet as pq
    path = scratch(spark, "t-store")
    store = BucketStore(spark, path, "key string, v bigint", "key", buckets=1)
    store.append(spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("key"), F.col("id").alias("v")))
    (name,) = [f for f in os.listdir(local(f"{path}/rows-0/_b=0")) if f.endswith(".parquet")]
    size = os.path.getsize(local(f"{path}/rows-0/_b=0/{name}"))
    meta = pq.ParquetFile(local(f"{path}/rows-0/_b=0/{name}")).metadata
    data = sum(meta.row_group(0).column(i).total_compressed_size for i in range(2))
    assert size - data > 4000      # the filter lies beside the columns


def test_compaction_keeps_each_key_once(spark):
    path = scratch(spark, "t-store")
    store = BucketStore(spark, path, "key string, v bigint", "key", buckets=3)
    assert store.rows().count() == 0 and store.near(spark.createDataFrame([("a",)], "key string")).count() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, v bigint")
    store.append(rows)
    store.append(rows.where("key = 'a'"))
    old = store.rows()
    assert old.count() == 4
    store.compact(buckets=8)
    again = BucketStore(spark, path, "key string, v bigint", "key")
    assert sorted(map(tuple, again.rows().collect()), key=str) == sorted([("a", 1), ("b", 2), (None, 3)], key=str)
    assert again._current() == (1, 8) and old.count() == 4
    assert again.near(rows.where("key = 'b'")).where("key = 'b'").count() == 1
    again.append(spark.createDataFrame([("c", 4)], "key string, v bigint"))
    assert again.rows().count() == 4


def test_cache_reads_what_it_asks(spark):
    path = scratch(spark, "t-cache")
    BucketStore(spark, path, I.CACHE, "key", buckets=200)
    many = spark.range(500).select(F.concat(F.lit("prompt "), "id").alias("p"))
    assert I.cached_inference(spark, many, "p", path).where("hit").count() == 0
    few = many.limit(5).unionByName(spark.createDataFrame([("new",)], "p string"))
    hit = BucketStore(spark, path, I.CACHE, "key").buckets_of(few.select(I.prompt_key("p", "rule", "text").alias("key")))
    for f in os.listdir(local(f"{path}/rows-0")):
        if f.startswith("_b=") and int(f[3:]) not in [*hit, -1]:
            with open(local(f"{path}/rows-0/{f}/part-broken.parquet"), "w") as out:
                out.write("no parquet")
    got = {r["p"]: r["hit"] for r in I.cached_inference(spark, few, "p", path).collect()}
    assert len(got) == 6 and sum(got.values()) == 5 and not got["new"]
