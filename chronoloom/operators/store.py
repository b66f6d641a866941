"""A table of rows by key that grows batch by batch, dealt into folders by a hash of the key.

A batch finds out which buckets its keys fall into, at most as many numbers as there are buckets, and reads only those
folders; the others are pruned by their partition value. Files carry a Bloom filter on the key. Batches append, so a bucket
gathers files; `compact` writes each bucket once into a new generation and then points to it, while readers of the
generation before go on undisturbed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import parallelism

BUCKET = "_b"


class BucketStore:
    """Rows of `schema` below `path`. The number of buckets is fixed when the store is made: `buckets`, or that of
    the shuffle partitions, so that a bucket is about what a task reads."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str, buckets: int | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType(list((T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields))
        made = spark.createDataFrame([(0, buckets or parallelism(spark))], "generation bigint, buckets bigint")
        made.coalesce(1).write.mode("ignore").parquet(f"{self.path}/generations")

    def _current(self) -> tuple[int, int]:
        """One row per compaction is read."""
        return max(tuple(r) for r in self.spark.read.schema("generation bigint, buckets bigint").parquet(f"{self.path}/generations").collect())

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _read(self, generation: int) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        try:
            return self.spark.read.schema(whole).parquet(f"{self.path}/rows-{generation}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], whole)   # nothing was appended yet

    def _write(self, rows: DataFrame, generation: int, buckets: int) -> None:
        (rows.select(*self.schema.fieldNames()).withColumn(BUCKET, self._bucket(buckets)).repartition(BUCKET).write.mode("append")
         .option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy(BUCKET).parquet(f"{self.path}/rows-{generation}"))

    def rows(self) -> DataFrame:
        """All rows; a key that two runs appended at once comes twice."""
        return self._read(self._current()[0]).drop(BUCKET)

    def buckets_of(self, keys: DataFrame, buckets: int | None = None) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(buckets or self._current()[1])).distinct().collect())

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that `keys` fall into, and no others."""
        generation, buckets = self._current()
        hit = self.buckets_of(keys, buckets)
        rows = self._read(generation)
        return (rows if len(hit) == buckets else rows.where(F.col(BUCKET).isin(hit) if hit else F.lit(False))).drop(BUCKET)

    def append(self, rows: DataFrame) -> None:
        self._write(rows, *self._current())

    def compact(self, buckets: int | None = None) -> None:
        """Each key once, few files per bucket, and another number of buckets if one is given."""
        generation, now = self._current()
        count = buckets or now
        self._write(self.rows().dropDuplicates([self.key]), generation + 1, count)
        self.spark.createDataFrame([(generation + 1, count)], "generation bigint, buckets bigint").coalesce(1).write.mode("append").parquet(
            f"{self.path}/generations")
