"""Queries of the operators that may run Python inside tasks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, language, secrets
from .near_dup import near_duplicates
from .periodic import find_runs
from .registry import query, table
from .suffix_dedup import remove_repeats
from .text import hex16, let, text_or_empty, words


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, root: str) -> DataFrame:
    found = near_duplicates(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op3_secret_scans")
def op3(spark: SparkSession, root: str) -> DataFrame:
    """n_strong: assigned values whose guess cost reaches the method's limit; n_guess: spans that the method adds."""
    found = secrets.scan(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text")
    base = F.filter("spans", lambda s: s["kind"] != "guess")

    def shown(s):
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def number(test):
        return F.size(F.filter("spans", test)).cast("bigint")

    def of_kind(kind):
        return number(lambda s: s["kind"] == kind).alias(f"n_{kind}")

    return found.select(
        "doc_id", *[of_kind(kind) for kind in secrets.KINDS],
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"), of_kind("guess"),
        number(lambda s: (s["kind"] == "assign") & (s["bits"] >= secrets.MIN_BITS)).alias("n_strong"))


@query("op8_byte_bpe")
def op8(spark: SparkSession, root: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, root, "documents").select("doc_id", text_or_empty("text").alias("text"))
    ids = bpe.encode(docs, "text", path, pattern).drop("text")
    out = bpe.decode(ids, "ids", path, pattern)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op10_language_id")
def op10(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = language.fit(docs.where(~held_out), "text", "lang", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), "text", model).drop("text")


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, root: str) -> DataFrame:
    out = remove_repeats(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return out.select("doc_id", (F.octet_length("kept") + removed).cast("bigint").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query("op11_cross_tokenizer_alignment")
def op11(spark: SparkSession, root: str) -> DataFrame:
    files = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    aligned = alignment.align(table(spark, root, "documents").select("doc_id", "text"), "text", *files)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    scored = alignment.score_links(aligned.withColumn("groups_sha256", digest).drop("text", "groups"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def with_planted_periods(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document by hash, its words from one place on repeating those of the first period there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        places = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.array_join(let(places, lambda at: F.transform(at, lambda i: F.get(w, i))), " ")

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words(text), repeated)).otherwise(text)


@query("op12_periodic_runs")
def op12(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", with_planted_periods(F.col("doc_id"), text_or_empty("text")).alias("text"))

    def shown(r: Column) -> Column:
        return F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))

    def first(x: Column, y: Column) -> Column:
        """By length over period, without division, then start and period."""
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        order = F.when(left != right, F.when(left > right, -1).otherwise(1))
        for c in ("start", "period"):
            order = order.when(x[c] != y[c], F.when(x[c] < y[c], -1).otherwise(1))
        return order.otherwise(0)

    found = find_runs(docs, "text").select("doc_id", "runs", "collapsed", F.get(F.array_sort("runs", first), F.lit(0)).alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", shown), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
