"""Training-pair preparation: negatives, contrasts, prompts, one schema for all sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_side
from .ordered import row_numbers
from .selection import seeded, seeded_uniform

IMAGE = "struct<paths: array<string>, bytes: array<binary>, resolutions: array<array<int>>>"
#: The columns of a training pair.
PAIR = {"query_text": "string", "query_image": IMAGE, "pos_text": "string", "pos_image": IMAGE,
        "neg_text": "array<string>", "neg_image": IMAGE}
#: Fixed value: a row with fewer than this share of the wanted negatives is dropped.
ENOUGH = 0.8


def mine_negatives(rows: DataFrame, n: int, key: str, seed: str, threshold: float | None = None,
                   margin: float | None = None, ratio: float | None = None, same_prefix: str | None = None,
                   near_positive: tuple[int, int] | None = None, near_score: float | None = None,
                   keep_range: tuple[int, int | None] | None = None) -> DataFrame:
    """Draw n hard negatives per row; rows without enough candidates drop out.

    rows: key, neg_ids, neg_scores (parallel lists of one mined query), pos_score, prev_neg; optional
    posbased_ids and posbased_scores (sorted by score). Filters apply in order: same document prefix, ids
    close to the positive by position or score, score bounds, position range.
    """
    item = F.arrays_zip(F.col("neg_ids").alias("id"), F.col("neg_scores").alias("score"))
    drop = F.array().cast("array<string>")
    if near_positive is not None:
        start, end = near_positive
        drop = F.concat(drop, F.slice("posbased_ids", start + 1, end - start))
    if near_score is not None:
        lows = F.transform("posbased_scores", lambda s: s <= near_score)
        lead = F.when(F.array_contains(lows, True), F.array_position(lows, True) - 1).otherwise(F.size("posbased_ids"))
        drop = F.concat(drop, F.slice("posbased_ids", F.lit(1), lead.cast("int")))
    pos = F.col("pos_score")

    def fits(x):
        ok = ~F.array_contains(drop, x["id"])
        if same_prefix is not None:
            ok = ok & ~x["id"].startswith(F.col(same_prefix))
        if threshold is not None:
            ok = ok & (x["score"] < threshold)
        if margin is not None:
            ok = ok & (pos.isNull() | (x["score"] < pos - margin))
        if ratio is not None:
            ok = ok & (pos.isNull() | (x["score"] < pos * ratio))
        return ok

    good = F.transform(F.filter(item, fits), lambda x: x["id"])
    pool = rows.withColumn("_c", F.when(F.size(good) > 0, good).otherwise(F.col("prev_neg"))).where("_c IS NOT NULL")
    if keep_range is not None:
        start, end = keep_range
        length = F.size("_c") if end is None else F.lit(end - start)
        pool = pool.withColumn("_c", F.slice("_c", F.lit(start + 1), length))
    pool = pool.where(F.size("_c") >= ENOUGH * n).withColumn("n_candidates", F.size("_c"))
    shuffled = F.transform(F.array_sort(F.transform("_c", lambda x, i: F.struct(
        seeded(seed, F.col(key), x, i).alias("h"), i.alias("i"), x.alias("x")))), lambda e: e["x"])
    again = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(
        F.col("_c"), F.floor(seeded_uniform(seed, F.col(key), i) * F.size("_c")).cast("int")))
    return pool.withColumn("negatives", F.when(F.size("_c") >= n, F.slice(shuffled, 1, n)).otherwise(again)).drop("_c")


def label_contrast(rows: DataFrame, key: str, label: str, n: int, seed: str) -> DataFrame:
    """(key, pos_id, neg_id, j): another row of the same label, and n rows of other labels.

    Rows stand in a seeded order inside their label; the positive is the next one in the circle and a
    negative is a seeded place in a seeded other label, so every partner comes from an equi join and no
    pairs inside a label are listed. Labels with a single row are left out.
    """
    placed = row_numbers(rows.select(key, label).withColumn("_h", seeded(seed, key)), [label], ["_h", key]).drop("_h")
    sizes = placed.groupBy(label).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    many = sizes.count()
    names = row_numbers(sizes.withColumn("_all", F.lit(0)), ["_all"], [label], "li").drop("_all")
    placed = placed.join(names, label)
    partner = placed.select(label, F.col("rn").alias("_at"), F.col(key).alias("pos_id"))
    pos = placed.withColumn("_at", F.col("rn") % F.col("size") + 1).join(partner, [label, "_at"]).select(key, "pos_id", "li")
    picks = pos.select(key, "pos_id", "li", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("j"))
    other = (F.col("li") - 1 + 1 + F.floor(seeded_uniform(seed + "l", key, "j") * (many - 1))) % many + 1
    picks = picks.withColumn("_li", other.cast("bigint")).join(
        small_side(names.select(F.col("li").alias("_li"), F.col("size").alias("_size")), 32), "_li")
    picks = picks.withColumn("_rn", (F.floor(seeded_uniform(seed + "p", key, "j") * F.col("_size")) + 1).cast("bigint"))
    target = placed.select(F.col("li").alias("_li"), F.col("rn").alias("_rn"), F.col(key).alias("neg_id"))
    return picks.join(target, ["_li", "_rn"]).select(key, "pos_id", "j", "neg_id")


def label_names(rows: DataFrame, key: str, label: str, n: int, seed: str) -> DataFrame:
    """(key, label, j, neg_label): the label itself as positive, seeded other label names as negatives."""
    labels = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    names = row_numbers(labels.withColumn("_all", F.lit(0)), ["_all"], [label], "li").select(label, "li")
    many = names.count()
    picks = rows.select(key, label).join(names, label).select(
        key, label, "li", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("j"))
    other = (F.col("li") + F.floor(seeded_uniform(seed, key, "j") * (many - 1))) % many + 1
    return picks.withColumn("_li", other.cast("bigint")).join(
        names.select(F.col("li").alias("_li"), F.col(label).alias("neg_label")), "_li").select(key, label, "j", "neg_label")


def prompted(rows: DataFrame, key: str, query: str, hard: str, corpus: DataFrame, doc: str, n: int, ratio: float,
             seed: str, mark: str = "[SEP]") -> DataFrame:
    """Split `prompt[SEP]query`, keep the prompt for a seeded share of rows, fill negatives up to n.

    rows: key, query, hard (array of negatives); corpus: doc. Missing negatives are seeded places of the corpus.
    """
    at = F.instr(F.col(query), mark)
    text = F.col(query)
    head = F.when(at > 0, F.trim(F.substring(text, F.lit(1), at - 1))).otherwise("")
    tail = F.when(at > 0, F.trim(F.substring(text, at + len(mark), F.length(text)))).otherwise(text)
    named = rows.withColumn("_q", F.when((head != "") & (seeded_uniform(seed + "q", key) < ratio),
                                         F.concat_ws(" ", head, tail)).otherwise(tail))
    total = corpus.count()
    placed = row_numbers(corpus.select(doc).withColumn("_all", F.lit(0)), ["_all"], [doc]).select("rn", doc)
    gaps = named.where(F.size(hard) < n).select(key, F.explode(F.sequence(F.size(hard) + 1, F.lit(n))).alias("j"))
    gaps = gaps.withColumn("rn", (F.floor(seeded_uniform(seed + "n", key, "j") * total) + 1).cast("bigint"))
    filled = gaps.join(placed, "rn").groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("j", doc))), lambda x: x[doc].cast("string")).alias("_more"))
    return named.join(filled, key, "left").select(key, F.col("_q").alias("query_text"), F.concat(
        F.slice(hard, 1, n), F.coalesce("_more", F.array().cast("array<string>"))).alias("neg_text"))


def align(sources: Mapping[str, DataFrame], schema: Mapping[str, str] = PAIR) -> DataFrame:
    """All sources in one pair schema: missing columns are null, the source's name is added."""
    parts = [df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in schema.items()],
                       F.lit(name).alias("global_dataset_name")) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def video_pairs(frames: DataFrame, texts: DataFrame, video: str, order: Sequence[str], path: str, n: int,
                instruction: str) -> DataFrame:
    """(video, instruction, n evenly spaced frame paths, positive text); frames are listed, not decoded."""
    from .selection import thin
    picked = thin(frames.select(video, *order, path), [video], order, n)
    listed = picked.groupBy(video).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", path))),
                                                   lambda f: f[path]).alias("paths"))
    image = F.struct(F.col("paths"), F.lit(None).cast("array<binary>").alias("bytes"),
                     F.lit(None).cast("array<array<int>>").alias("resolutions"))
    return listed.join(texts, video).select(video, F.lit(instruction).alias("query_text"), image.alias("query_image"), "pos_text")


def conversation_pairs(turns: DataFrame, conv: str, turn: str, text: str, mode: str, prompt: str = "") -> DataFrame:
    """`answer`: first turn and the second as its answer. `caption`: the second turn behind a prompt as query
    and the first as positive. Conversations with fewer than two turns drop out."""
    first = turns.groupBy(conv).agg(F.min(F.struct(turn, text)).alias("a"), F.min(turn).alias("_t"))
    later = turns.join(first.select(conv, "_t"), conv).where(F.col(turn) > F.col("_t"))
    second = later.groupBy(conv).agg(F.min(F.struct(turn, text)).alias("b"))
    both = first.join(second, conv)
    a, b = F.col(f"a.{text}"), F.col(f"b.{text}")
    if mode == "answer":
        return both.select(conv, a.alias("query_text"), b.alias("pos_text"))
    if mode == "caption":
        return both.select(conv, F.concat(F.lit(prompt), b).alias("query_text"), a.alias("pos_text"))
    raise ValueError(f"unknown mode {mode!r}")
