"""Readers for question sets, relevance judgments, gold passages and media lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timekeys import gap_bin, link_group, window_parts
from ..operators.ordered import row_numbers
from ..operators.sets import tagged_union


def linked_questions(episodic: DataFrame, long_term: DataFrame, key: str) -> DataFrame:
    """Linked-event records -> one query row each, numbered 1..N: first the episodic ones, then the links.

    episodic: key, current_time_window, past_time_window, past_observation, past_supporting_source, recall_type;
    long_term: key, current_time_window, linked_past_events array<struct<past_time_window, memory_key>>.
    """
    first = episodic.select(F.lit(0).alias("part"), key, F.lit(0).alias("i"), F.coalesce("recall_type", F.lit("task_reminder")).alias("type"),
                            "current_time_window", "past_time_window", F.col("past_supporting_source").alias("source"),
                            F.trim("past_observation").alias("question"))
    links = long_term.select(key, "current_time_window", F.posexplode("linked_past_events").alias("i", "l"))
    second = links.select(F.lit(1).alias("part"), key, "i", F.lit("long_term_link").alias("type"), "current_time_window",
                          F.col("l.past_time_window").alias("past_time_window"), F.lit("unknown").alias("source"),
                          F.trim("l.memory_key").alias("question"))
    rows = first.unionByName(second).withColumn("now", window_parts("current_time_window")).withColumn("past", window_parts("past_time_window"))
    numbered = row_numbers(rows.withColumn("_all", F.lit(0)), ["_all"], ["part", key, "i"], "ID").drop("_all")
    gap = (F.col("now.day") - F.col("past.day")) * 86400 + F.col("now.start_sec") - F.col("past.end_sec")
    return numbered.select("ID", key, "i", "type", "question", (F.col("source") == "speakers_say").alias("need_audio"), gap.alias("gap_sec"),
                           gap_bin("now.day", "past.day").alias("gap_bin"), link_group("type", gap, "source").alias("group"),
                           "now", "past")


def flat_choices(rows: DataFrame, duration: str | None = None) -> DataFrame:
    """options[0..3] -> choice_a..d without their leading letter; missing ones are empty."""
    kept = rows if duration is None else rows.where(F.col("duration") == duration)

    def choice(i: int) -> Column:
        return F.trim(F.regexp_replace(F.coalesce(F.get("options", F.lit(i)), F.lit("")), r"^[A-D][.)]\s*", ""))

    rest = [c for c in rows.columns if c != "options"]
    zero = F.struct(F.lit("DAY1").alias("date"), F.lit("00000000").alias("time"))
    return kept.select(*rest, *[choice(i).alias(f"choice_{n}") for i, n in enumerate("abcd")],
                       zero.alias("query_time"), zero.alias("target_time"))


def qrels(rows: DataFrame, query: str, doc: str, score: str, queries: DataFrame | None = None,
          language: str | None = None) -> DataFrame:
    """Best positive score per (query, doc), for queries of one language if asked."""
    out = rows.where(F.col(score) > 0).groupBy(query, doc).agg(F.max(score).alias(score))
    if queries is not None and language is not None:
        out = out.join(queries.where(F.col("language") == language).select(query), query, "left_semi")
    return out


def _doc(title: Column, text: Column) -> Column:
    return F.concat(title, F.lit("\n"), text)


def gold_from_facts(context: Column | str, titles: Column | str, glue: str) -> Column:
    """`context`: array<struct<title, sentences>>; gold where the title is among the supporting ones."""
    good = F.filter(context, lambda c: F.array_contains(titles, c["title"]))
    return F.array_distinct(F.transform(good, lambda c: _doc(c["title"], F.array_join(c["sentences"], glue))))


def gold_from_contexts(contexts: Column | str) -> Column:
    """`contexts`: array<struct<title, text, is_supporting>>; only those marked."""
    good = F.filter(contexts, lambda c: F.coalesce(c["is_supporting"], F.lit(False)))
    return F.array_distinct(F.transform(good, lambda c: _doc(c["title"], c["text"])))


def gold_from_paragraphs(paragraphs: Column | str) -> Column:
    """`paragraphs`: array<struct<title, text, paragraph_text, is_supporting>>; a missing mark counts as true."""
    good = F.filter(paragraphs, lambda c: F.coalesce(c["is_supporting"], F.lit(True)))
    return F.array_distinct(F.transform(good, lambda c: _doc(c["title"], F.coalesce(c["text"], c["paragraph_text"]))))


def gold_answers(answers: Column, aliases: Column | str) -> Column:
    return F.array_union(answers, F.coalesce(aliases, F.array().cast("array<string>")))


def subset_union(subsets: Mapping[str, DataFrame]) -> DataFrame:
    return tagged_union(subsets, "subset")


def keep_list(files: DataFrame, path: str, wanted: DataFrame, key: str, extensions: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(files to keep, files to drop) by stem and extension; nothing is deleted."""
    from ..functions.text import file_stem
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    known = files.withColumn("_stem", file_stem(path)).withColumn("_ok", ext.isin(list(extensions)))
    ids = wanted.select(F.col(key).cast("string").alias("_stem")).distinct()
    keep = known.where("_ok").join(ids, "_stem", "left_semi").drop("_stem", "_ok")
    drop = known.join(ids.withColumn("_hit", F.lit(True)), "_stem", "left").where("NOT _ok OR _hit IS NULL").drop("_stem", "_ok", "_hit")
    return keep, drop
