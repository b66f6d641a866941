"""Views that give the driver's tables the shape of timed-memory data, in Spark and as SQL text.

Every view covers the whole of its base table. The constants below only place rows on a time axis.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_normalize
from ..session import small_side
from .registry import Tables

FIRST_DAY = "2024-01-01"
CLIP_SECONDS = 30
GAZE_SPEED = 432000.0   # one month of events becomes about six seconds of gaze per recording

VIEWS = {
    "captions": f"""
        SELECT event_id AS id, user_id AS stream, event_type AS text, value,
               CAST(date_diff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE)) + 1 AS BIGINT) AS day,
               'DAY' || (date_diff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE)) + 1) AS date,
               strftime(ts, '%H%M%S') || '00' AS start_time,
               CAST(extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60
                    + floor(extract('second' FROM ts)) AS BIGINT) AS start_sec
        FROM events""",
    "clips": f"""
        SELECT id AS clip, stream AS clip_stream, text AS clip_text, value, day, date, start_time,
               day * 86400 + start_sec AS cs, day * 86400 + start_sec + {CLIP_SECONDS} AS ce
        FROM captions""",
    "points": """
        SELECT o_orderkey AS qid, o_custkey AS cust, o_orderpriority AS qtype, o_orderstatus AS status,
               o_totalprice AS price, 86400 * (2 + o_orderkey * 13 % 29) + o_orderkey * 7919 % 86400 AS qt,
               86400 * (2 + o_orderkey * 13 % 29) + o_orderkey * 7919 % 86400
                 - o_custkey * 613 % 172800 AS target
        FROM orders""",
    "asks": """
        SELECT conv_id AS qid, turn, role, text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS qno,
               86400 * (2 + conv_id * 13 % 29) + conv_id * 7919 % 86400 AS qt,
               86400 * (2 + conv_id * 13 % 29) + conv_id * 7919 % 86400
                 - conv_id * 613 % 172800 AS target,
               conv_id * 31 + turn * 7 AS vkey
        FROM conversations WHERE role = 'user'""",
    "vecs": """
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec,
               (SELECT count(*) FROM embeddings) AS n_vec FROM embeddings""",
    "gaze": f"""
        SELECT event_id AS sid, user_id AS clip, day * 86400 + start_sec AS sec,
               (day * 86400 + start_sec) / {GAZE_SPEED} AS t,
               0.5 + (event_id * 37 % 100) / 1000.0 AS x,
               0.45 + (event_id * 53 % 90) / 1000.0 AS y
        FROM events JOIN captions ON event_id = id""",
    "triples": """
        SELECT l_orderkey * 10 + l_linenumber AS tid, l_orderkey AS doc,
               'Part ' || p_name AS s, l_returnflag AS p, 'supplier #' || s_suppkey AS o
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "arms": """
        SELECT l.doc_id AS qid, d.lang AS qtype, l.doc_id % 2 = 0 AS audio, d.source AS source,
               CAST(l.quality AS INTEGER) AS a, CAST(1 - l.toxic AS INTEGER) AS b
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}

NEEDS = {"clips": ("captions",), "gaze": ("captions",)}


def with_views(*names: str) -> str:
    """`WITH` clause for the named views and what they are built on, in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n"


def captions(t: Tables) -> DataFrame:
    day = (F.datediff(F.col("ts").cast("date"), F.lit(FIRST_DAY).cast("date")) + 1).cast("bigint")
    return t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("stream"),
        F.col("event_type").alias("text"), "value", day.alias("day"),
        F.concat(F.lit("DAY"), day.cast("string")).alias("date"),
        F.concat(F.date_format("ts", "HHmmss"), F.lit("00")).alias("start_time"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("bigint").alias("start_sec"))


def clips(t: Tables) -> DataFrame:
    at = F.col("day") * 86400 + F.col("start_sec")
    return captions(t).select(
        F.col("id").alias("clip"), F.col("stream").alias("clip_stream"), F.col("text").alias("clip_text"),
        "value", "day", "date", "start_time", at.alias("cs"), (at + CLIP_SECONDS).alias("ce"))


def points(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    at = F.lit(86400) * (key * 13 % 29 + 2) + key * 7919 % 86400
    return t.orders.select(
        key.alias("qid"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("qtype"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
        at.alias("qt"), (at - F.col("o_custkey") * 613 % 172800).alias("target"))


def asks(t: Tables) -> DataFrame:
    from pyspark.sql import Window
    conv = F.col("conv_id")
    at = F.lit(86400) * (conv * 13 % 29 + 2) + conv * 7919 % 86400
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t.conversations.where("role = 'user'").select(
        conv.alias("qid"), "turn", "role", "text", no.alias("qno"), at.alias("qt"),
        (at - conv * 613 % 172800).alias("target"), (conv * 31 + F.col("turn") * 7).alias("vkey"))


def vecs(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.col("embedding").alias("vec"))


def vector_count(t: Tables) -> int:
    return t.embeddings.count()


def gaze(t: Tables) -> DataFrame:
    c = captions(t)
    sec = F.col("day") * 86400 + F.col("start_sec")
    return c.select(F.col("id").alias("sid"), F.col("stream").alias("clip"), sec.alias("sec"),
                    (sec / F.lit(GAZE_SPEED)).alias("t"),
                    (F.lit(0.5) + (F.col("id") * 37 % 100) / F.lit(1000.0)).alias("x"),
                    (F.lit(0.45) + (F.col("id") * 53 % 90) / F.lit(1000.0)).alias("y"))


def triples(t: Tables, form: Callable[[Column], Column] = lambda name: name) -> DataFrame:
    """`form` rewrites subjects, predicates and objects: names once per part and supplier, before they are joined to the many triples.

    Parts and suppliers are broadcast if a count shows that they are few.
    """
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", form(F.col("l_returnflag")).alias("p"))
    parts = t.part.select("p_partkey", form(F.concat(F.lit("Part "), F.col("p_name"))).alias("s"))
    suppliers = t.supplier.select("s_suppkey", form(F.concat(F.lit("supplier #"), F.col("s_suppkey").cast("string"))).alias("o"))
    return (li.join(small_side(parts, 128), F.col("l_partkey") == F.col("p_partkey")).join(small_side(suppliers, 128), F.col("l_suppkey") == F.col("s_suppkey"))
            .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tid"), F.col("l_orderkey").alias("doc"), "s", "p", "o"))


def normal_triples(t: Tables) -> DataFrame:
    """The triples with normalized names."""
    return triples(t, entity_normalize)


def arms(t: Tables) -> DataFrame:
    return (t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").select(
        F.col("doc_id").alias("qid"), F.col("lang").alias("qtype"),
        (F.col("doc_id") % 2 == 0).alias("audio"), "source",
        F.col("quality").cast("int").alias("a"), (F.lit(1) - F.col("toxic")).cast("int").alias("b")))
