"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import chunked, lag_over
from ..session import cut
from . import fingerprints as fp
from . import pii, quality
from .line_dedup import BLANKS, drop_shared_lines
from .mixing import cyclic_weights, repetition_plan, size_in_words, taken_words
from .registry import query, table
from .text import text_or_empty
from .url_filter import DEFAULT_PATTERNS, LOWER, UPPER, judge_urls, rule_regex

URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/"))


def _rule_rows(rules) -> str:
    quoted = ((a, r.replace("'", "''"), rule_regex(r).replace("'", "''")) for a, r in rules)
    return ", ".join(f"('{a}', '{r}', '{x}')" for a, r, x in quoted)


URL_SQL = rf"""
WITH given(action, rule, regex) AS (VALUES {_rule_rows(URL_RULES)}),
     wild(action, rule, regex) AS (VALUES {_rule_rows(DEFAULT_PATTERNS)}),
     cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path,
       (SELECT max_by(rule, length(rule)) FROM given WHERE regexp_matches(host || path, regex)) AS rule,
       coalesce((SELECT max_by(action, length(rule)) FROM given WHERE regexp_matches(host || path, regex)),
                (SELECT max_by(action, length(rule)) FROM wild WHERE regexp_matches(host || path, regex)), 'allow') AS verdict,
       (SELECT max_by(rule, length(rule)) FROM wild WHERE regexp_matches(host || path, regex)) AS pattern
FROM parts"""


@query("op1_url_filters", URL_SQL)
def op1(spark: SparkSession, root: str) -> DataFrame:
    return judge_urls(table(spark, root, "pages"), "page_id", "url", URL_RULES)


def edited_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts beside their edited form, and a narrow table of the rows with their successors.

    A row is known by (o, h): the id, null as the least, and a hash of the text, so repeated rows are one. Only the
    start of a text that its predecessor needs is sent to it.
    """
    text = text_or_empty("text")
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), F.xxhash64(text).alias("h"), text.alias("text"))
    narrow = rows.groupBy("doc_id", "o", "h", F.length("text").cast("bigint").alias("n_chars")).agg(F.count(F.lit(1)).alias("rows"))
    order = ["o", "h"]
    chunks = chunked(narrow, [], order)
    last = chunks.agg(F.max(F.struct(*order))).first()[0]
    if last is None:
        last = {"o": None, "h": None}
    nexts = lag_over(chunks, [], order, {"next_o": F.col("o"), "next_h": F.col("h")}).drop("_chunk")
    nexts = cut(nexts.withColumn("next_o", F.coalesce("next_o", F.lit(last["o"]).cast("bigint")))
                .withColumn("next_h", F.coalesce("next_h", F.lit(last["h"]).cast("bigint"))))
    texts = rows.select("o", "h", "text")
    wanted = nexts.select(F.col("next_o").alias("o"), F.col("next_h").alias("h"), F.col("o").alias("to_o"), F.col("h").alias("to_h"),
                          F.col("n_chars").alias("n"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    starts = texts.join(wanted, order).select(F.col("to_o").alias("o"), F.col("to_h").alias("h"), "n", "half",
                                              F.expr("substring(text, 1, half)").alias("start"))
    edited = texts.join(starts, order).withColumn(
        "edited", F.concat(F.expr("substring(text, 1, cast(n - half as int))"), "start"))
    return edited, nexts


@query("op2_fingerprints")
def op2(spark: SparkSession, root: str, radius: int = 3) -> DataFrame:
    """n_within: for ids divisible by 50, the other documents whose fingerprints are within `radius` bits; else null."""
    edited, rows = edited_documents(table(spark, root, "documents"))
    both = edited.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)).select("o", "h", "sha", F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))))
    found = fp.simhash(both, ["o", "h", "sha", "kind"], "t")
    picked = [F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{n}_{c}") for k, n in ((0, "own"), (1, "ed")) for c in ("hi", "lo")]
    prints = cut(rows.join(found.groupBy("o", "h", "sha").agg(*picked), ["o", "h"]))
    after = prints.select(F.col("o").alias("next_o"), F.col("h").alias("next_h"), F.col("own_hi").alias("n_hi"), F.col("own_lo").alias("n_lo"))
    distinct = prints.groupBy(F.col("own_hi").alias("hi"), F.col("own_lo").alias("lo")).agg(F.sum("rows").alias("rows"))
    asked = prints.where("doc_id % 50 = 0").select(F.col("own_hi").alias("hi"), F.col("own_lo").alias("lo")).distinct()
    near = fp.within_radius(asked, distinct, radius).join(distinct, ["hi", "lo"]).groupBy(
        F.col("q_hi").alias("own_hi"), F.col("q_lo").alias("own_lo")).agg((F.sum("rows") - 1).alias("near"))
    out = prints.join(after, ["next_o", "next_h"]).join(near, ["own_hi", "own_lo"], "left")
    return out.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), fp.shown(F.col("own_hi"), F.col("own_lo")).alias("fingerprint"),
        fp.shown(F.col("ed_hi"), F.col("ed_lo")).alias("edited_fingerprint"),
        fp.likeness(F.col("own_hi"), F.col("own_lo"), F.col("ed_hi"), F.col("ed_lo")).alias("near_edited"),
        fp.likeness(F.col("own_hi"), F.col("own_lo"), F.col("n_hi"), F.col("n_lo")).alias("near_next"),
        F.when(F.col("doc_id") % 50 == 0, F.col("near")).alias("n_within"),
        F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_r")).drop("_r")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 4096 AS b FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
           FROM d GROUP BY source),
     r AS (SELECT *, 2.0::DOUBLE * size AS cap, 1.5::DOUBLE * (SELECT sum(size) FROM s) AS total,
                  coalesce(sum(2.0::DOUBLE * size) OVER o, 0) AS before,
                  sum(w) OVER (ORDER BY size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
           FROM s WINDOW o AS (ORDER BY size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     l AS (SELECT (total - before) / after AS level FROM r WHERE (total - before) / after * w <= cap ORDER BY size / w, source LIMIT 1),
     t AS (SELECT source, size AS source_size, least(cap, w * level) AS target FROM r, l),
     p AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12) AS whole FROM t),
     q AS (SELECT source, b, sum(size) AS size, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY b
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d GROUP BY source, b),
     m AS (SELECT p.*, q.b, CASE WHEN q.size > 0 THEN least(1.0, greatest(0.0, (greatest(0.0, target - whole * source_size) - before)
                  / q.size)) ELSE 0 END AS part FROM q JOIN p ON q.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, m.source_size, m.target, (m.whole * d.size + floor(m.part * d.size + 0.5))::BIGINT AS taken
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.b = m.b"""


@query("op5_mixing", MIX_SQL)
def op5(spark: SparkSession, root: str) -> DataFrame:
    plan = repetition_plan(table(spark, root, "documents").select("doc_id", "source", "text"), "doc_id", "source",
                           size_in_words("text"), cyclic_weights([3, 1, 2]), "1.5 * sum(size)", 2, seed=7)
    return plan.select("doc.doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def _statistics() -> list[str]:
    return [*quality.BASE_COLUMNS, "n_lines", "n_capitals", "n_marks"]


@query("op7_quality_rules")
def op7(spark: SparkSession, root: str) -> DataFrame:
    """The statistics are computed once, narrow, and both learned from and judged. The list is learned on the rows
    that it decides: those that pass the base rules."""
    docs, labels = table(spark, root, "documents").select("doc_id", "text"), table(spark, root, "labels")
    statistics = cut(quality.with_statistics(docs, "text").select("doc_id", *_statistics()))
    rules = quality.learn_decision_list(statistics.where(~quality.base_failed()), "doc_id", labels)
    out = statistics.withColumn("base_failed", quality.base_failed()).withColumn("rule", quality.as_case(rules))
    return out.select("doc_id", *quality.BASE_COLUMNS, "base_failed",
                      (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


@query("op6_pii")
def op6(spark: SparkSession, root: str) -> DataFrame:
    found = pii.find_personal(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[of_kind(k) for k in pii.KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.concat("base", "context")).alias("spans"), F.size("context").cast("bigint").alias("n_context"))


def line_sql() -> str:
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     rows AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
     keyed AS (SELECT *, translate(trim(line, {blanks}), '{UPPER}', '{LOWER}') AS key FROM rows),
     shared AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM shared)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (FROM shared)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id"""


@query("op13_line_dedup", line_sql())
def op13(spark: SparkSession, root: str) -> DataFrame:
    out = drop_shared_lines(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty("text").cast("binary"), 256).alias("kept_sha256"))
