"""Removal of lines that many documents share.

Lines are exploded, normalised and hashed to 128 bits; hashes found in `min_docs` documents or more lose all their lines
in every document, and what is left is put together by position.

Occurrences are counted first, with partial sums before the shuffle; a hash with fewer occurrences than `min_docs` cannot
be in as many documents, so only the lines of the others go on to the exact count of distinct documents. One line may
be in a third of all documents: the joins with the counted hashes broadcast the hot ones (`hot.join_counted`), and
distinct documents are counted by (hash, document) before they meet by hash.

A document is an id; rows of the same id are one document for the count, and each row with a null id is one by its text.
Rows with equal id and text are treated alike. Null and empty texts have one empty line. Keys shorter than `min_chars`
code points are never removed. Extra columns stay, but one named n_lines or n_dropped gives way to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .hot import join_counted
from .text import let, text_or_empty

#: What is stripped from a line, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(*values: Column) -> list[Column]:
    """128 bits as two columns; each starts from another seed."""
    return [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]


def drop_shared_lines(docs: DataFrame, key: str, text: str, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """`docs` with `text` without its shared lines, n_lines (before that) and n_dropped. A null text stays null."""
    whole = text_or_empty(text)
    row = [c.alias(n) for c, n in zip(_hashes(F.col(key).isNull(), F.col(key), whole), ("_r1", "_r2"))]
    # Texts are only split here; everything after works on hashes and positions.
    split = docs.select(F.col(key).alias("_id"), *row, F.posexplode(F.split(whole, "\n")).alias("_pos", "_line"))
    keyed = split.withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= min_chars)
    lines = keyed.select("_id", "_r1", "_r2", "_pos", *[c.alias(n) for c, n in zip(_hashes(F.col("_key")), ("_h1", "_h2"))])
    often = cut(lines.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs))
    found = cut(join_counted(lines, often, ["_h1", "_h2"], "_n").drop("_n"))
    document = F.struct("_id", F.when(F.col("_id").isNull(), F.col("_r1")))
    shared = cut(found.groupBy("_h1", "_h2").agg(F.count_distinct(document).alias("_docs"), F.count(F.lit(1)).alias("_n"))
                 .where(F.col("_docs") >= min_docs).select("_h1", "_h2", "_n"))
    drops = (join_counted(found, shared, ["_h1", "_h2"], "_n")
             .groupBy("_r1", "_r2").agg(F.collect_set("_pos").alias("_drop")))
    # The row travels as one struct, so that its columns may have any names.
    joined = docs.select(F.struct("*").alias("_doc"), whole.alias("_text"), *row).join(drops, ["_r1", "_r2"], "left")
    whole = F.col("_text")

    def left(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    n_lines = F.length(whole) - F.length(F.translate(whole, "\n", "")) + 1
    kept = F.when(F.col("_drop").isNull(), F.col("_doc")[text]).otherwise(let(F.split(whole, "\n"), left))
    own = [c for c in docs.columns if c == text or c not in ("n_lines", "n_dropped")]
    return joined.select(*[(kept if c == text else F.col("_doc")[c]).alias(c) for c in own], n_lines.cast("bigint").alias("n_lines"),
                         F.coalesce(F.size("_drop"), F.lit(0)).cast("bigint").alias("n_dropped"))
