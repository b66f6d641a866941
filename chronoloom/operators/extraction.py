"""Cleaning of model responses: parse, repair what was cut off, keep well-formed triples."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLES = "triples array<array<string>>"
CLOSERS = {"{": "}", "[": "]"}


def valid_triples(triples: Column | str) -> Column:
    """Items of exactly three parts, first occurrence of each."""
    return F.array_distinct(F.filter(triples, lambda x: F.size(x) == 3))


def valid_with_evidence(triples: Column | str, evidence: Column | str) -> Column:
    """The same rule on a triple list that carries one evidence list per triple."""
    pairs = F.arrays_zip(F.col(triples).alias("triple") if isinstance(triples, str) else triples.alias("triple"),
                         F.col(evidence).alias("evidence") if isinstance(evidence, str)
                         else evidence.alias("evidence"))
    ok = F.filter(pairs, lambda x: F.size(x["triple"]) == 3)
    heads = F.transform(ok, lambda x: x["triple"])
    return F.filter(ok, lambda x, i: F.array_position(heads, x["triple"]) == i + 1)


def clean_triples(raw: DataFrame, key: str, response: str) -> tuple[DataFrame, DataFrame]:
    """(triples as rows with their position, rows whose response does not hold a triple list)."""
    parsed = raw.withColumn("_p", F.from_json(response, TRIPLES))
    bad = parsed.where("_p.triples IS NULL").drop("_p")
    good = (parsed.select(key, F.posexplode(valid_triples("_p.triples")))
            .select(key, "pos", F.col("col")[0].alias("s"), F.col("col")[1].alias("p"),
                    F.col("col")[2].alias("o")))
    return good, bad


def close_cut(text: str) -> str:
    """Drop the unfinished last item of a cut-off JSON text and close what is still open."""
    comma = text.rfind(",")
    kept = text[:comma] if comma >= 0 else text
    open_marks, quoted, escaped = [], False, False
    for ch in kept:
        if escaped:
            escaped = False
        elif quoted and ch == "\\":
            escaped = True
        elif ch == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif ch in CLOSERS:
            open_marks.append(CLOSERS[ch])
        elif ch in CLOSERS.values() and open_marks:
            open_marks.pop()
    return kept + "".join(reversed(open_marks))


def _is_json(text: str | None) -> bool:
    try:
        json.loads(text)
        return True
    except (TypeError, ValueError):
        return False


def repaired(raw: DataFrame, key: str, response: str, schema: str) -> DataFrame:
    """(key, response, parsed, outcome): clean, repaired or rejected.

    Only rows that do not parse go through Python, in Arrow batches.
    """
    is_json = F.try_parse_json(response).isNotNull()
    clean = raw.where(is_json).withColumn("outcome", F.lit("clean"))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fixed = b[response].map(lambda s: None if s is None else close_cut(s))
            ok = fixed.map(_is_json)
            yield b.assign(**{response: fixed.where(ok, b[response])},
                           outcome=ok.map({True: "repaired", False: "rejected"}))

    broken = raw.where(~is_json | F.col(response).isNull())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.schema.fields)
    mended = broken.mapInPandas(fix, f"{fields}, outcome string")
    both = clean.unionByName(mended)
    parsed = F.when(F.col("outcome") != "rejected", F.from_json(response, schema))
    return both.withColumn("parsed", parsed)


def strip_fences(text: Column | str) -> Column:
    """Model answers often wrap JSON in a code fence."""
    return F.trim(F.regexp_replace(text, r"(?i)```(?:json)?\s*|```", ""))


#: A JSON object that holds at most one level of objects.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
OBJECT = rf'(?s)\{{(?:[^{{}}"]++|{_STRING}|\{{(?:[^{{}}"]++|{_STRING})*+\}})*+\}}'
DECISION = "decision string, memory string, query string, selected_memory struct<memory_type: string, search_query: string>"
#: The memories that a decision cut off half way may name.
MEMORIES = "episodic|semantic|visual"


def decision(text: Column | str) -> Column:
    """Agent decision struct: of the first readable object in the text that has a decision, else of the fields that can
    be read from broken JSON; anything else, or an unknown decision, means `answer`.

    Memory and query belong to a search and may be flat or nested in `selected_memory`. Broken JSON gives them
    only if both are whole.
    """
    plain = strip_fences(text)
    objects = F.transform(F.regexp_extract_all(plain, F.lit(OBJECT), F.lit(0)), lambda o: F.from_json(o, DECISION))
    read = F.try_element_at(F.filter(objects, lambda o: o["decision"].isNotNull()), F.lit(1))

    def field(pattern: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(plain, pattern, 1)), F.lit(""))

    loose = field(r'(?i)"decision"\s*:\s*"(search|answer)"')
    memory = field(rf'(?i)"memory(?:_type)?"\s*:\s*"({MEMORIES})"')
    query = field(r'(?s)"(?:search_)?query"\s*:\s*"((?:[^"\\]++|\\.)*+)"')
    both = memory.isNotNull() & query.isNotNull()
    taken = F.coalesce(F.lower(F.trim(read["decision"])), F.lower(loose))
    search = taken == "search"
    nested = read["selected_memory"]
    return F.struct(
        F.when(taken.isin("search", "answer"), taken).otherwise("answer").alias("decision"),
        F.when(search & read.isNotNull(), F.coalesce(F.lower(F.trim(nested["memory_type"])), read["memory"]))
         .when(search & both, F.lower(memory)).alias("memory"),
        F.when(search & read.isNotNull(), F.coalesce(F.trim(nested["search_query"]), read["query"]))
         .when(search & both, query).alias("query"))


def id_list(text: Column | str) -> Column:
    """Ids named by a response: a JSON list, else every integer in the text, first occurrence each."""
    listed = F.from_json(strip_fences(text), "array<bigint>")
    loose = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.array_distinct(F.coalesce(listed, loose))
