"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is `host/path`: it fits its host and all subdomains if the path starts with the rule's path. `*` stands for
any characters but `/`. Every rule is filed under one token (a run of letters and digits) that each fitting URL must
hold as a whole token; of the possible ones, the token that the fewest URLs hold. A URL fetches the rules
filed under its own tokens and only those run as regular expressions. Rules without such a token are tried on all.

Null URLs and URLs without `://` have empty host and path; no rule fits them. Repeated rows come back repeated.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_BREAK = "[^A-Za-z0-9]+"
EVERY = ""                       # the token of rules that have none

#: The method's own verdict where no given rule fits: wildcard rules for telling host names.
DEFAULT_PATTERNS = (("block", "spam-*/"), ("block", "cheap-pills*/"), ("block", "*-casino*/"), ("block", "casino-*/"),
                    ("block", "viagra*/"), ("block", "*-xxx*/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    there = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.when(there, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_regex(rule: str) -> str:
    parts = ("[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*)", rule) if p)
    return r"^(?:[^/]*\.)?" + "".join(parts)


def rule_tokens(rule: str) -> list[str]:
    """Tokens that every fitting URL holds as whole tokens: those that no wildcard or open end can lengthen."""
    found = []
    for m in re.finditer("[A-Za-z0-9]+", rule):
        before = rule[m.start() - 1] if m.start() else "."
        if before != "*" and m.end() < len(rule) and rule[m.end()] != "*":
            found.append(m.group())
    return list(dict.fromkeys(found))


def rule_index(urls: DataFrame, tokens: Column, rules: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """(token, rule, regex, action, given) as an in-plan table. `rules` is held by the caller, so its size is
    bounded; only counts of its tokens reach the driver."""
    possible = {r: rule_tokens(r) for _, r, _ in rules}
    literal = sorted({t for ts in possible.values() for t in ts})
    seen = {}
    if literal:
        wanted = F.array(*[F.lit(t) for t in literal])
        counted = (urls.select(F.explode(F.array_intersect(tokens, wanted)).alias("token"))
                   .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
        seen = {r["token"]: r["n"] for r in counted.collect()}
    rows = []
    for action, rule, given in rules:
        token = min(possible[rule], key=lambda t: (seen.get(t, 0), t), default=EVERY)
        rows.append(F.struct(F.lit(token).alias("token"), F.lit(rule).alias("rule"), F.lit(rule_regex(rule)).alias("regex"),
                             F.lit(action).alias("action"), F.lit(given).alias("given")))
    return urls.sparkSession.range(1).select(F.inline(F.array(*rows)))


def judge_urls(pages: DataFrame, key: str, url: str, rules: Sequence[tuple[str, str]],
               patterns: Sequence[tuple[str, str]] = DEFAULT_PATTERNS) -> DataFrame:
    """(key, host, path, rule, verdict, pattern): the longest fitting rule of `rules` decides, else the longest
    fitting wildcard rule of `patterns`, else the URL is allowed. Equal lengths: the smaller rule text."""
    host, path = host_and_path(F.col(url).cast("string"))
    split = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    urls = split.select("host", "path").where("host <> '' OR path <> ''").distinct()
    tokens = F.array_distinct(F.split(F.concat("host", "path"), TOKEN_BREAK))
    listed = [(a, r, True) for a, r in rules] + [(a, r, False) for a, r in patterns]
    if not listed:
        return split.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"),
                            F.lit(None).cast("string").alias("pattern"))
    index = F.broadcast(rule_index(urls, tokens, listed))
    fetched = (urls.select("host", "path", F.explode(F.array_union(tokens, F.array(F.lit(EVERY)))).alias("token"))
               .join(index, "token").where(F.rlike(F.concat("host", "path"), F.col("regex"))))
    order = F.struct(-F.length("rule"), F.col("rule"))
    best = fetched.groupBy("host", "path").agg(
        F.min_by(F.struct("rule", "action"), F.when(F.col("given"), order)).alias("g"),
        F.min_by(F.struct("rule", "action"), F.when(~F.col("given"), order)).alias("p"))
    return split.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("g.rule").alias("rule"),
        F.coalesce("g.action", "p.action", F.lit("allow")).alias("verdict"), F.col("p.rule").alias("pattern"))
