"""Quality rules: exact text statistics, and a decision list that is learned from labelled rows.

Sequential covering: a rule grows one threshold at a time, each time the one with the best gain on two thirds of the
labelled rows; then the rule is cut back to the prefix that does best on the other third, is kept if it is precise
enough there, and the rows that it covers are left out of the search for the next. If it is not, the search starts
again from the next best first condition; it ends when no rule from any first condition is kept. Labelled rows are
counted by bins of the fixed grid `GRID` first, so a round only aggregates that table, for all rules in question at
once, and one small row per rule and threshold reaches the driver. The list is returned as conditions and turned into one ordered CASE expression.

Null and empty texts have no words. Labels that are null do not count; without labels the list is empty and keeps
everything. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .text import let, text_or_empty, words

WINDOW = 8
#: Thresholds per feature: the only places where a rule may cut.
SHARES = (0.03, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
GRID = {
    "words": (5, 10, 20, 40, 80, 160, 1000), "mean_word": (2, 3, 4, 5, 6, 7, 8, 10, 12), "symbols_per_word": SHARES,
    "repeated_share": SHARES, "duplicate_line_share": SHARES, "capital_share": SHARES, "mark_share": SHARES,
}
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs again: sort (hash, place), keep neighbours that agree, add up the places."""
    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(let(pairs, repeated), start, lambda acc, i: F.struct(
        i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"])


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def with_statistics(rows: DataFrame, text: str) -> DataFrame:
    """`rows` with the base statistics and two more counts (capitals, marks); `text` is a column of `rows`.

    Windows of eight words are compared by a 64-bit hash of the words."""
    t = text_or_empty(text)
    w = rows.withColumn("_w", words(t)).withColumn("n_words", F.size("_w").cast("bigint"))
    # Bound by `let`, so that no optimizer rule can move the split into the loop over the windows.
    hashes = let(F.col("_w"), lambda ws: F.when(F.size(ws) >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size(ws) - WINDOW + 1), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))))
    h = w.withColumn("_h", hashes)
    repeats = let(F.col("_h"), lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), _covered(hs)).otherwise(F.lit(0)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return h.select(
        *rows.columns, "n_words", F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        _count_of(t, r"[#*$%&|<>]").cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(repeats, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        let(lines, F.size).cast("bigint").alias("n_lines"), _count_of(t, "[A-Z]").cast("bigint").alias("n_capitals"),
        _count_of(t, "[!?]").cast("bigint").alias("n_marks"))


def features() -> dict[str, Column]:
    def share(a, b):
        return F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"words": F.col("n_words").cast("double"), "mean_word": share("word_chars", "n_words"),
            "symbols_per_word": share("n_symbols", "n_words"), "repeated_share": share("n_repeat_words", "n_words"),
            "duplicate_line_share": share("n_dup_lines", "n_lines"), "capital_share": share("n_capitals", "word_chars"),
            "mark_share": share("n_marks", "word_chars")}


def base_failed() -> Column:
    """Too short, or more than 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _binned(statistics: DataFrame, key: str, labels: DataFrame, label_key: str, label: str) -> DataFrame:
    def place(name: str, value: Column) -> Column:
        reached = F.lit(0)
        for c in GRID[name]:
            reached = reached + (value >= F.lit(float(c))).cast("int")
        return reached.alias(name)

    placed = statistics.select(F.col(key).alias("_k"), *[place(n, v) for n, v in features().items()])
    known = labels.where(F.col(label).isNotNull()).select(F.col(label_key).alias("_k"), (F.col(label) == 0).cast("int").alias("bad"))
    return cut(placed.join(known, "_k").groupBy((F.crc32(F.col("_k").cast("string")) % 3 == 0).alias("prune"), *GRID)
               .agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")))


def _holds(condition) -> Column:
    """On bins: bin b holds the values from cut b - 1 to below cut b."""
    name, at_least, place = condition
    return F.col(name) > place if at_least else F.col(name) <= place


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & _holds(c)
    return out


def _under(table: DataFrame, rules) -> DataFrame:
    """The rows of `table`, once for each rule that holds for them, with the rule's number."""
    held = F.array_compact(F.array(*[F.when(_all(rule), F.lit(i)) for i, rule in enumerate(rules)]))
    return table.select(F.explode(held).alias("rule"), *GRID, "bad", "good")


def _next_conditions(table: DataFrame, rules, totals):
    """Per rule, which covers `totals` (bad, good) rows, the thresholds with a first-order gain for bad rows as
    (condition, bad, good), best first; of equal ones the strictest, which leaves most documents alone."""
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in GRID]))
    counts = {(r["rule"], r["f"], r["b"]): (r["p"], r["n"]) for r in _under(table, rules).select("rule", stacked.alias("x"), "bad", "good")
              .groupBy("rule", "x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum("good").alias("n")).collect()}
    out = []
    for i, (bad, good) in enumerate(totals):
        before = math.log2(bad / (bad + good))
        ranked = []
        for name, cuts in GRID.items():
            p = n = 0
            for place in range(len(cuts)):
                p, n = (x + y for x, y in zip((p, n), counts.get((i, name, place), (0, 0)), strict=True))
                for at_least, (p1, n1) in ((False, (p, n)), (True, (bad - p, good - n))):
                    if p1:
                        gain = p1 * (math.log2(p1 / (p1 + n1)) - before)
                        if gain > 1e-9:
                            ranked.append(((round(gain, 9), place if at_least else -place), (name, at_least, place), p1, n1))
        out.append([x[1:] for x in sorted(ranked, key=lambda x: x[0], reverse=True)])
    return out


def _grown(table: DataFrame, firsts, max_conditions: int):
    """Rules that start with `firsts` and take the best next condition until they cover no good rows or none gains."""
    rules, totals = [[c] for c, _, _ in firsts], [(p, n) for _, p, n in firsts]
    growing = list(range(len(rules)))
    for _ in range(max_conditions - 1):
        growing = [i for i in growing if totals[i][1]]
        if not growing:
            break
        found = _next_conditions(table, [rules[i] for i in growing], [totals[i] for i in growing])
        growing = [i for i, ranked in zip(growing, found, strict=True) if ranked]
        for i, ranked in zip(growing, filter(None, found), strict=True):
            condition, *totals[i] = ranked[0]
            rules[i].append(condition)
    return rules


def _first_kept(prune: DataFrame, rules, precision: float, support: int):
    """The first rule that is worth keeping, cut back to its best prefix; None if none is."""
    prefixes = [rule[:n] for rule in rules for n in range(1, len(rule) + 1)]
    seen = {r["rule"]: (r["p"], r["n"]) for r in _under(prune, prefixes).groupBy("rule").agg(
        F.sum("bad").alias("p"), F.sum("good").alias("n")).collect()}
    begin = 0
    for rule in rules:
        counts = [seen.get(begin + n, (0, 0)) for n in range(len(rule))]
        begin += len(rule)
        worth = [((p + 1) / (p + n + 2), p, n, i) for i, (p, n) in enumerate(counts, 1)]
        _, p, n, keep = max(worth, key=lambda x: (x[0], -x[3]))
        if p >= max(support, 1) and p / (p + n) >= precision:
            return rule[:keep]
    return None


def learn_decision_list(statistics: DataFrame, key: str, labels: DataFrame, label_key: str = "doc_id",
                        label: str = "quality", max_rules: int | None = None, max_conditions: int = 3, precision: float = 0.95,
                        support: int = 5) -> list[list[tuple[str, bool, int]]]:
    """Ordered rules, each a list of (feature, at least?, place in the grid), that mark bad rows. Their number is only
    limited if `max_rules` is given."""
    rest, rules = _binned(statistics, key, labels, label_key, label), []
    while max_rules is None or len(rules) < max_rules:
        grow = rest.where(~F.col("prune"))
        bad, good = grow.agg(F.sum("bad"), F.sum("good")).first()
        firsts = _next_conditions(grow, [[]], [(bad, good)])[0] if bad and good else []
        # The best first condition mostly will do; if not, all others are grown together, and the best of them that is kept counts.
        kept = None
        for some in (firsts[:1], firsts[1:]):
            if some and kept is None:
                kept = _first_kept(rest.where("prune"), _grown(grow, some, max_conditions), precision, support)
        if kept is None:
            break
        rules.append(kept)
        rest = rest.where(~_all(kept))
    return rules


def as_case(rules) -> Column:
    """Number of the first rule that fits, from 1; null if none does."""
    values, out = features(), None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, at_least, place in rule:
            bound = F.lit(float(GRID[name][place]))
            test = test & ((values[name] >= bound) if at_least else (values[name] < bound))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def describe(rules) -> list[str]:
    return [" and ".join(f"{n} {'>=' if up else '<'} {GRID[n][i]}" for n, up, i in rule) for rule in rules]


def keep_good(docs: DataFrame, key: str, text: str, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that pass the base rules and a list learned from their labels, with all their columns.

    The statistics are computed twice, once to learn and once to judge, so that no text is shuffled."""
    rows = docs.select(F.struct("*").alias("doc"), F.col(key).alias("key"), F.col(text).alias("text"))
    counted = with_statistics(rows, "text")
    learned_from = cut(counted.select("key", *BASE_COLUMNS, "n_lines", "n_capitals", "n_marks")).where(~base_failed())
    rules = learn_decision_list(learned_from, "key", labels, **options)
    # A filter would be pushed below the statistics and compute them once per use; a generator is not.
    kept = F.when(~base_failed() & as_case(rules).isNull(), F.array("doc"))
    return counted.select(F.explode(kept).alias("doc")).select("doc.*")
