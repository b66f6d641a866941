"""Personal data: exact patterns, and identifiers that their context gives away, by bootstrapping.

Patterns: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers, each leftmost and without overlaps
within its kind. Matches are found with built-in regular expressions; places come from the lengths of the matches and
of the texts between them. Repeats are possessive, so no text is too long for them.

Bootstrapping: a pattern match is one instance, whatever tokens it has, and so is every other token with a digit or an at sign, of any
length. The lexical patterns of an instance are the word and the two words before it, and the word and the two words after it, however far
away. Matches are the seeds. Scores go back and forth over aggregated (pattern, instance) edges:

* a pattern's score is the sum of its instances' scores over all places where its words stand in the texts, so that every ordinary word
  that follows `the` counts against `the`; `damping` is added to the places. It is accepted from `min_score` on, with `min_instances`
  different instances that have a score;
* an instance's score is the mean over its places of the score of the accepted pattern there, for the kind of context in which that
  is highest; seeds keep 1.

Scores can only rise, and rounds go on until none rises by more than `tolerance`. Patterns that could not be accepted if all their
instances had score 1 are left out beforehand, which changes nothing. Instances in the context of an accepted pattern are found, kind `context`.

Null and empty texts have no spans. Repeated rows come back repeated; as evidence they count as often as they occur, but their instances
are no different ones. Words of patterns are counted by 64-bit hashes. Spans are code points, end exclusive; a token's span includes the marks at its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_side
from .text import let, text_or_empty

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
INSTANCE = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"
CONTEXT = "context"
SPAN = "struct<kind:string,start:int,end:int>"
LONG_NUMBER = 8                  # digits from which a number is the same instance however it is written
#: Bytes of a hash and of a pattern as rows of a broadcast table.
HASH_BYTES, PATTERN_BYTES = 64, 512


def places(text: Column, pattern: str) -> Column:
    """(start, end, s) of all matches, in order. The starts are gathered as text, since a loop that carries an array
    copies it, with all its strings, at every step."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        return F.struct((begin + x["m"]).alias("at"), F.concat(acc["out"], begin.cast("string"), F.lit(",")).alias("out"))

    def starts(ms: Column) -> Column:
        lengths = F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.transform(ms, F.length).alias("m"))
        listed = F.aggregate(F.slice(lengths, F.lit(1), F.size(ms)), start, add, lambda acc: acc["out"])
        begins = F.slice(F.split(listed, ","), F.lit(1), F.size(ms)).cast("array<int>")
        return F.transform(F.arrays_zip(begins.alias("b"), ms.alias("s")), lambda x: F.struct(
            x["b"].alias("start"), (x["b"] + F.length(x["s"])).alias("end"), x["s"].alias("s")))

    return let(matches, starts)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right every second one doubled, less 9 if above 9."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")

    def value(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda part: part.rlike(IP_PART))
    if kind == "card":
        return F.length(_digits(s)).between(16, 19) & luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def normal(s: Column) -> Column:
    """What makes two instances the same: the digits of a long number without letters, else the text in lower case."""
    return F.when(~s.rlike(r"\p{L}|@") & (F.length(_digits(s)) >= LONG_NUMBER), _digits(s)).otherwise(F.lower(s))


def base_matches(text: Column) -> Column:
    """(kind, start, end, value) by kind as listed, then start. Texts without the marks of a kind are not searched for it."""
    digit = text.rlike("[0-9]")
    guards = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")) & digit}
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def of(kind: str, pattern: str) -> Column:
        held = F.filter(places(text, pattern), lambda x: _valid(kind, x["s"]))
        named = F.transform(held, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                                                     normal(x["s"]).alias("value")))
        return F.when(guards[kind] & text.rlike(pattern), named).otherwise(nothing)

    return F.concat(*[of(k, p) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)])


def instances(text: Column) -> Column:
    """(start, end, value, one, two, next_one, next_two, ended, begins): tokens with a digit or an at sign, the value trimmed of quotes,
    brackets and stops; the word and the two words before and after; where the token before ended and the next one begins."""
    nothing = F.array().cast("array<struct<start:int,end:int,value:string,one:string,two:string,next_one:string,next_two:string,"
                             "ended:int,begins:int>>")

    def blank(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))

    def shown(x: Column, i: Column, v: Column) -> Column:
        value = F.regexp_extract(x["s"], r"""(?s)^["'(<\[{,;:]*+(.*?)["')>\]},.;:!?]*$""", 1)
        found, gaps = v["found"], v["gaps"]
        # The two words before are among the gap before the token, the token before that, the gap before it and one more token; so after.
        before = F.reverse(F.concat_ws("", F.get(found, i - 2)["s"], F.get(gaps, i - 1), F.get(found, i - 1)["s"], F.get(gaps, i)))
        after = F.concat_ws("", F.get(gaps, i + 1), F.get(found, i + 1)["s"], F.get(gaps, i + 2), F.get(found, i + 2)["s"])
        one, two = (blank(F.reverse(F.regexp_extract(before, r"^\s*+" + words, 0))) for words in (r"\S++", r"\S++\s++\S++"))
        next_one, next_two = (blank(F.regexp_extract(after, r"^\s*+" + words, 0)) for words in (r"\S++", r"\S++\s++\S++"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(value).alias("value"), one.alias("one"), two.alias("two"),
                        next_one.alias("next_one"), next_two.alias("next_two"), F.get(found, i - 1)["end"].alias("ended"),
                        F.get(found, i + 1)["start"].alias("begins"))

    both = F.struct(places(text, INSTANCE).alias("found"), F.split(text, INSTANCE, -1).alias("gaps"))
    found = let(both, lambda v: F.transform(v["found"], lambda x, i: shown(x, i, v)))
    return F.when(text.rlike("[0-9@]"), found).otherwise(nothing)


def contexts() -> Column:
    """(side, words) of a row with the words around an instance. A match of several tokens has its words before at
    its first token (`first`) and its words after at its last one (`last`)."""
    each = [F.struct(F.lit(side).alias("side"), F.when(F.col(at), F.col(words)).alias("words"))
            for words, side, at in (("one", "before", "first"), ("two", "two before", "first"),
                                    ("next_one", "after", "last"), ("next_two", "two after", "last"))]
    return F.filter(F.array(*each), lambda c: F.coalesce(c["words"] != "", F.lit(False)))


def word_counts(texts: DataFrame, text: Column, wanted: DataFrame) -> DataFrame:
    """(hash, places): how often the words and pairs of neighbouring words with a hash in `wanted` stand in the texts."""
    words = F.transform(F.array_remove(F.split(text, r"\s+"), ""), F.lower)

    def hashes(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)))
        return F.concat(F.transform(w, lambda a: F.xxhash64(a)), F.slice(pairs, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))

    grams = texts.select(F.explode(let(words, hashes)).alias("hash"))
    return grams.join(small_side(wanted, HASH_BYTES), "hash", "left_semi").groupBy("hash").agg(F.count(F.lit(1)).alias("places"))


def score_patterns(edges: DataFrame, places_of, min_score: float, min_instances: int, damping: float, tolerance: float) -> DataFrame:
    """(side, words, score, instances) of the accepted patterns, from edges (side, words, value, n, seed).

    `places_of(wanted)` counts the hashes of words in all texts. A round joins the edges that are left with the scores
    of their instances and takes sums and maxima, so the patterns of a frequent instance are never listed together."""
    pattern = ["side", "words"]
    edges = cut(edges.groupBy(*pattern, "value").agg(F.sum("n").alias("n"), F.max("seed").alias("seed")))
    broad = cut(edges.groupBy(*pattern).agg(F.sum("n").alias("most"), F.count(F.lit(1)).alias("values"))
                .where(F.col("values") >= min_instances).withColumn("hash", F.xxhash64("words")))
    able = (broad.join(places_of(broad.select("hash").distinct()), "hash")
            .where(F.round(F.col("most") / (F.col("places") + damping), 9) >= min_score).select(*pattern, "places"))
    held = edges.groupBy("value", "side").agg(F.sum("n").alias("held"))
    live = edges.join(small_side(cut(able), PATTERN_BYTES), pattern)
    live = cut(live.join(held, ["value", "side"]).withColumn("share", F.col("n") / F.col("held")))
    scored = live.select("value", "seed").distinct().select("value", F.col("seed").cast("double").alias("score"))
    scored = scored.groupBy("value").agg(F.max("score").alias("score"))
    before = None
    while True:
        told = live.join(scored, "value").groupBy(*pattern, "places").agg(
            F.sum(F.col("n") * F.col("score")).alias("sum"), F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("instances"))
        now = cut(told.select(*pattern, F.round(F.col("sum") / (F.col("places") + damping), 9).alias("score"), "instances"))
        good = now.where((F.col("score") >= min_score) & (F.col("instances") >= min_instances))
        if before is None:
            rise = good.agg(F.max("score")).first()[0]
        else:
            rise = now.join(before.select(*pattern, F.col("score").alias("old")), pattern).agg(F.max(F.col("score") - F.col("old"))).first()[0]
        if rise is None or rise <= tolerance:
            return good
        before = now
        given = live.join(good.select(*pattern, F.col("score").alias("p")), pattern, "left").groupBy("value", "side").agg(
            F.sum(F.col("share") * F.coalesce("p", F.lit(0.0))).alias("p"), F.max("seed").alias("seed"))
        scored = given.groupBy("value").agg(F.greatest(F.max("p"), F.max("seed").cast("double")).alias("score"))


def find_personal(docs: DataFrame, key: str, text: str, min_score: float = 0.6, min_instances: int = 5, damping: float = 2.0,
                  tolerance: float = 0.001) -> DataFrame:
    """(key, base, context): arrays of (kind, start, end), a row per row of `docs`."""
    t = text_or_empty(text)
    rows = docs.select(F.col(key), F.xxhash64(t).alias("h"), base_matches(t).alias("base"), instances(t).alias("found"))
    rows = cut(rows.groupBy(key, "h", "base", "found").agg(F.count(F.lit(1)).cast("int").alias("rows")))
    each = rows.where(F.size("found") > 0).select(key, "h", "rows", "base", F.explode("found").alias("x")).select(
        key, "h", "rows", "x.*", F.get(F.filter("base", lambda b: (b["start"] < F.col("x.end")) & (F.col("x.start") < b["end"])), F.lit(0)).alias("b"))
    each = each.withColumn("seed", F.col("b").isNotNull()).withColumns({
        "first": ~F.col("seed") | (F.coalesce("ended", F.lit(-1)) <= F.col("b.start")),
        "last": ~F.col("seed") | F.coalesce(F.col("begins") >= F.col("b.end"), F.lit(True)),
        "instance": F.when(F.col("seed"), F.col("b.value")).otherwise(normal(F.col("value")))})
    edges = each.select(F.inline(contexts()), F.col("instance").alias("value"), F.col("rows").alias("n"), "seed")
    good = score_patterns(edges, lambda wanted: word_counts(docs, t, wanted), min_score, min_instances, damping, tolerance)
    good = small_side(good.select("side", "words"), PATTERN_BYTES)
    new = each.where(~F.col("seed")).select(key, "h", "start", "end", F.inline(contexts()))
    hits = new.join(good, ["side", "words"], "left_semi").select(key, "h", "start", "end").distinct()
    per_row = hits.groupBy(key, "h").agg(F.sort_array(F.collect_list(F.struct(
        F.lit(CONTEXT).alias("kind"), "start", "end"))).alias("context"))
    other = per_row.select(F.col(key).alias("_k"), F.col("h").alias("_h"), "context")
    joined = rows.join(other, F.col(key).eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h")), "left")
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return joined.select(key, plain.alias("base"), F.coalesce("context", F.array().cast(f"array<{SPAN}>")).alias("context"),
                         F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("_r")).drop("_r")
