"""Secret scans: fixed patterns, and values in a credential's context that would take many guesses.

Patterns: `assign` (a credential's name, a separator and a value of six or more characters), `access` (AKIA keys) and
`hex` (24 or more digits), each leftmost and without overlaps within its kind.

Guess cost: a value is cut into words of a public vocabulary, dates, repeats, keyboard walks and single brute-force
characters; dynamic programming over its positions finds the cut with the fewest guesses. Values of any length are
costed whole, in time that grows with their length; words and repeated units may have up to 24 characters. A value in
quotes ends at the same quote (not after a backslash). Any other one ends at a blank, at `</`, or at one of `,;|` before
a name with `:` or `=`; quotes and `,;|<>` at its end are not part of it. Values in quotes that hold blanks are taken as bare.

A value after wider credential words (`pwd is ...`, `passphrase: ...`, `Bearer ...`, also as the last part of a longer
name, `aws_secret_access_key=...`) counts as a secret, kind `guess`, if that cost reaches `min_bits` and no single
pattern match holds it whole. Redaction also takes the rest of a weaker value that a pattern match cuts. The costs of
`assign` values are given, too.

Spans are code points, end exclusive. Null and empty texts have none.
"""

from __future__ import annotations

import base64
import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:int,end:int,bits:double>>"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The names of ASSIGN anywhere; others at the start of a name part: no letter before, or a capital after a small letter.
NAME = (r"""(?:password|passwd|secret|token|api_?key|"""
        r"""(?:(?<![A-Z])|(?-i:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))"""
        r"""(?:pwd|pass(?:phrase|code)?|credentials?|bearer|login|auth(?:[_-]?token)?|(?:private|access|secret|api)[_-]?key))""")
GIVES = r"""(?:\b["']?\x20*(?:[:=]|\x20is\x20|=>)\x20*|(?<=bearer)\x20+)"""
#: Up to the quote that opens the value, else up to a blank, a closing tag or the next named value.
QUOTED = "|".join(rf"""{q}(?:bearer\x20+)?((?:[^{q}\s\\]|\\\S){{6,}}){q}""" for q in "\"'")
BARE = r"""(?!"[^"\s]*"|'[^'\s]*')["']?(?:bearer\x20+)?((?:(?!</|[,;|]["']?[\w.-]+["']?\x20*[:=])\S){6,})"""
CONTEXT = re.compile(f"{NAME}{GIVES}(?:{QUOTED}|{BARE})", re.I | re.A)
AFTER = "\"',;|<>"
MIN_BITS = 45.0

ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "-/._"


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[str, int]:
    """Words of a ranks file, lower-cased, with their order in it: common words come early."""
    out: dict[str, int] = {}
    with open(path, "rb") as lines:
        for n, line in enumerate(lines):
            raw = base64.b64decode(line.split()[0])
            word = raw.decode("utf-8", "ignore").strip().lower()
            if len(word) >= 3 and word.isalpha() and word not in out:
                out[word] = n + 1
    return out


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def neighbours() -> frozenset[str]:
    """Pairs of characters that follow each other on a keyboard row, a keyboard column or in the alphabet."""
    out = set()
    for row in (*ROWS, ALPHABET):
        for a, b in zip(row[:-1], row[1:], strict=True):
            out |= {a + b, b + a}
    for upper, lower in zip(ROWS[:-1], ROWS[1:], strict=True):
        for i, b in enumerate(lower):
            for a in upper[i + (1 if upper is ROWS[0] else 0):][:2]:
                out |= {a + b, b + a}
    return frozenset(out)


def brute_bits(c: str) -> float:
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)


def case_bits(word: str) -> float:
    if word.islower():
        return 0.0
    return 1.0 if word.isupper() or (word[0].isupper() and word[1:].islower()) else 1.0 + sum(c.isupper() for c in word)


def date_bits(s: str) -> float | None:
    """Guesses for a date: years 1900 to 2099 alone, or day, month and year in any order with one separator or none."""
    if s.isascii() and s.isdigit():
        if len(s) == 4 and 1900 <= int(s) <= 2099:
            return math.log2(200)
        cuts = {6: ((2, 4),), 8: ((4, 6), (2, 4))}.get(len(s), ())
        parts = [(s[:a], s[a:b], s[b:]) for a, b in cuts]
    else:
        found = re.fullmatch(r"(\d{1,4})([-/._])(\d{1,2})\2(\d{1,4})", s, re.A)
        parts = [(found[1], found[3], found[4])] if found else []
    for a, b, c in parts:
        for year, month, day in ((a, b, c), (c, b, a), (c, a, b)):
            if len(year) in (2, 4) and 1 <= int(month) <= 12 and 1 <= int(day) <= 31 and (len(year) == 2 or 1900 <= int(year) <= 2099):
                return math.log2(200 * 372) + (0 if s.isdigit() else 2)
    return None


def guess_bits(value: str, words: dict[str, int], longest: int = 24) -> float:
    """log2 of the guesses for the cheapest cut of `value`."""
    n = len(value)
    low, near = value.lower(), neighbours()
    best = [0.0] + [math.inf] * n
    walk = 0                                    # neighbours in a row that end here
    starts: list[int] = []                      # where a walk that ends here may start; the last one is the cheapest
    run = [1] * (n + 1)                         # equal characters in a row that end before i
    for i in range(1, n + 1):
        best[i] = best[i - 1] + brute_bits(value[i - 1])
        walk = walk + 1 if i > 1 and low[i - 2:i] in near else 0
        if walk < 2:
            starts = []
        else:
            # log2 is concave: a start that an earlier one has caught up with never is the cheaper one again.
            left, least = [], math.inf
            for start in (*starts, i - 3):
                bits = best[start] + math.log2(len("".join(ROWS)) * (i - start)) + 1.5
                if bits < least:
                    left.append(start)
                    least = bits
            starts = left
            best[i] = min(best[i], least)
        run[i] = run[i - 1] + 1 if i > 1 and value[i - 1] == value[i - 2] else 1
        if run[i] >= 3:
            best[i] = min(best[i], best[i - run[i]] + brute_bits(value[i - 1]) + math.log2(run[i]))
        for length in range(2, min(longest, i) + 1):
            piece = low[i - length:i]
            rank = words.get(piece)
            if rank is not None:
                best[i] = min(best[i], best[i - length] + math.log2(rank + 1) + case_bits(value[i - length:i]))
            elif 4 <= length <= 10 and piece[0].isdigit() and (bits := date_bits(piece)) is not None:
                best[i] = min(best[i], best[i - length] + bits)
            # A unit that was just cut once, again: only the number of times has to be guessed.
            if i >= 2 * length and low[i - 2 * length:i - length] == piece:
                best[i] = min(best[i], best[i - length] + 1.0)
    return best[n]


def spans_of(text: str | None, words: dict[str, int], min_bits: float, rests: bool = False) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits) of all secrets; with `rests` also, as `guess`, values under `min_bits` that a pattern match cuts."""
    if not text:
        return []
    found = []
    separated = ":" in text or "=" in text
    if separated:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append(("assign", m.start(), m.end(), round(guess_bits(m[2], words), 3)))
    found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    base = list(found)
    low = text.lower()
    if separated or " is " in low or "bearer " in low:
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            if m.lastindex == 3:                # a bare value
                end = start + len(m[3].rstrip(AFTER))
                if end - start < 6:
                    continue
            met = [(a, b) for _, a, b, _ in base if a < end and start < b]
            if not any(a <= start and end <= b for a, b in met):
                bits = guess_bits(text[start:end], words)
                if bits >= min_bits or (rests and met):
                    found.append(("guess", start, end, round(bits, 3)))
    order = {k: i for i, k in enumerate((*KINDS, "guess"))}
    return sorted(found, key=lambda x: (x[1], order[x[0]], x[2]))


def find_secrets(text: Column, vocabulary_path: str | None = None, min_bits: float = MIN_BITS) -> Column:
    """All spans of a text by start, then kind; `bits` is the guess cost where there is one."""
    path = vocabulary_path or default_vocabulary()

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        words = vocabulary(path)
        return texts.map(lambda t: [dict(zip(("kind", "start", "end", "bits"), s, strict=True)) for s in spans_of(t, words, min_bits)],
                         na_action=None)

    return spans.asNondeterministic()(text)


def redact(text: Column, vocabulary_path: str | None = None, min_bits: float = MIN_BITS, mark: str = "[SECRET]") -> Column:
    """The text with every secret replaced by `mark`; overlapping spans become one. Null stays null."""
    path = vocabulary_path or default_vocabulary()

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for _, start, end, _ in spans_of(t, vocabulary(path), min_bits, rests=True):
            if start >= at:
                out += [t[at:start], mark]
            at = max(at, end)
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action=None).astype(object)

    return cleaned(text)


def scan(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    return docs.select(F.col(key), find_secrets(F.col(text).cast("string"), **options).alias("spans"))
