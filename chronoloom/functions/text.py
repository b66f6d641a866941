"""Text and identifier expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- Fixed values: characters that text cleaning removes or unifies -------------------------------
CONTROLS = ("\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008\u000e\u000f\u0011"
            "\u0012\u0013\u0014\u0015\u0016\u0017\u0018\u0019\u001a\u001b")
SOFT_HYPHEN = "­"
TO_SPACE = "\u000b\u000c\u0085"
TO_HYPHEN = "‐‑⁃‒–—―−－⁻"
TO_DOUBLE_QUOTE = "“”„‟"
TO_SINGLE_QUOTE = "‘’‚‛՚Ꞌꞌ＇`´′‵"
TO_SLASH = "⁄∕"
#: Characters replaced by several characters, in order.
TO_STRING = (("″", "''"), ("‶", "''"), ("‴", "'''"), ("‷", "'''"),
             ("⁗", "''''"), ("…", "..."), (" . . . ", " ... "))
#: Fixed value: ASCII punctuation.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
# --------------------------------------------------------------------------------------------------


def unicode_normalize(text: Column | str) -> Column:
    """Drop control characters, unify dashes, quotes, primes, slashes and the ellipsis."""
    single = TO_SPACE + TO_HYPHEN + TO_DOUBLE_QUOTE + TO_SINGLE_QUOTE + TO_SLASH
    onto = (" " * len(TO_SPACE) + "-" * len(TO_HYPHEN) + '"' * len(TO_DOUBLE_QUOTE)
            + "'" * len(TO_SINGLE_QUOTE) + "/" * len(TO_SLASH))
    out = F.translate(_col(text), single + CONTROLS + SOFT_HYPHEN, onto)
    for old, new in TO_STRING:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def entity_normalize(text: Column | str) -> Column:
    """Lower case; anything but ASCII letters, digits and spaces becomes a space; ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), "[^A-Za-z0-9 ]", " "))


def answer_normalize(text: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(_col(text)), PUNCTUATION, "")
    bare = F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def nfkc_squeeze(text: Column | str) -> Column:
    """NFKC (there is no built-in), then runs of white space become one space."""
    return F.trim(F.regexp_replace(_nfkc(_col(text)), r"(?U)\s+", " "))


def hash_id(text: Column | str, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.md5(_col(text).cast("binary")))


def _quoted(name: Column) -> Column:
    return F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|#\-])", r"\\$1")


def speaker_name(person: Column | str) -> Column:
    """`P1_ANNA` -> `Anna`; an id without an underscore is its own name."""
    p = _col(person)
    tail = F.regexp_replace(p, "^[^_]*_", "")
    return F.initcap(F.replace(F.when(tail == "", p).otherwise(tail), F.lit("_"), F.lit(" ")))


def first_person(text: Column | str, name: Column | str) -> Column:
    """Rewrite the wearer's own name: `Name:` goes, `Name's` -> my, `Name` -> I (any case, whole words)."""
    word = _quoted(_col(name))
    out = F.regexp_replace(_col(text), F.concat(F.lit(r"(?iU)(?<!\w)"), word, F.lit(r":\s*")), F.lit(""))
    out = F.regexp_replace(out, F.concat(F.lit(r"(?iU)(?<!\w)"), word, F.lit(r"'s(?!\w)")), F.lit("my"))
    return F.regexp_replace(out, F.concat(F.lit(r"(?iU)(?<!\w)"), word, F.lit(r"(?!\w)")), F.lit("I"))


def title_text(title: Column | str, text: Column | str) -> Column:
    """Title without trailing dots and spaces, a full stop, then the text; no title, no change."""
    t, body = _col(title), _col(text)
    return F.when(F.coalesce(t, F.lit("")) == "", body).otherwise(
        F.concat(F.regexp_replace(t, r"[. ]+$", ""), F.lit(". "), body))


def file_stem(path: Column | str) -> Column:
    name = F.element_at(F.split(_col(path), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def clip_start_seconds(path: Column | str) -> Column:
    """Seconds since midnight named by a trailing `_HHMMSSFF` of the file stem; null without one."""
    stamp = F.regexp_extract(file_stem(path), r"_(\d{8})$", 1)

    def part(i: int) -> Column:
        return F.substring(stamp, i, 2).try_cast("int")

    return part(1) * 3600 + part(3) * 60 + part(5) + part(7) / F.lit(100.0)


def remap_prefix(path: Column | str, old: str, new: str) -> Column:
    p = _col(path)
    return F.when(p.startswith(old), F.concat(F.lit(new), F.substring(p, F.lit(len(old) + 1), F.length(p)))
                  ).otherwise(p)


def first_label(labels: Column | str) -> Column:
    return F.element_at(F.split(F.trim(_col(labels)), r"\s+"), 1)


def top_category(label: Column | str) -> Column:
    """Part of a category name before its first dot or dash."""
    return F.element_at(F.split(_col(label), r"[.\-]"), 1)


def token_count(text: Column | str) -> Column:
    return F.size(F.split(_col(text), "[^a-zA-Z]"))
