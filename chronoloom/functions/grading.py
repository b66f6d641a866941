"""Multiple-choice grading as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = ("A", "B", "C", "D")

# --- Fixed values: shapes of a long answer that name a choice, tried in this order ----------------
LEADING_LETTER = r"^\(?([A-Za-z])[.\)]?\s*"
DECISION = (r"(?i)(?:final answer|answer is|answer:|i (?:will |must |would )?(?:pick|choose|select|go with))"
            r"\s*(?:option\s*)?\**\(?([A-D])\)?\b")
BOLD = r"\*\*\(?([A-D])\)?(?:[.:)]\s*[^*]{0,80})?\*\*"
LINE_START = r"(?:^|\n)\s*\(?([A-D])[.)]\s"
# --------------------------------------------------------------------------------------------------


def choice_map(*choices: Column | str) -> Column:
    """choice_a.. -> map A..; empty and null choices are left out."""
    values = [F.col(c) if isinstance(c, str) else c for c in choices]
    full = F.map_from_arrays(F.array(*[F.lit(x) for x in LETTERS[:len(values)]]), F.array(*values))
    return F.map_filter(full, lambda k, v: v.isNotNull() & (v != ""))


def choice_prompt(choices: Column | str) -> Column:
    """`A. text` lines ordered by letter."""
    entries = F.array_sort(F.map_entries(choices))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def answer_key(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(_strip(F.lower(t)), r"[.,)]+$", "")


def leading_letter(text: Column | str) -> Column:
    t = _strip(F.col(text) if isinstance(text, str) else text)
    return F.upper(F.nullif(F.regexp_extract(t, LEADING_LETTER, 1), F.lit("")))


def is_correct(response: Column | str, gold: Column | str, choices: Column | str) -> Column:
    """Equal text, equal first letter, or `A. text` / `(A) text`."""
    gold = F.col(gold) if isinstance(gold, str) else gold
    said, text = answer_key(response), F.try_element_at(F.col(choices) if isinstance(choices, str)
                                                         else choices, gold)
    return F.coalesce(
        (said == answer_key(text)) | F.coalesce(leading_letter(response) == gold, F.lit(False))
        | (said == answer_key(F.concat(gold, F.lit(". "), text)))
        | (said == answer_key(F.concat(F.lit("("), gold, F.lit(") "), text))), F.lit(False))


def _last(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.upper(F.get(found, F.size(found) - 1))


def lenient_letter(response: Column | str, choices: Column | str) -> Column:
    """Leading letter; else last match of the first pattern that matches; else the one quoted choice."""
    text = F.col(response) if isinstance(response, str) else response
    options = F.col(choices) if isinstance(choices, str) else choices
    lead = leading_letter(text)
    lead = F.when(F.array_contains(F.map_keys(options), lead), lead)
    quoted = F.filter(F.map_entries(options),
                      lambda e: F.contains(F.lower(text), answer_key(e["value"])))
    only = F.when(F.size(quoted) == 1, quoted[0]["key"])
    return F.coalesce(lead, *[_last(text, p) for p in (DECISION, BOLD, LINE_START)], only)


def is_correct_lenient(response: Column | str, gold: Column | str, choices: Column | str) -> Column:
    gold = F.col(gold) if isinstance(gold, str) else gold
    return is_correct(response, gold, choices) | F.coalesce(
        lenient_letter(response, choices) == gold, F.lit(False))
