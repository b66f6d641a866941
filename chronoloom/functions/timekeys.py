"""Time algebra over `DAYn` + `HHMMSSFF` stamps, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def padded(time: Column | str) -> Column:
    return F.lpad(_col(time).cast("string"), 8, "0")


def day_number(date: Column | str) -> Column:
    """Digits after the `DAY` prefix (any case); days above 9 keep all their digits."""
    return F.regexp_extract(_col(date).cast("string"), r"(\d+)", 1).try_cast("int")


def ts_key(date: Column | str, time: Column | str) -> Column:
    return F.concat(day_number(date).cast("string"), padded(time)).cast("bigint")


def ts_display(key: Column | str) -> Column:
    """`111094300` -> `DAY1 11:09:43`; keys too short to hold a day are returned as they are."""
    s = _col(key).cast("string")
    n = F.length(s)

    def part(back: int) -> Column:
        return F.substring(s, -back, 2)

    shown = F.concat(F.lit("DAY"), F.substring(s, F.lit(1), n - 8), F.lit(" "),
                     part(8), F.lit(":"), part(6), F.lit(":"), part(4))
    return F.when(n < 9, s).otherwise(shown)


def clock_seconds(time: Column | str) -> Column:
    """Whole seconds of the day; the two last digits are dropped."""
    t = padded(time)
    return (F.substring(t, 1, 2).cast("int") * 3600 + F.substring(t, 3, 2).cast("int") * 60
            + F.substring(t, 5, 2).cast("int"))


def week_seconds(date: Column | str, time: Column | str) -> Column:
    """Seconds on one axis over all days; the last two digits are hundredths of a second."""
    t = padded(time)
    return (day_number(date) * DAY_SECONDS + clock_seconds(time)).cast("double") \
        + F.substring(t, 7, 2).cast("int") / F.lit(100.0)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("bigint").cast("string"), 2, "0")


def seconds_to_clock(sec: Column | str) -> Column:
    """Whole seconds of a day -> `HHMMSS00`."""
    s = _col(sec).cast("bigint")
    return F.concat(_two(F.floor(s / 3600)), _two(F.floor(s % 3600 / 60)), _two(s % 60), F.lit("00"))


def clock_carry(stamp: Column | str) -> Column:
    """Base-60 carry on an HHMMSSFF integer after 30 s were added to it."""
    v = _col(stamp)
    v = F.when(v % 10000 == 6000, v + 4000).otherwise(v)
    return F.when(v % 1000000 == 600000, v + 400000).otherwise(v)


def caption_start(sec: Column | str) -> Column:
    return seconds_to_clock(F.greatest(F.floor(_col(sec) + F.lit(1e-9)), F.lit(0)))


def caption_end(sec: Column | str) -> Column:
    return seconds_to_clock(F.greatest(F.ceil(_col(sec) - F.lit(1e-9)), F.lit(0)))


def clock_text(sec: Column | str) -> Column:
    """`HH:MM:SS`, with `.mmm` behind it only when the rounded milliseconds are not zero."""
    ms = F.greatest(F.bround(_col(sec) * 1000).cast("bigint"), F.lit(0))
    whole, rest = F.floor(ms / 1000), ms % 1000
    base = F.concat_ws(":", _two(F.floor(whole / 3600)), _two(F.floor(whole % 3600 / 60)), _two(whole % 60))
    return F.when(rest == 0, base).otherwise(F.concat(base, F.lit("."), F.lpad(rest.cast("string"), 3, "0")))


#: The stamp shapes that occur in query texts and annotations.
RANGE_STAMP = r"(?i)DAY\s*(\d+)\s+(\d{1,2}:\d{2}:\d{2})"
RANGE_TEXT = r"(?i)DAY\s*\d+\s+\d{1,2}:\d{2}:\d{2}\s*-\s*DAY\s*\d+\s+\d{1,2}:\d{2}:\d{2}"
WINDOW_TEXT = r"^DAY(\d+)\s+(\d{2}:\d{2}:\d{2})-(\d{2}:\d{2}:\d{2})"
CHAIN_STAMP = r"(?i)DAY(\d+)_(\d{6,8})"


def is_time_range(text: Column | str) -> Column:
    return _col(text).rlike(RANGE_TEXT)


def _stamp_key(day: Column, clock: Column) -> Column:
    return F.concat(day, F.lpad(F.regexp_replace(clock, ":", ""), 6, "0"), F.lit("00")).try_cast("bigint")


def time_range(text: Column | str) -> Column:
    """Struct (start, end) of keys from the first two stamps; null where fewer than two occur."""
    t = _col(text)
    days = F.regexp_extract_all(t, F.lit(RANGE_STAMP), 1)
    clocks = F.regexp_extract_all(t, F.lit(RANGE_STAMP), 2)
    pair = F.struct(_stamp_key(F.get(days, F.lit(0)), F.get(clocks, F.lit(0))).alias("start"),
                    _stamp_key(F.get(days, F.lit(1)), F.get(clocks, F.lit(1))).alias("end"))
    return F.when(F.size(days) >= 2, pair)


def window_parts(text: Column | str) -> Column:
    """`DAY1 17:25:51-17:25:53` -> struct (day, start_sec, end_sec); null if it does not fit."""
    t = _col(text)

    def seconds(group: int) -> Column:
        return clock_seconds(F.concat(F.regexp_replace(F.regexp_extract(t, WINDOW_TEXT, group), ":", ""),
                                      F.lit("00")))

    parts = F.struct(F.regexp_extract(t, WINDOW_TEXT, 1).try_cast("int").alias("day"),
                     seconds(2).alias("start_sec"), seconds(3).alias("end_sec"))
    return F.when(t.rlike(WINDOW_TEXT), parts)


def chain_points(date: Column | str, time: Column | str) -> Column:
    """All moments named by `stamp[DAYd_stamp]*` on the week axis; separate points, not ranges."""
    t = F.trim(F.coalesce(_col(time), F.lit("")))
    head = F.regexp_extract(t, r"^(\d*)", 1)
    tail = F.arrays_zip(F.regexp_extract_all(t, F.lit(CHAIN_STAMP), 1).alias("day"),
                        F.regexp_extract_all(t, F.lit(CHAIN_STAMP), 2).alias("stamp"))
    first = F.when(head != "", F.array(week_seconds(date, head))).otherwise(F.array().cast("array<double>"))
    return F.concat(first, F.transform(tail, lambda x: week_seconds(x["day"], x["stamp"])))


def target_points(date: Column | str, time: Column | str, time_list: Column | str) -> Column:
    """Annotation -> moments: an explicit list wins over the chain text; nothing given -> empty."""
    listed = F.transform(_col(time_list), lambda x: week_seconds(date, x))
    return F.when(F.size(_col(time_list)) > 0, listed).otherwise(chain_points(date, time))


def target_span_legacy(date: Column | str, time: Column | str) -> Column:
    """Older reading: the head stamp and the first chained stamp bound one continuous range."""
    points = chain_points(date, time)
    return F.when(F.size(points) > 0, F.struct(
        F.element_at(points, 1).alias("start"),
        F.coalesce(F.get(points, F.lit(1)), F.element_at(points, 1)).alias("end")))


def gap_bin(query_day: Column | str, target_day: Column | str) -> Column:
    gap = _col(query_day) - _col(target_day)
    return (F.when(gap.isNull(), "na").when(gap <= 0, "0").when(gap == 1, "1").otherwise("2+"))


#: Fixed value: a reminder about something less than two minutes old counts as "just before".
NEAR_SECONDS = 120


def link_group(kind: Column | str, gap_sec: Column | str, source: Column | str) -> Column:
    """Nature of the past moment a linked event asks for."""
    return (F.when(_col(kind) == "long_term_link", "long_ago")
            .when((_col(kind) == "task_reminder") & (_col(gap_sec) < NEAR_SECONDS), "just_before")
            .when(_col(kind) == "task_reminder", "minutes_before")
            .when(_col(source) == "i_do_steps", "own_action").otherwise("heard_speech"))
