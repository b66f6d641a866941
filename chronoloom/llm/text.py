"""Shared column expressions over whole texts, and hashing votes for fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Counters of two bits share a long, 32 bits each, so a text may hold 2^32 - 1 units of weight.
LANES = 32
PAIR_OF_BITS = 0x0000000100000001


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once per row even where `body` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bit_counts(hashed: Column, weight: Column | None, prefix: str) -> list[Column]:
    """32 sums; sum j counts bit j in its low half and bit 32 + j in its high half."""
    out = []
    for j in range(LANES):
        pair = F.shiftrightunsigned(hashed, j).bitwiseAND(F.lit(PAIR_OF_BITS))
        out.append(F.sum(pair if weight is None else pair * weight).alias(f"{prefix}{j}"))
    return out


def majority(prefix: str, total: Column) -> Column:
    """The 64-bit fingerprint with the bits that hold more than half of `total`."""
    bits = None
    for j in range(LANES):
        lane = F.col(f"{prefix}{j}")
        for bit, count in ((j, lane.bitwiseAND(F.lit(0xFFFFFFFF))), (LANES + j, F.shiftrightunsigned(lane, 32))):
            value = 1 << bit if bit < 63 else -(1 << 63)
            one = F.when(count * 2 > total, F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            bits = one if bits is None else bits.bitwiseOR(one)
    return bits


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
