"""Places where a user plugs in a model. The defaults are deterministic rules, so tests need no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[pd.Series], list]
Answerer = Callable[[str], str]
DIMENSIONS = 64


def hashed_words(texts: pd.Series) -> list:
    """Default encoder: a hashed bag of lower-cased words, scaled to length one."""
    rows = [[_place_and_sign(w) for w in re.findall(r"\w+", (text or "").lower())] for text in texts]
    m = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    found = np.array([x for row in rows for x in row], np.int64).reshape(-1, 2)
    np.add.at(m, (np.repeat(np.arange(len(rows)), [len(row) for row in rows]), found[:, 0]), found[:, 1].astype(np.float32))
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return list(np.divide(m, size, out=m, where=size > 0))


@lru_cache(maxsize=1 << 16)
def _place_and_sign(word: str) -> tuple[int, int]:
    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
    return h % DIMENSIONS, 1 if (h >> 32) & 1 else -1


def encode(df: DataFrame, text: str, into: str = "vec", encoder: Encoder = hashed_words) -> DataFrame:
    """Add the encoder's vector, computed in Arrow batches on the executors."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(encoder(b)))

    # Marked so that the optimizer never calls a model twice for one row.
    return df.withColumn(into, run.asNondeterministic()(F.col(text)))


def by_modality(df: DataFrame, modality: str, encoders: dict[str, Encoder], payload: str, into: str = "vec"
                ) -> DataFrame:
    """Route rows to the encoder of their modality; rows of an unknown modality keep a null vector."""
    out = df.where(~F.col(modality).isin(list(encoders)) | F.col(modality).isNull()).withColumn(
        into, F.lit(None).cast("array<float>"))
    for name, encoder in encoders.items():
        out = out.unionByName(encode(df.where(F.col(modality) == name), payload, into, encoder))
    return out


def prompt(template: str, **columns: Column | str) -> Column:
    """Fill `{name}` places of a template with columns."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[at:m.start()]))
        c = columns[m.group(1)]
        parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def echo_rule(text: str) -> str:
    """Default answerer: length and first word."""
    words = text.split()
    return f"{len(text)}:{words[0] if words else ''}"
