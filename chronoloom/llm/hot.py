"""Joins of very many rows with a table of one row per key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES

#: A key is hot if it holds more than one in so many of the counted rows, so there are never more hot keys than this.
SHARE = 1000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, row_bytes: int = 64,
                 limit: int = BROADCAST_BYTES) -> DataFrame:
    """The inner join of `rows` with `table`, which has each of the `keys` once and in `count` how many rows hold it.

    A table that a bounded count shows to be small is broadcast whole. Of a larger one only the hot keys are, at most
    `SHARE` of them; rows with other keys are shuffled, and none of those keys holds more than 1/SHARE of the rows.
    `table` is read several times and should be written or checkpointed. Null keys join nothing.
    """
    most = max(1, limit // row_bytes)
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), keys)
    total = table.agg(F.sum(count)).first()[0]
    is_hot = F.col(count) * SHARE > F.lit(total)
    hot = F.broadcast(table.where(is_hot))
    others = rows.join(F.broadcast(table.where(is_hot).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(others.join(table.where(~is_hot), keys))
