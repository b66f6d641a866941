"""Readers by name, for configurations that say in text how a dataset is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import captions, gaze

READERS: dict[str, Callable[..., DataFrame]] = {
    "captions": captions.read_captions,
    "snapshots": captions.read_snapshots,
    "dense_captions": captions.read_dense_captions,
    "srt": captions.read_srt,
    "gaze_csv": gaze.read_csv,
    "gaze_json": gaze.read_json,
}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    """Adds a reader `reader(spark, ...)`; a name stands for one reader only."""
    if name in READERS:
        raise ValueError(f"there is a reader named {name} already")
    READERS[name] = reader


def read(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    """What the reader `name` makes of the arguments."""
    if name not in READERS:
        raise KeyError(f"no reader named {name}; there are {', '.join(sorted(READERS))}")
    return READERS[name](spark, *args, **options)
