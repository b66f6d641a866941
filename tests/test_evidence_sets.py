"""Evidence that many triples take over is kept once, not with every triple."""

import os

import numpy as np
from pyspark.sql import functions as F

from chronoloom import hooks
from chronoloom.operators import consolidate as C
from chronoloom.session import shared_dir


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_taken_over_evidence_is_written_once(spark):
    long = [f"document-{i:05d}" for i in range(2000)]
    rows = [("1", "a", "p", "old", long)] + [("2", "a", "p", f"new {i}", [f"own-{i}"]) for i in range(400)]
    df = spark.createDataFrame(rows, "ts string, s string, p string, o string, evidence array<string>")
    folder = shared_dir(spark).removeprefix("file:")
    before = folder_bytes(folder)
    versions = C.consolidate_versions(df, encoder=lambda texts: [np.array([1.0, 0.0], np.float32) for _ in texts])
    assert folder_bytes(folder) - before < 3_000_000        # 400 lists of 2000 names are over 20 MB
    got = versions.groupBy("valid_from", F.col("valid_to").alias("upto")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("evidence")).alias("e")).collect()
    assert sorted(map(tuple, got)) == [("1", "2", 1, 2000), ("2", None, 400, 400 * 2001)]
    assert versions.where("o = 'new 7'").first()["evidence"] == sorted([*long, "own-7"])


def test_copies_and_missing_parts(spark):
    """Equal copies of different stamps go together; a row without an object is never closed, but its evidence is taken over."""
    rows = [("1", "a", "p", "x", ["e1"]), ("1", "a", "p", None, ["e2"]), ("2", "a", "p", "y", ["e3", "e3", "e0"]), ("2", "b", "p", "z", None), (None, "a", "p", "q", ["e9"])]
    df = spark.createDataFrame(rows, "ts string, s string, p string, o string, evidence array<string>")
    got = C.consolidate_versions(df, encoder=lambda texts: [np.array([1.0, 0.0], np.float32) for _ in texts]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        ("a", "p", "x", ["e1"], "1", "2"), ("a", "p", None, ["e2"], "1", None), ("a", "p", "y", ["e0", "e1", "e2", "e3"], "2", None), ("b", "p", "z", None, "2", None)]))


def test_words_are_hashed_alike():
    import pandas as pd
    a, b, empty = hooks.hashed_words(pd.Series(["Tea and tea", "and", None]))
    assert not empty.any() and a.dtype == np.float32 and abs(float(a @ a) - 1) < 1e-6 and np.abs(b).sum() == 1
    assert (hooks.hashed_words(pd.Series(["and"]))[0] == b).all()
