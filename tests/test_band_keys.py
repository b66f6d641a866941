"""Band hashes leave the task a few texts at a time."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from chronoloom.operators import dedup as D


def test_band_keys_by_hand_in_small_slices(spark):
    rows = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else " ".join(f"w{(i * j) % 11}" for j in range(3 + i % 9))) for i in range(60)]
    hashed = spark.createDataFrame(rows, "id bigint, text string").select("id", D.token_hashes(F.col("text"), 5).alias("hashes")).cache()
    a, b = D.coefficients()
    want = {}
    for r in hashed.collect():
        if r["hashes"]:
            x = np.unique(np.frombuffer(bytes(r["hashes"]), "<u4")).astype(np.uint64)
            low = D.signature(x, a, b)
            want[r["id"]] = [hashlib.md5(low[i * 10:(i + 1) * 10].tobytes()).hexdigest() for i in range(25)]
    keyed = D.band_keys(hashed, at_once=4)
    assert 20 < len(want) < 60 and {r["id"]: r["keys"] for r in keyed.collect()} == want
    assert "MapInArrow" in keyed._jdf.queryExecution().executedPlan().toString()
