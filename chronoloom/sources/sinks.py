"""Writers for partitioned data sets and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, column: str, path: str, files_per_value: int = 8) -> None:
    """Parquet below one folder per value. Rows are salted, so a dominant value is not written by one task."""
    salted = df.repartition(column, F.pmod(F.xxhash64(*df.columns), F.lit(files_per_value)))
    salted.write.partitionBy(column).parquet(path)


def write_results(rows: DataFrame, scores: DataFrame, predictions: DataFrame, path: str) -> dict[str, str]:
    """Per-question JSON lines and CSV, score JSON, prediction JSON lines."""
    at = {k: f"{path}/{k}" for k in ("questions_json", "questions_csv", "scores_json", "predictions_jsonl")}
    rows.write.json(at["questions_json"])
    rows.write.option("header", True).csv(at["questions_csv"])
    scores.write.json(at["scores_json"])
    predictions.write.json(at["predictions_jsonl"])
    return at
