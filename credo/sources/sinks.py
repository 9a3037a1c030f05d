"""Prediction outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credo.functions.scoring import decide


def predictions(scored: DataFrame, threshold) -> DataFrame:
    """row_key, prediction, probability (4 decimals, half-even)."""
    return scored.select("row_key", decide("prob", threshold).alias("prediction"),
                         F.bround("prob", 4).alias("probability"))


def preview(pred: DataFrame, n: int = 20) -> DataFrame:
    """The first n predictions by row key (a top-n report)."""
    return pred.orderBy("row_key").limit(n)


def write_predictions(pred: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write predictions as parquet; a new path per run keeps it idempotent."""
    pred.write.mode(mode).parquet(path)
