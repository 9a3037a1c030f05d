"""Scoring-side scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credo.constants import LONG_Z, SHORT_Z


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid_prob(logit) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(logit)))


def decide(prob, threshold) -> Column:
    """'TRUE' when prob >= threshold (inclusive), else 'FALSE'; NULL for a NULL prob."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(_c(prob) >= t, F.lit("TRUE")).when(_c(prob).isNotNull(), F.lit("FALSE"))


def confidence_pct(prob, label) -> Column:
    """Percent for the predicted class, rounded half-to-even."""
    p = _c(prob)
    v = F.when(_c(label) == "TRUE", p * F.lit(100.0)).otherwise((F.lit(1.0) - p) * F.lit(100.0))
    return F.bround(v, 0).cast("int")


def len_norm(length, mean, std) -> Column:
    return (_c(length) - mean) / std


def length_bucket(z) -> Column:
    return (F.when(_c(z) > LONG_Z, F.lit("unusually long"))
            .when(_c(z) < SHORT_Z, F.lit("unusually short"))
            .otherwise(F.lit("typical length")))
