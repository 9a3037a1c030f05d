"""Label mapping as CASE expressions (codegen-friendly, no map lookups)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credo.constants import CS_UNKNOWN_HUNDREDTHS, CS_WEIGHT_HUNDREDTHS, LABEL_MAP
from credo.functions.text import strip_ws


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_label(c) -> Column:
    """lower + strip, as done once when statements are loaded."""
    return F.lower(strip_ws(_c(c)))


def binary_label(c) -> Column:
    """Six-class label -> 1 (TRUE) / 0 (FALSE); anything else -> NULL."""
    expr = None
    for name, y in LABEL_MAP.items():
        expr = (F.when(_c(c) == name, F.lit(y)) if expr is None
                else expr.when(_c(c) == name, F.lit(y)))
    return expr.cast("int")


def cs_weight_hundredths(c) -> Column:
    """Falsehood weight in integer hundredths (exact sums); unknown -> 50."""
    expr = None
    for name, w in CS_WEIGHT_HUNDREDTHS.items():
        expr = (F.when(_c(c) == name, F.lit(w)) if expr is None
                else expr.when(_c(c) == name, F.lit(w)))
    return expr.otherwise(F.lit(CS_UNKNOWN_HUNDREDTHS)).cast("int")


def cs_weight(c) -> Column:
    """Falsehood weight as a double in [0, 1]."""
    return cs_weight_hundredths(c) / F.lit(100.0)
