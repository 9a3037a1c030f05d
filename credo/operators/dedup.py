"""De-duplication of statements before any split.

Type A: one row per (statement, label) -- the one with the smallest row key
        (the explicit stand-in for "first in file order").  NULLs compare
        equal.
Type B: every row of a statement seen with more than one distinct non-null
        label is dropped; a NULL statement is never contradictory.

Plan (skew-safe): Type A is a group-by with map-side partial aggregation, so
a statement that holds a third of all rows is pre-reduced in every map task
before the shuffle instead of landing whole in one task.  After Type A a
statement has at most one row per distinct label, so the Type B window over
``statement`` has bounded partitions.  ``deduplicate`` does both in one
group-by over ``statement``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = "row_key"


def _payload(df: DataFrame, key: str) -> list[str]:
    """The columns of a row beside statement and label, the key first."""
    others = [c for c in df.columns if c not in ("statement", "label")]
    if key not in others:
        raise ValueError(f"dedup needs a unique row key column {key!r}")
    return [key] + [c for c in others if c != key]


def _type_a(df: DataFrame, key: str = KEY) -> DataFrame:
    """Type A with the multiplicity of each kept row in ``_n``."""
    payload = _payload(df, key)
    kept = (df.groupBy("statement", "label")
              .agg(F.min(F.struct(*payload)).alias("_w"), F.count(F.lit(1)).alias("_n")))
    return kept.select(*[F.col("_w." + c).alias(c) if c in payload else F.col(c)
                         for c in df.columns], "_n")


def dedup_exact(df: DataFrame, key: str = KEY) -> DataFrame:
    """Type A only."""
    return _type_a(df, key).drop("_n")


def _flag_contradictory(a: DataFrame) -> DataFrame:
    w = Window.partitionBy("statement")
    lo = F.min("label").over(w)
    hi = F.max("label").over(w)
    keep = F.col("statement").isNull() | lo.isNull() | (lo == hi)
    return a.withColumn("_keep", keep)


def dedup_contradictory(df: DataFrame) -> DataFrame:
    """Type B only (expects (statement, label) pairs already unique)."""
    return _flag_contradictory(df).filter("_keep").drop("_keep")


def deduplicate(df: DataFrame, key: str = KEY) -> DataFrame:
    """Type A, then Type B (the order matters), in one shuffle.

    A statement that stays has one label and perhaps rows without one, so two
    smallest rows and the least and greatest label are all that is kept of it.
    NULL statements are kept per label, hence grouped by it.
    """
    payload, known = _payload(df, key), F.col("label").isNotNull()
    row = F.struct(*payload)
    one = df.groupBy("statement", F.when(F.col("statement").isNull(), F.col("label")).alias("_alone")).agg(
        F.min("label").alias("_lo"), F.max("label").alias("_hi"),
        F.min(F.when(known, row)).alias("_with"), F.min(F.when(~known, row)).alias("_without"))
    one = one.filter(F.col("_lo").isNull() | (F.col("_lo") == F.col("_hi")))
    both = F.array(F.struct(F.col("_lo").alias("label"), F.col("_with").alias("w")),
                   F.struct(F.lit(None).cast(df.schema["label"].dataType).alias("label"), F.col("_without").alias("w")))
    kept = one.select("statement", F.explode(F.filter(both, lambda x: x["w"].isNotNull())).alias("_x"))
    return kept.select(*[F.col("_x.w." + c).alias(c) if c in payload else F.col("_x.label").alias(c) if c == "label" else F.col(c)
                         for c in df.columns])


def dedup_report(df: DataFrame, key: str = KEY) -> DataFrame:
    """One row: n_before, n_after_a, n_after_b and the two differences."""
    flagged = _flag_contradictory(_type_a(df, key))
    r = flagged.agg(
        F.sum("_n").cast("bigint").alias("n_before"),
        F.count(F.lit(1)).cast("bigint").alias("n_after_a"),
        F.sum(F.col("_keep").cast("int")).cast("bigint").alias("n_after_b"),
    )
    return r.select(
        "n_before", "n_after_a", "n_after_b",
        (F.col("n_before") - F.col("n_after_a")).alias("removed_a"),
        (F.col("n_after_a") - F.col("n_after_b")).alias("removed_b"),
    )
