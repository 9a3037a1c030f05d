"""Exact classification metrics over a scored table (columns y, prob).

Counts-based metrics come from one aggregation of four conditional counts;
rows without a label or a probability belong to none of them.
AUC is exact (ties count half) without a global sort: probabilities are
first reduced to one row per distinct value (partial aggregation), then
prefix sums of negatives are built in three levels -- per fixed-width
probability bucket (a bounded table), per part of a bucket (for models that
crowd their scores into a few buckets) and inside each part (one window
partition per part, run in parallel).  The numerator is
accumulated as an exact DECIMAL(38,0), so the result does not depend on the
order in which partitions are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credo.functions.scoring import decide

AUC_BUCKETS = 1 << 16


def _pred(prob: Column, threshold) -> Column:
    return (decide(prob, threshold) == "TRUE").cast("int")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet, too; the keys come from the left."""
    names = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right, on, how).drop(*names.values())


def confusion_counts(df: DataFrame, threshold, group_cols=(), y: str = "y", prob: str = "prob",
                     pred: Column | None = None) -> DataFrame:
    p = _pred(F.col(prob), threshold) if pred is None else pred
    yy = F.col(y)
    return df.groupBy(*group_cols).agg(
        F.sum(F.when((yy == 0) & (p == 0), 1).otherwise(0)).cast("bigint").alias("tn"),
        F.sum(F.when((yy == 0) & (p == 1), 1).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when((yy == 1) & (p == 0), 1).otherwise(0)).cast("bigint").alias("fn"),
        F.sum(F.when((yy == 1) & (p == 1), 1).otherwise(0)).cast("bigint").alias("tp"),
    )


def confusion_matrix(df: DataFrame, threshold, y: str = "y", prob: str = "prob") -> DataFrame:
    """Always 2x2: (actual, predicted, n)."""
    c = confusion_counts(df, threshold, (), y, prob)
    return c.selectExpr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, n)")


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def metric_columns() -> dict[str, Column]:
    """Metric expressions over tn/fp/fn/tp columns (0 when undefined,
    balanced accuracy averaged over the classes present in y)."""
    tn, fp, fn, tp = _d("tn"), _d("fp"), _d("fn"), _d("tp")
    n = tn + fp + fn + tp
    rec1 = F.try_divide(tp, tp + fn)
    rec0 = F.try_divide(tn, tn + fp)
    ba = F.try_divide(F.coalesce(rec1, F.lit(0.0)) + F.coalesce(rec0, F.lit(0.0)),
                      rec1.isNotNull().cast("double") + rec0.isNotNull().cast("double"))
    denom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(denom == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / denom)
    return {
        "accuracy": F.try_divide(tp + tn, n),
        "balanced_accuracy": ba,
        "mcc": mcc,
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)),
    }


def _metric(df: DataFrame, threshold, name: str, group_cols=()) -> DataFrame:
    c = confusion_counts(df, threshold, group_cols)
    return c.select(*group_cols, F.round(metric_columns()[name], 6).alias(name))


def accuracy(df, threshold, group_cols=()):
    return _metric(df, threshold, "accuracy", group_cols)


def balanced_accuracy(df, threshold, group_cols=()):
    return _metric(df, threshold, "balanced_accuracy", group_cols)


def mcc(df, threshold, group_cols=()):
    return _metric(df, threshold, "mcc", group_cols)


def f1(df, threshold, group_cols=()):
    return _metric(df, threshold, "f1", group_cols)


def precision(df, threshold, group_cols=()):
    return _metric(df, threshold, "precision", group_cols)


def recall(df, threshold, group_cols=()):
    return _metric(df, threshold, "recall", group_cols)


def auc_roc(df: DataFrame, group_cols=(), y: str = "y", prob: str = "prob") -> DataFrame:
    """Exact ROC AUC per group (NULL when a group has only one class)."""
    g = list(group_cols)
    df = df.filter(F.col(prob).isNotNull() & F.col(y).isNotNull())
    p = (df.groupBy(*g, F.col(prob).alias("_p"))
           .agg(F.sum(F.col(y)).cast("bigint").alias("_pos"),
                F.sum(1 - F.col(y)).cast("bigint").alias("_neg")))
    # any score, also outside [0, 1], in order
    place = (F.lit(1.0) + F.col("_p") / (F.lit(1.0) + F.abs("_p"))) * (AUC_BUCKETS // 2)
    p = p.withColumn("_b", F.floor(place).cast("int"))
    p = p.withColumn("_s", F.floor((place - F.col("_b")) * AUC_BUCKETS).cast("int"))
    before = (Window.unboundedPreceding, -1)
    # levels 1 and 2: negatives per part -> offsets inside the bucket and of the bucket
    parts = p.groupBy(*g, "_b", "_s").agg(F.sum("_neg").alias("_sneg"))
    bt = parts.groupBy(*g, "_b").agg(F.sum("_sneg").alias("_bneg"))
    wb = Window.partitionBy(*g).orderBy("_b").rowsBetween(*before)
    bt = bt.select(*g, "_b", F.coalesce(F.sum("_bneg").over(wb), F.lit(0)).cast("bigint").alias("_off"))
    ws = Window.partitionBy(*g, "_b").orderBy("_s").rowsBetween(*before)
    parts = parts.select(*g, "_b", "_s", F.coalesce(F.sum("_sneg").over(ws), F.lit(0)).cast("bigint").alias("_soff"))
    parts = null_safe_join(parts, bt, g + ["_b"])
    parts = parts.select(*g, "_b", "_s", (F.col("_off") + F.col("_soff")).alias("_off"))
    # level 3: inside each part
    wi = Window.partitionBy(*g, "_b", "_s").orderBy("_p").rowsBetween(*before)
    p = p.withColumn("_below", F.coalesce(F.sum("_neg").over(wi), F.lit(0)).cast("bigint"))
    j = null_safe_join(p, parts, g + ["_b", "_s"])
    dec = "decimal(38,0)"
    contrib = F.col("_pos").cast(dec) * (F.lit(2).cast(dec) * (F.col("_off") + F.col("_below")).cast(dec)
                                         + F.col("_neg").cast(dec))
    r = j.groupBy(*g).agg(F.sum(contrib).alias("_num"), F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    auc = F.try_divide(F.col("_num").cast("double"),
                       F.lit(2.0) * F.col("_P").cast("double") * F.col("_N").cast("double"))
    return r.select(*g, F.round(auc, 6).alias("auc_roc"))


def metrics_report(df: DataFrame, threshold, group_cols=()) -> DataFrame:
    """Every metric and the four confusion cells in one row (per group)."""
    g = list(group_cols)
    c = confusion_counts(df, threshold, g)
    cols = [F.round(v, 6).alias(k) for k, v in metric_columns().items()]
    m = c.select(*g, "tn", "fp", "fn", "tp", *cols)
    a = auc_roc(df, g)
    return null_safe_join(m, a, g, "left") if g else _attach_scalar(m, a)


def _attach_scalar(m: DataFrame, a: DataFrame) -> DataFrame:
    """Add the one-row AUC result to the one-row metrics (scalar subquery)."""
    return m.withColumn("auc_roc", a.select("auc_roc").scalar())


def metrics_by_group(df: DataFrame, key: str, threshold) -> DataFrame:
    c = confusion_counts(df, threshold, [key])
    cols = [F.round(v, 6).alias(k) for k, v in metric_columns().items()]
    m = c.select(key, (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"), *cols)
    return null_safe_join(m, auc_roc(df, [key]), [key], "left")


def has_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.coalesce(F.max(F.col(label).isNotNull()), F.lit(False)).alias("has_labels"))
