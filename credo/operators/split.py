"""Reproducible train / validation / test splits.

``split_hash``        map-only: a row's split depends on md5(row_key) alone.
``split_stratified``  exact per-class sizes (the stratified 80/10/10 of the
                      original flow): rows are ranked inside their class by
                      (md5(row_key), row_key) and cut at exact counts.

The exact ranking never sorts a class in one task.  Rows are counted per
(class, 16-bit md5 prefix) -- at most 65,536 buckets per class, a bounded
table -- prefix sums over that small table give each bucket's first rank;
only the (at most two per class and cut) buckets that straddle a cut are
ranked row by row, each in its own window partition.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credo.operators.dedup import KEY

TWO32 = 1 << 32


def _cut_hex(ratio: float) -> str:
    return format(int(round(ratio * TWO32)), "08x")


def split_hash(df: DataFrame, key: str = KEY, test: float = 0.1, val: float = 0.1) -> DataFrame:
    """Add ``split`` in {'test','val','train'} from the first 8 hex digits of md5(key)."""
    u = F.substring(F.md5(F.col(key).cast("string")), 1, 8)
    return df.withColumn(
        "split",
        F.when(u < F.lit(_cut_hex(test)), F.lit("test"))
        .when(u < F.lit(_cut_hex(test + val)), F.lit("val"))
        .otherwise(F.lit("train")),
    )


def _largest_remainder(counts: DataFrame, n_draws_col: str, out: str) -> DataFrame:
    """Share ``n_draws`` over classes proportionally (floor + largest remainder,
    ties to the smaller class value).  ``counts`` is tiny: one row per class."""
    cont = F.col("cnt") / F.col("total") * F.col(n_draws_col)
    c = counts.withColumn("_cont", cont).withColumn("_floor", F.floor("_cont").cast("bigint"))
    c = c.withColumn("_rem", F.col("_cont") - F.col("_floor"))
    w_all = Window.partitionBy(F.lit(0))  # class table: a handful of rows
    c = c.withColumn("_need", F.col(n_draws_col) - F.sum("_floor").over(w_all))
    c = c.withColumn("_rk", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.col("_rem").desc(), F.col("_cls"))))
    return c.withColumn(out, F.col("_floor") + F.when(F.col("_rk") <= F.col("_need"), 1).otherwise(0)) \
            .drop("_cont", "_floor", "_rem", "_need", "_rk")


def split_sizes(df: DataFrame, class_col: str, test: float = 0.1, val: float = 0.1,
                counts: DataFrame | None = None) -> DataFrame:
    """Per class: cnt, n_test, n_val (tiny table).

    Total test size = ceil(test * n); train+val is shared over classes by
    largest remainder and test takes the rest of each class.  The second cut
    applies ``val / (1 - test)`` to what is left, in the same way.
    ``counts`` (columns _cls, cnt) may be given to avoid another pass.
    """
    if counts is None:
        counts = df.groupBy(F.col(class_col).alias("_cls")).agg(F.count(F.lit(1)).alias("cnt"))
    w_all = Window.partitionBy(F.lit(0))
    counts = counts.withColumn("total", F.sum("cnt").over(w_all))
    counts = counts.withColumn("_n_test", F.ceil(F.lit(float(test)) * F.col("total")).cast("bigint"))
    counts = counts.withColumn("_n_trval", F.col("total") - F.col("_n_test"))
    s1 = _largest_remainder(counts, "_n_trval", "_trval")
    s1 = s1.withColumn("n_test", F.col("cnt") - F.col("_trval"))
    # second cut on the train+val part
    s2 = s1.select("_cls", F.col("_trval").alias("cnt"), "n_test")
    s2 = s2.withColumn("total", F.sum("cnt").over(w_all))
    s2 = s2.withColumn("_n_val", F.ceil(F.lit(float(val) / (1.0 - float(test))) * F.col("total")).cast("bigint"))
    s2 = s2.withColumn("_n_tr", F.col("total") - F.col("_n_val"))
    s2 = _largest_remainder(s2, "_n_tr", "_tr")
    return s2.select("_cls", F.col("cnt").alias("n_trval"), "n_test",
                     (F.col("cnt") - F.col("_tr")).alias("n_val"))


def split_stratified(df: DataFrame, class_col: str = "y", key: str = KEY,
                     test: float = 0.1, val: float = 0.1, prefix_digits: int = 4) -> DataFrame:
    """Add ``split`` with exact per-class test / val counts."""
    h = F.md5(F.col(key).cast("string"))
    rows = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, prefix_digits))
    # bucket table: at most (#classes x 16**prefix_digits) rows
    buckets = rows.groupBy(F.col(class_col).alias("_cls"), "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wcls = Window.partitionBy("_cls").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_start", F.coalesce(F.sum("_bn").over(wcls), F.lit(0)).cast("bigint"))
    class_counts = buckets.groupBy("_cls").agg(F.sum("_bn").cast("bigint").alias("cnt"))
    sizes = split_sizes(df, class_col, test, val, counts=class_counts)
    # one row per class; a NULL class is a class
    sizes = sizes.withColumnRenamed("_cls", "_c")
    buckets = buckets.join(sizes, F.col("_cls").eqNullSafe(F.col("_c"))).drop("_c")
    t_end = F.col("n_test")
    v_end = F.col("n_test") + F.col("n_val")
    first, last = F.col("_start") + 1, F.col("_start") + F.col("_bn")
    whole = (F.when(last <= t_end, F.lit("test"))
             .when((first > t_end) & (last <= v_end), F.lit("val"))
             .when(first > v_end, F.lit("train")))
    buckets = buckets.select("_cls", "_b", "_start", "n_test", "n_val", whole.alias("_whole"))
    # at most classes x 16**prefix_digits rows; broadcast if its size allows
    bk = buckets.withColumnRenamed("_b", "_bb")
    j = rows.join(bk, (rows[class_col].eqNullSafe(bk["_cls"])) & (rows["_b"] == bk["_bb"]))
    direct = j.filter(F.col("_whole").isNotNull()).withColumn("split", F.col("_whole"))
    cut = j.filter(F.col("_whole").isNull())
    wr = Window.partitionBy("_cls", "_bb").orderBy("_h", key)
    rank = F.col("_start") + F.row_number().over(wr)
    cut = cut.withColumn(
        "split",
        F.when(rank <= F.col("n_test"), F.lit("test"))
        .when(rank <= F.col("n_test") + F.col("n_val"), F.lit("val"))
        .otherwise(F.lit("train")))
    cols = df.columns + ["split"]
    return direct.select(*cols).unionByName(cut.select(*cols))


def split_report(df: DataFrame, class_col: str = "y") -> DataFrame:
    """Size and TRUE rate per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(class_col)).cast("bigint").alias("n_true"),
        F.round(F.avg(F.col(class_col).cast("double")), 6).alias("true_rate"),
    )


def class_balance(df: DataFrame, class_col: str = "y") -> DataFrame:
    return df.agg(
        F.sum(F.col(class_col)).cast("bigint").alias("n_true"),
        F.sum(1 - F.col(class_col)).cast("bigint").alias("n_false"),
        F.round(F.avg(F.col(class_col).cast("double")), 6).alias("true_rate"),
    )


def leakage_check(df: DataFrame, text_col=None) -> DataFrame:
    """Statements (optionally a normalised form of them) that occur in more
    than one split.  Expected empty after de-duplication on raw text."""
    t = F.col("statement") if text_col is None else text_col
    return (df.filter(F.col("statement").isNotNull())
              .groupBy(t.alias("statement"))
              .agg(F.countDistinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n_rows"))
              .filter(F.col("n_splits") > 1))
