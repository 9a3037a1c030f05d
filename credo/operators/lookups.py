"""Leakage-free credibility lookups, computed from the training split only.

``all_lookups`` computes every lookup in one scan with GROUPING SETS
((speaker), (affiliation), (context), ()): map-side partial aggregation
keeps hot speakers or contexts from skewing the shuffle, and the empty set
carries the overall TRUE rate and the length statistics.

Long form, one row per (kind, key):
    kind   'speaker' | 'affiliation' | 'context' | 'all'
    key    stripped raw key (NULL for 'all')
    n, n_true, w_sum (falsehood weights in integer hundredths)
    cred = n_true / n, cs = w_sum / (100 n)
and, on the 'all' row, len_mean / len_std.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credo.constants import LEN_STD_EPSILON
from credo.functions.labels import binary_label, cs_weight_hundredths
from credo.functions.text import norm_affil, norm_context, norm_speaker, statement_length, strip_ws

KINDS = {"speaker": "speaker_name", "affiliation": "speaker_affiliation", "context": "statement_context"}
NORMALISERS = {"speaker": norm_speaker, "affiliation": norm_affil, "context": norm_context}


def with_label_columns(df: DataFrame) -> DataFrame:
    """Add ``y`` (binary label, NULL when unknown) if it is missing."""
    return df if "y" in df.columns else df.withColumn("y", binary_label("label"))


def _stats_expr(length_col):
    return [
        F.avg(length_col).alias("len_mean"),
        (F.coalesce(F.stddev_samp(length_col), F.lit(0.0)) + F.lit(LEN_STD_EPSILON)).alias("len_std"),
    ]


def all_lookups(train: DataFrame, clean_text: bool = False, strip: bool = True) -> DataFrame:
    """All lookups + overall stats from a training split, in one aggregation.

    ``strip=False`` keeps keys as written (and says so in a column
    ``as_written``), which policy 'last' of ``normalize_lookup`` needs: there
    the raw keys compete."""
    from credo.functions.text import standardize_format

    text = standardize_format("statement") if clean_text else F.col("statement")
    key_of = strip_ws if strip else F.col
    t = with_label_columns(train).select(
        key_of("speaker_name").alias("_spk"),
        key_of("speaker_affiliation").alias("_afl"),
        key_of("statement_context").alias("_ctx"),
        F.col("y"),
        cs_weight_hundredths("label").alias("_w"),
        statement_length(text).alias("_len"),
    )
    g = t.groupingSets([["_spk"], ["_afl"], ["_ctx"], []], "_spk", "_afl", "_ctx").agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("n"),
        F.sum("y").cast("bigint").alias("n_true"),
        F.sum("_w").cast("bigint").alias("w_sum"),
        *_stats_expr(F.col("_len")),
    )
    kind = (F.when(F.col("_gid") == 3, F.lit("speaker"))
            .when(F.col("_gid") == 5, F.lit("affiliation"))
            .when(F.col("_gid") == 6, F.lit("context"))
            .otherwise(F.lit("all")))
    key = (F.when(F.col("_gid") == 3, F.col("_spk"))
           .when(F.col("_gid") == 5, F.col("_afl"))
           .when(F.col("_gid") == 6, F.col("_ctx")))
    out = g.select(kind.alias("kind"), key.alias("key"), "n", "n_true", "w_sum", "len_mean", "len_std")
    # pandas-style grouping drops NULL keys
    out = _finish(out.filter((F.col("kind") == "all") | F.col("key").isNotNull()))
    return out if strip else out.withColumn("as_written", F.lit(True))


def _finish(lk: DataFrame) -> DataFrame:
    all_row = F.col("kind") == "all"
    return lk.select(
        "kind", "key", "n", "n_true", "w_sum",
        F.try_divide(F.col("n_true").cast("double"), F.col("n").cast("double")).alias("cred"),
        F.try_divide(F.col("w_sum").cast("double"), F.col("n").cast("double") * F.lit(100.0)).alias("cs"),
        F.when(all_row, F.col("len_mean")).alias("len_mean"),
        F.when(all_row, F.col("len_std")).alias("len_std"),
    )


def cs_lookup(train: DataFrame) -> DataFrame:
    """speaker -> credit score (mean falsehood weight)."""
    return (all_lookups(train).filter(F.col("kind") == "speaker")
            .select(F.col("key").alias("speaker"), "n", "cs"))


def cred_lookup(train: DataFrame, kind: str) -> DataFrame:
    """key -> TRUE rate for kind in {'speaker', 'affiliation', 'context'}."""
    col = KINDS[kind]
    t = with_label_columns(train).select(strip_ws(col).alias("key"), "y").filter(F.col("key").isNotNull())
    return t.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("y").cast("double") / F.count(F.lit(1))).alias("cred"))


def lookup_stats(lookups: DataFrame) -> DataFrame:
    """Exactly one row: n, n_true, default_cred, len_mean, len_std (fallback
    values when the training split was empty)."""
    from credo.constants import DEFAULT_CRED_FALLBACK, LEN_MEAN_FALLBACK, LEN_STD_FALLBACK

    a = lookups.filter(F.col("kind") == "all")
    return a.agg(
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(F.max("n_true"), F.lit(0)).cast("bigint").alias("n_true"),
        F.coalesce(F.max("cred"), F.lit(DEFAULT_CRED_FALLBACK)).alias("default_cred"),
        F.coalesce(F.max("len_mean"), F.lit(LEN_MEAN_FALLBACK)).alias("len_mean"),
        F.coalesce(F.max("len_std"), F.lit(LEN_STD_FALLBACK)).alias("len_std"))


def default_cred(train: DataFrame) -> DataFrame:
    return with_label_columns(train).agg(F.avg(F.col("y").cast("double")).alias("default_cred"))


def length_stats(train: DataFrame, clean_text: bool = False) -> DataFrame:
    from credo.functions.text import standardize_format

    text = standardize_format("statement") if clean_text else F.col("statement")
    return train.agg(*_stats_expr(statement_length(text)))


def pos_weight(train: DataFrame) -> DataFrame:
    """n_false / n_true on the training split (NULL when there is no TRUE row)."""
    t = with_label_columns(train)
    return t.agg(F.try_divide(F.sum(1 - F.col("y")).cast("double"),
                              F.sum("y").cast("double")).alias("pos_weight"))


def normalize_lookup(lookups: DataFrame, policy: str = "merge") -> DataFrame:
    """Re-key every lookup by its field's normaliser.

    merge: keys that collide after normalisation are pooled (their counts
           add up), so the value is the rate over all their rows.
    last:  the value of the largest raw key wins (what a dict rebuilt from
           sorted keys would keep); takes ``all_lookups(..., strip=False)``
           only, as keys that were stripped are pooled already.
    """
    if policy == "last" and "as_written" not in lookups.columns:
        raise ValueError("policy 'last' needs keys as written: all_lookups(..., strip=False)")
    norm = (F.when(F.col("kind") == "speaker", norm_speaker("key"))
            .when(F.col("kind") == "affiliation", norm_affil("key"))
            .when(F.col("kind") == "context", norm_context("key"))
            .otherwise(F.col("key")))
    lk = lookups.withColumn("_nk", norm)
    if policy == "merge":
        g = lk.groupBy("kind", "_nk").agg(
            F.sum("n").cast("bigint").alias("n"), F.sum("n_true").cast("bigint").alias("n_true"),
            F.sum("w_sum").cast("bigint").alias("w_sum"),
            F.max("len_mean").alias("len_mean"), F.max("len_std").alias("len_std"))
    elif policy == "last":
        g = lk.groupBy("kind", "_nk").agg(
            F.max_by(F.struct("n", "n_true", "w_sum", "len_mean", "len_std"), F.col("key")).alias("_v"))
        g = g.select("kind", "_nk", "_v.*")
    else:
        raise ValueError(f"unknown collision policy {policy!r}")
    return _finish(g.withColumnRenamed("_nk", "key"))


def strip_lookup(lookups: DataFrame) -> DataFrame:
    """Lookups by stripped keys from lookups by keys as written."""
    g = lookups.groupBy("kind", strip_ws("key").alias("key")).agg(
        *(F.sum(c).cast("bigint").alias(c) for c in ("n", "n_true", "w_sum")),
        F.max("len_mean").alias("len_mean"), F.max("len_std").alias("len_std"))
    return _finish(g)


def frequent_keys(lookups: DataFrame, share: float) -> dict[str, list]:
    """Keys with more than ``share`` of the training rows, by kind: at most 1 / share of each."""
    rows = lookup_stats(lookups).first()["n"]
    hot = lookups.filter((F.col("kind") != "all") & (F.col("n") > share * rows)).select("kind", "key").collect()
    return {k: [r["key"] for r in hot if r["kind"] == k] for k in KINDS}


def lookup_sizes(lookups: DataFrame) -> DataFrame:
    """How many keys each lookup knows."""
    return (lookups.filter(F.col("kind") != "all")
            .groupBy("kind").agg(F.count(F.lit(1)).alias("n_keys")))
