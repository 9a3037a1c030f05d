"""Lookup joins: credit score and metadata features with defaults.

Every lookup is a left equi-join on one key column; NULL keys never match,
which is exactly "use the default".  The lookups grow with the number of
distinct speakers, so they are not broadcast whole unless AQE measures that
they are small.  A speaker with a third of the rows would put them into one
task: hot keys, at most 1 / HOT_SHARE of them, get their values from a
broadcast of their few lookup rows, and all other keys from a shuffle in
which hot and NULL keys are dealt evenly (``skew.spread_join``).  Which keys
are hot comes from a frequency sketch over the probes (``find_hot``, one pass
over a stored table) or, for streams, from the training counts in the lookups
themselves (``lookups.frequent_keys``).

Key modes (how lookup keys and probes are spelled):
    raw          lookup keys and probes stripped only
    eval_compat  lookup keys normalised; the credit-score probe normalised,
                 the metadata probes stripped only
    normalized   lookup keys and probes normalised (default)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credo.constants import CS_DEFAULT
from credo.functions.text import (norm_affil, norm_context, norm_speaker, standardize_format,
                                  statement_length, strip_ws)
from credo.operators.lookups import frequent_keys, lookup_stats, normalize_lookup, strip_lookup
from credo.operators.skew import HOT_SHARE, hot_values, spread_join

MODES = ("raw", "eval_compat", "normalized")
META = {"speaker_cred": ("speaker", "speaker_name"),
        "affil_cred": ("affiliation", "speaker_affiliation"),
        "ctx_cred": ("context", "statement_context")}
NORM = {"speaker": norm_speaker, "affiliation": norm_affil, "context": norm_context}


def _probe(kind: str, col: str, normalised: bool) -> Column:
    return NORM[kind](F.col(col)) if normalised else strip_ws(F.col(col))


STAT_NAMES = ("default_cred", "len_mean", "len_std")


def _with_stats(df: DataFrame, stats) -> DataFrame:
    """Attach the scalar stats as one struct column ``_st``: literals from a
    mapping, or ONE scalar subquery over a one-row DataFrame (computed once
    per query, then a constant in every task)."""
    if isinstance(stats, DataFrame):
        st = stats.select(F.struct(*STAT_NAMES).alias("_st")).scalar()
    else:
        st = F.struct(*[F.lit(float(stats[n])).alias(n) for n in STAT_NAMES])
    return df.withColumn("_st", st)


def _stat(stats, name: str) -> Column:
    return F.col("_st")[name]


def lookups_for_mode(lookups: DataFrame, mode: str, policy: str = "merge") -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"key_mode must be one of {MODES}")
    if mode == "raw":
        return strip_lookup(lookups) if "as_written" in lookups.columns else lookups
    return normalize_lookup(lookups, policy)


def _probes(key_mode: str) -> dict[str, Column]:
    """The probe of each kind of key; the credit score's is that of ``speaker_cs``."""
    normed = key_mode == "normalized"
    out = {kind: _probe(kind, col, normed) for kind, col in META.values()}
    return out | {"speaker_cs": _probe("speaker", "speaker_name", key_mode != "raw")}


def find_hot(df: DataFrame, key_mode: str = "normalized", share: float = HOT_SHARE) -> dict[str, list]:
    """Hot probes of ``df`` by kind of key; one pass with a sketch of each."""
    return hot_values(df, _probes(key_mode), share)


def trained_hot(lookups: DataFrame, key_mode: str = "normalized", policy: str = "merge", share: float = HOT_SHARE) -> dict[str, list]:
    """Keys that were hot in training, for rows that can't be read in advance (streams)."""
    found = frequent_keys(lookups_for_mode(lookups, key_mode, policy), share)
    return found | {"speaker_cs": found["speaker"]}


SALT_COL = "_salt"


def with_salt(df: DataFrame, salts: int, key: str = "row_key") -> DataFrame:
    """Spread rows over ``salts`` sub-keys (deterministic, from the row key)."""
    return df.withColumn(SALT_COL, F.pmod(F.xxhash64(F.col(key)), F.lit(salts)).cast("int"))


def salted_left_join(df: DataFrame, side: DataFrame, cond: Column, salts: int) -> DataFrame:
    """Left join where a hot key on ``df`` is split over ``salts`` tasks: each
    fact row carries a salt, the (small, one row per key) side is replicated
    once per salt -- S x keys rows, a known bound -- and the salt joins too."""
    if salts <= 1:
        return df.join(side, cond, "left")
    rep = side.withColumn("_s_side", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = df if SALT_COL in df.columns else with_salt(df, salts)
    out = left.join(rep, cond & (F.col(SALT_COL) == F.col("_s_side")), "left").drop("_s_side")
    return out if SALT_COL in df.columns else out.drop(SALT_COL)


def _join_value(df: DataFrame, lk: DataFrame, kind: str, probe: Column, value: str,
                out: str, default: Column | None, known: str | None = None, salts: int = 0, hot: list | None = None) -> DataFrame:
    if hot is not None:
        side = lk.filter(F.col("kind") == kind).select("key", F.col(value).alias(out))
        j = spread_join(df, side, probe, "key", [out], hot, hit=known)
        return j if default is None else j.withColumn(out, F.coalesce(out, default))
    side = lk.filter(F.col("kind") == kind).select(F.col("key").alias(f"_k_{out}"),
                                                    F.col(value).alias(f"_v_{out}"))
    j = salted_left_join(df, side, probe == F.col(f"_k_{out}"), salts)
    v = F.col(f"_v_{out}") if default is None else F.coalesce(F.col(f"_v_{out}"), default)
    j = j.withColumn(out, v)
    if known:
        j = j.withColumn(known, F.col(f"_k_{out}").isNotNull())
    return j.drop(f"_k_{out}", f"_v_{out}")


def attach_cs(df: DataFrame, lookups: DataFrame, key_mode: str = "normalized",
              cs_default: float = CS_DEFAULT, policy: str = "merge", hot: dict[str, list] | None = None) -> DataFrame:
    """Add ``cs_ratio`` (default ``cs_default``) and ``cs_known``.

    ``hot`` (``find_hot`` or ``trained_hot``) splits hot speakers off the shuffle."""
    lk = lookups_for_mode(lookups, key_mode, policy)
    return _join_value(df, lk, "speaker", _probes(key_mode)["speaker_cs"], "cs", "cs_ratio", F.lit(float(cs_default)), "cs_known",
                       hot=hot and hot["speaker_cs"])


def build_metadata(df: DataFrame, lookups: DataFrame, stats=None, key_mode: str = "normalized",
                   clean_text: bool = False, policy: str = "merge", hot: dict[str, list] | None = None) -> DataFrame:
    """Add speaker_cred, affil_cred, ctx_cred (default: overall TRUE rate)
    and len_norm (z-score of the statement length)."""
    lk = lookups_for_mode(lookups, key_mode, policy)
    stats = lookup_stats(lookups) if stats is None else stats
    out = _with_stats(df, stats)
    dflt = _stat(stats, "default_cred")
    for name, (kind, col) in META.items():
        out = _join_value(out, lk, kind, _probe(kind, col, key_mode == "normalized"), "cred", name, dflt, hot=hot and hot[kind])
    text = standardize_format("statement") if clean_text else F.col("statement")
    length = statement_length(text)
    out = out.withColumn("len_norm", (length - _stat(stats, "len_mean")) / _stat(stats, "len_std"))
    return out.drop("_st")


def feature_table(df: DataFrame, lookups: DataFrame, stats=None, key_mode: str = "normalized",
                  cs_default: float = CS_DEFAULT, clean_text: bool = False,
                  policy: str = "merge", salts: int = 0, hot: dict[str, list] | None = None, flags: bool = False) -> DataFrame:
    """cs_ratio, cs_known and the four metadata features for every row.

    When the credit score and the speaker credibility use the same probe
    (raw and normalized modes) one speaker join serves both.  ``hot`` (from
    ``find_hot`` or ``trained_hot``; the flows give it) takes hot keys out of
    the shuffles; ``salts`` > 1 salts the joins instead, replicating the lookups.
    ``flags`` adds spk_known, afl_known and ctx_known (see ``feature_flags``)
    from the same joins."""
    if key_mode == "eval_compat":
        out = attach_cs(df, lookups, key_mode, cs_default, policy, hot)
        out = build_metadata(out, lookups, stats, key_mode, clean_text, policy, hot)
        return feature_flags(out, lookups, key_mode, policy) if flags else out
    lk = lookups_for_mode(lookups, key_mode, policy)
    stats = lookup_stats(lookups) if stats is None else stats
    out = _with_stats(df, stats)
    dflt = _stat(stats, "default_cred")
    normed = key_mode == "normalized"
    spk = lk.filter(F.col("kind") == "speaker").select(F.col("key").alias("_k_spk"), F.col("cs").alias("_cs"),
                                                       F.col("cred").alias("_cred"))
    if hot is not None:
        out = spread_join(out, spk, _probe("speaker", "speaker_name", normed), "_k_spk", ["_cs", "_cred"], hot["speaker"], hit="cs_known")
    else:
        out = with_salt(out, salts) if salts > 1 else out
        out = salted_left_join(out, spk, _probe("speaker", "speaker_name", normed) == F.col("_k_spk"), salts)
        out = out.withColumn("cs_known", F.col("_k_spk").isNotNull()).drop("_k_spk")
    out = (out.withColumn("cs_ratio", F.coalesce(F.col("_cs"), F.lit(float(cs_default))))
              .withColumn("speaker_cred", F.coalesce(F.col("_cred"), dflt)).drop("_cs", "_cred"))
    for name, flag in (("affil_cred", "afl_known"), ("ctx_cred", "ctx_known")):
        kind, col = META[name]
        out = _join_value(out, lk, kind, _probe(kind, col, normed), "cred", name, dflt, flag if flags else None, salts, hot and hot[kind])
    if flags:
        out = out.withColumn("spk_known", F.col("cs_known"))
    text = standardize_format("statement") if clean_text else F.col("statement")
    out = out.withColumn("len_norm", (statement_length(text) - _stat(stats, "len_mean")) / _stat(stats, "len_std"))
    return out.drop("_st", SALT_COL) if SALT_COL in out.columns else out.drop("_st")


def key_mode_compare(df: DataFrame, lookups: DataFrame, cs_default: float = CS_DEFAULT) -> DataFrame:
    """Rows whose feature value differs from the raw-key value, per feature
    and key mode.  The rows are first reduced to their distinct key triples
    with counts (map-side combined), so the joins see keys, not rows; each
    feature is joined once per key spelling that it needs."""
    raw_lk = lookups
    norm_lk = normalize_lookup(lookups)
    triples = df.groupBy("speaker_name", "speaker_affiliation", "statement_context").agg(F.count(F.lit(1)).alias("_n"))
    out = _with_stats(triples, lookup_stats(lookups))
    dflt = F.col("_st")["default_cred"]
    variants = []
    for feat, kind, col, value, default in (
            [("cs_ratio", "speaker", "speaker_name", "cs", F.lit(float(cs_default)))]
            + [(name, kind, col, "cred", dflt) for name, (kind, col) in META.items()]):
        out = _join_value(out, raw_lk, kind, _probe(kind, col, False), value, f"{feat}__raw", default)
        out = _join_value(out, norm_lk, kind, _probe(kind, col, True), value, f"{feat}__norm", default)
        eval_col = f"{feat}__norm" if feat == "cs_ratio" else f"{feat}__normkey"
        if feat != "cs_ratio":
            out = _join_value(out, norm_lk, kind, _probe(kind, col, False), value, eval_col, default)
        variants.append((feat, "eval_compat", eval_col))
        variants.append((feat, "normalized", f"{feat}__norm"))
    aggs = [F.sum(F.when(~F.col(c).eqNullSafe(F.col(f"{feat}__raw")), F.col("_n")).otherwise(0))
            .cast("bigint").alias(f"{feat}|{mode}") for feat, mode, c in variants]
    wide = out.agg(*aggs)
    pairs = ", ".join(f"'{feat}', '{mode}', `{feat}|{mode}`" for feat, mode, _ in variants)
    return wide.selectExpr(f"stack({len(variants)}, {pairs}) AS (feature, mode, n_diff)")


def unseen_report(features: DataFrame) -> DataFrame:
    """Rows that fell back to a default, per split and key kind.

    Expects ``feature_table`` output with ``split`` and the ``*_known`` flags
    added by ``feature_flags``."""
    kinds = [("speaker_cs", "cs_known"), ("speaker", "spk_known"),
             ("affiliation", "afl_known"), ("context", "ctx_known")]
    pairs = ", ".join(f"'{k}', {c}" for k, c in kinds)
    long = features.selectExpr("split", f"stack({len(kinds)}, {pairs}) AS (kind, known)")
    return long.groupBy("split", "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("known"), 0).otherwise(1)).cast("bigint").alias("n_default"))


def feature_flags(df: DataFrame, lookups: DataFrame, key_mode: str = "normalized",
                  policy: str = "merge") -> DataFrame:
    """Add spk_known / afl_known / ctx_known: did the key hit its lookup?"""
    lk = lookups_for_mode(lookups, key_mode, policy)
    out = df
    for flag, (kind, col) in zip(("spk_known", "afl_known", "ctx_known"), META.values()):
        side = lk.filter(F.col("kind") == kind).select(F.col("key").alias(f"_k_{flag}"))
        out = (out.join(side, _probe(kind, col, key_mode == "normalized") == F.col(f"_k_{flag}"), "left")
               .withColumn(flag, F.col(f"_k_{flag}").isNotNull()).drop(f"_k_{flag}"))
    return out
