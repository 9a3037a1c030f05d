"""Properties and edge tables."""

import pytest
from pyspark.sql import functions as F

from credo.operators.dedup import deduplicate
from credo.operators.features import feature_table
from credo.operators.lookups import all_lookups, lookup_stats
from credo.operators.metrics import auc_roc, metrics_report
from credo.operators.split import split_hash
from credo.operators.sweep import threshold_sweep
from credo.plans import fixtures as fx
from credo.plans.chain import labelled
from tests.conftest import SF0001, rows

SCHEMA = ("row_key string, statement string, label string, speaker_name string, "
          "speaker_affiliation string, statement_context string")


def _features(df):
    s = split_hash(labelled(df))
    lk = all_lookups(s.filter("split = 'train'"))
    return s, lk, feature_table(s, lk, lookup_stats(lk))


def test_lookups_only_see_train_rows(spark):
    base = fx.f2(spark, SF0001)
    s, lk, _ = _features(base)
    test_keys = s.filter("split <> 'train'").select("row_key")
    # rewrite every label and speaker of the non-train rows: no lookup may change
    changed = base.join(test_keys.withColumn("_t", F.lit(1)), "row_key", "left").select(
        "row_key", "statement",
        F.when(F.col("_t").isNotNull(), F.lit("false")).otherwise(F.col("label")).alias("label"),
        F.when(F.col("_t").isNotNull(), F.lit("someone else")).otherwise(F.col("speaker_name")).alias("speaker_name"),
        "speaker_affiliation", "statement_context")
    _, lk2, _ = _features(changed)
    assert rows(lk.filter("kind <> 'all'")) == rows(lk2.filter("kind <> 'all'"))


def test_every_feature_non_null(spark):
    _, _, f = _features(fx.f1(spark, SF0001))
    cols = ["cs_ratio", "cs_known", "speaker_cred", "affil_cred", "ctx_cred", "len_norm"]
    nulls = f.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    assert all(nulls[c] == 0 for c in cols)
    bounds = f.agg(F.min("speaker_cred"), F.max("speaker_cred"), F.min("cs_ratio"), F.max("cs_ratio")).first()
    assert 0 <= bounds[0] <= bounds[1] <= 1 and 0 <= bounds[2] <= bounds[3] <= 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    s, lk, f = _features(df)
    assert f.count() == 0 and deduplicate(df).count() == 0
    st = lookup_stats(lk).first()
    assert st["n"] == 0 and st["default_cred"] == 0.557


def test_one_row_and_all_null_speaker(spark):
    df = spark.createDataFrame([("k1", "only", "true", None, None, None)], SCHEMA)
    _, lk, f = _features(df)
    r = f.first()
    assert r["cs_ratio"] == 0.5 and r["cs_known"] is False
    assert lk.filter("kind = 'all'").first()["len_std"] == pytest.approx(1e-8)


def test_all_unknown_labels(spark):
    df = spark.createDataFrame([("k1", "a", "pants-fire", "s", "d", "c"), ("k2", "b", "maybe", "s", "d", "c")], SCHEMA)
    assert labelled(df).count() == 0


def test_equal_probabilities(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "y int, prob double")
    assert auc_roc(df).first()["auc_roc"] == 0.5
    sw = threshold_sweep(df).collect()
    assert all(r["balanced_accuracy"] == 0.5 for r in sw)
    assert [r["i"] for r in sw if r["is_best"]] == [0]
    m = metrics_report(df, 0.5).first()
    assert (m["tp"], m["fp"]) == (2, 2)


def test_sweep_best_at_least_value_at_half(spark):
    f3 = fx.f3(spark, SF0001)
    sw = threshold_sweep(f3).collect()
    best = max(r["balanced_accuracy"] for r in sw)
    assert [r for r in sw if r["is_best"]][0]["balanced_accuracy"] == best


def test_lookups_same_for_1_and_8_partitions(spark):
    from credo.operators.features import feature_table

    def run():
        s, lk, f = _features(fx.f1(spark, SF0001))
        return rows(lk), rows(f.select("row_key", "cs_ratio", "speaker_cred", "affil_cred", "ctx_cred", "len_norm"))

    a = run()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
